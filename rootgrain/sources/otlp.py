"""OTLP documents as signals: resource, scope and item levels are exploded in one plan.

documents: (path, content) with a JSON export request in a row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTRIBUTES}>"
_POINTS = f"struct<dataPoints:array<{_POINT}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRIBUTES}>"
METRICS = f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,sum:{_POINTS},gauge:{_POINTS},histogram:string,exponentialHistogram:string,summary:string>>>>>>"
LOGS = f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityText:string,body:{_VALUE},attributes:{_ATTRIBUTES}>>>>>>"
TRACES = f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>>>>>>>"
#: Span status codes by number and by name, and severities beyond the vocabulary.
STATUS = {"0": "UNSET", "1": "OK", "2": "ERROR", "STATUS_CODE_UNSET": "UNSET", "STATUS_CODE_OK": "OK", "STATUS_CODE_ERROR": "ERROR"}
SEVERITIES = {"ERR": "ERROR", "CRITICAL": "FATAL"}


def value_text(value: Column) -> Column:
    """A scalar attribute value as text; null for others."""
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"))


def attributes(pairs: Column) -> Column:
    """key -> text of an attribute list; of equal keys the last counts, empty keys and lists don't."""
    known = F.filter(F.coalesce(pairs, F.array().cast(_ATTRIBUTES)), lambda a: (F.coalesce(a["key"], F.lit("")) != "") & value_text(a["value"]).isNotNull())
    last = F.filter(known, lambda a, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda b: b["key"] == a["key"]))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], value_text(a["value"]))))


def _service(resource: Column, fallback: str | None) -> Column:
    own = F.filter(F.transform(F.filter(resource["attributes"], lambda a: a["key"] == "service.name"), lambda a: value_text(a["value"])), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(fallback))


def _nanos(text: Column) -> Column:
    return F.when(text.rlike(r"^-?\d{1,19}$"), text.try_cast("decimal(20,0)"))


def _ms(nanos: Column) -> Column:
    return F.floor(nanos / 1_000_000).cast("bigint")


def _items(documents: DataFrame, schema: str, top: str, scope: str, items: str, service: str | None) -> DataFrame:
    root = documents.select("path", F.explode(F.from_json("content", schema)[top]).alias("r"))
    scopes = root.select("path", _service(F.col("r.resource"), service).alias("service"), F.explode(f"r.{scope}").alias("s"))
    return scopes.select("path", "service", F.explode(f"s.{items}").alias("x")).where("x IS NOT NULL")


def _split(rows: DataFrame, reason: Column, fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    told = rows.withColumn("_reason", reason)
    return told.where("_reason IS NULL").select("path", "service", *[c.alias(k) for k, c in fields.items()]), told.where("_reason IS NOT NULL").select("path", F.col("_reason").alias("reason"), F.to_json("x").alias("record"))


def _told(rows: DataFrame, reason: Column, fields: dict[str, Column]) -> DataFrame:
    well = F.col("_reason").isNull()
    signal = F.struct("service", *[c.alias(k) for k, c in fields.items()])
    return rows.withColumn("_reason", reason).select("path", F.col("_reason").alias("reason"), F.when(well, signal).alias("signal"), F.when(~well, F.to_json("x")).alias("record"))


NO_SERVICE = "missing service name"


def metrics(documents: DataFrame, service: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, quarantine): data points of sums and gauges. Other types are quarantined whole, as are
    metrics without a name; points without a readable time, value or service one by one."""
    rows = _items(documents, METRICS, "resourceMetrics", "scopeMetrics", "metrics", service)
    known = F.coalesce(F.col("x.sum.dataPoints"), F.col("x.gauge.dataPoints"))
    other = F.coalesce("x.histogram", "x.exponentialHistogram", "x.summary")
    whole = F.when(known.isNull() & other.isNotNull(), "unsupported metric type").when(known.isNull(), "metric has no recognised type").when(F.coalesce("x.name", F.lit("")) == "", "metric is missing a name")
    _, refused = _split(rows, whole, {})
    points = rows.where(whole.isNull()).select("path", "service", F.col("x.name").alias("name"), F.col("x.unit").alias("unit"), F.explode(known).alias("x"))
    at = _nanos(F.col("x.timeUnixNano"))
    count = F.when(F.col("x.asInt").rlike(r"^-?\d{1,19}$"), F.col("x.asInt").try_cast("bigint"))
    value = F.coalesce("x.asDouble", F.when(F.abs(count) < 2**53, count).cast("double"))
    bad = F.when(at.isNull(), "data point has an invalid timestamp").when(F.col("service").isNull(), NO_SERVICE).when(value.isNull() | F.isnan(value), "data point has no numeric value")
    signals, singles = _split(points, bad, {"name": F.col("name"), "unit": F.col("unit"), "ts_ms": _ms(at), "value": value, "attributes": attributes(F.col("x.attributes"))})
    return signals, refused.unionByName(singles)


def logs(documents: DataFrame, service: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, quarantine): log records; a severity that is neither empty nor known is quarantined."""
    rows = _items(documents, LOGS, "resourceLogs", "scopeLogs", "logRecords", service)
    at, raw = _nanos(F.col("x.timeUnixNano")), F.upper(F.trim(F.coalesce("x.severityText", F.lit(""))))
    level = F.coalesce(F.create_map(*[F.lit(v) for p in SEVERITIES.items() for v in p])[raw], text.severity(raw))
    bad = F.when(at.isNull(), "log record has an invalid timestamp").when(F.col("service").isNull(), NO_SERVICE).when((raw != "") & level.isNull(), F.concat(F.lit("invalid severity '"), F.col("x.severityText"), F.lit("'")))
    return _split(rows, bad, {"ts_ms": _ms(at), "severity": level, "body": F.coalesce(value_text(F.col("x.body")), F.lit("")), "attributes": attributes(F.col("x.attributes"))})


def judged_traces(documents: DataFrame, service: str | None = None) -> DataFrame:
    """(path, reason, signal, record): all spans in one reading of the documents, either with a signal or, where
    reason is not null, with the span as it was. The duration is the difference of both ends in whole milliseconds;
    an end before the start is quarantined even by a nanosecond."""
    rows = _items(documents, TRACES, "resourceSpans", "scopeSpans", "spans", service)
    start, end, code = _nanos(F.col("x.startTimeUnixNano")), _nanos(F.col("x.endTimeUnixNano")), F.col("x.status.code")
    empty = lambda f: F.coalesce(F.col(f"x.{f}"), F.lit("")) == ""
    status = F.create_map(*[F.lit(v) for p in STATUS.items() for v in p])[code]
    bad = (
        F.when(start.isNull() | end.isNull(), "span has an invalid start/end timestamp").when(F.col("service").isNull(), NO_SERVICE).when(end < start, "span has a negative duration")
        .when(empty("traceId"), "span has no trace id").when(empty("spanId"), "span has no span id").when(empty("name"), "span has no name")
        .when(code.isNotNull() & status.isNull(), F.concat(F.lit("invalid span status code '"), code, F.lit("'")))
    )
    fields = {"trace_id": F.col("x.traceId"), "span_id": F.col("x.spanId"), "parent": F.when(~empty("parentSpanId"), F.col("x.parentSpanId")), "name": F.col("x.name"), "ts_ms": _ms(start), "duration_ms": _ms(end) - _ms(start), "status": status}
    return _told(rows, bad, fields)


def traces(documents: DataFrame, service: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, quarantine) of judged_traces(); who needs both reads the documents once there, twice here."""
    told = judged_traces(documents, service)
    return told.where("reason IS NULL").select("path", "signal.*"), told.where("reason IS NOT NULL").select("path", "reason", "record")
