"""Records to signals: layout detection and the three-way split of what was read.

Every record ends in exactly one of three places: signals, quarantine with the first reason in a
fixed order, or missing, where the value itself says that there was none.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..functions.vocab import COLUMN_ALIASES, SPAN_STATUSES
from ..operators.rules import NUMERIC

#: Texts that say that a sample is missing.
MISSING = ("NaN", "nan")
#: Fields by kind of signal, beside those that all kinds have.
COMMON = ("timestamp", "service", "pod_name", "node_name")
FIELDS = {
    "metric": ("metric_name", "metric_value"),
    "log": ("log_body", "severity"),
    "trace": ("trace_id", "span_id", "parent_span_id", "span_name", "duration_ms", "status"),
}


def plain(name: str) -> str:
    """A header as it is compared: lower case, without white space and _ - . @"""
    return re.sub(r"[\s_\-.@]", "", name.lower())


def detect_layout(headers: list[str], kind: str) -> dict[str, str]:
    """field -> header, the first header that is one of the field's names. Fields without one are left out."""
    known = [(h, plain(h)) for h in headers]
    out = {}
    for field in (*COMMON, *FIELDS[kind]):
        names = {plain(a) for a in COLUMN_ALIASES[field]}
        if found := next((h for h, p in known if p in names), None):
            out[field] = found
    return out


def _cell(column: Column) -> Column:
    trimmed = F.btrim(column, F.lit(times.BLANKS))
    return F.when(trimmed != "", trimmed)


def _by_file(layout: Column, offset: Column, readings: list[tuple[str, int | None]], text: Column) -> Column:
    """The time of a text as its own file's layout and offset have it; both are columns."""
    out = F.when(F.lit(False), times.parse(text, "iso8601"))
    for name, minutes in readings:
        out = out.when((layout == name) & offset.eqNullSafe(F.lit(minutes).cast("int")), times.parse(text, name, minutes))
    return out


def classify(records: DataFrame, kind: str, layout: dict[str, str] | Column, time_layout: str | Column = "iso8601", assume_offset_minutes: int | Column | None = None, service: str | Column | None = None, aliases: dict[str, str] | Column | None = None, duration_unit: str = "ms", readings: list[tuple[str, int | None]] = ()) -> DataFrame:
    """records (path, line, record, error) with `outcome` (signal, missing or quarantine), `reason` and
    `signal`, a struct of all fields of the kind. The reason is the first in the order: unreadable
    record, timestamp, service, then the kind's own fields. layout, time layout, offset, service and
    aliases may be columns, where files differ: then readings lists the pairs of layout and offset."""
    each, fields = isinstance(layout, Column), (*COMMON, *FIELDS[kind])
    if each:  # what a file's layout leads to is found once for each record
        held = records.withColumn("_head", F.struct(*[F.coalesce(F.try_element_at(layout, F.lit(f)), F.lit("(none)")).alias(f) for f in fields]))
        held = held.withColumn("_raw", F.struct(*[F.try_element_at("record", F.col("_head")[f]).alias(f) for f in fields]))
        held = held.withColumn("_cell", F.struct(*[_cell(F.col("_raw")[f]).alias(f) for f in fields]))
        header, raw, cell = (lambda f: F.col("_head")[f]), (lambda f: F.col("_raw")[f]), (lambda f: F.col("_cell")[f])
    else:
        held = records
        header = lambda f: F.lit(layout.get(f, "(none)"))
        raw = lambda f: F.col("record")[layout[f]] if f in layout else F.lit(None).cast("string")
        cell = lambda f: _cell(raw(f))
    required = lambda f, what: F.concat(F.lit("missing required column '"), header(f), F.lit(f"' ({what})"))
    absent = lambda f, what: F.when(cell(f).isNull(), required(f, what))
    at = _by_file(time_layout, assume_offset_minutes, readings, cell("timestamp")) if isinstance(time_layout, Column) else times.parse(cell("timestamp"), time_layout, assume_offset_minutes)
    declared = F.coalesce(cell("service"), service if isinstance(service, Column) else F.lit(service))
    known = aliases if isinstance(aliases, Column) or not aliases else F.create_map(*[F.lit(x) for p in aliases.items() for x in p])
    name = F.coalesce(F.try_element_at(known, declared), declared) if known is not None and not isinstance(known, dict) else declared
    checks = [F.col("error"), absent("timestamp", "timestamp"), F.when(at["ms"].isNull(), "timestamp cannot be read"), F.when(F.coalesce(declared, F.lit("")) == "", "missing service name")]
    fields = {"ts_ms": at["ms"], "offset_minutes": at["offset_minutes"], "service": name, "pod": cell("pod_name"), "node": cell("node_name")}
    missing = F.lit(False)
    if kind == "metric":
        value = cell("metric_value")
        missing = F.coalesce(value.isin(*MISSING), F.lit(False))
        number = F.when(value.rlike(NUMERIC), value.try_cast("double"))
        finite = number.isNotNull() & ~number.isin(float("inf"), float("-inf"))
        checks += [absent("metric_name", "metric name"), absent("metric_value", "metric value"), F.when(~missing & ~F.coalesce(finite, F.lit(False)), F.concat(F.lit("metric value '"), value, F.lit("' is not a finite number")))]
        fields |= {"name": cell("metric_name"), "value": number}
    elif kind == "log":
        level = text.severity(cell("severity"))
        checks += [F.when(raw("log_body").isNull(), required("log_body", "log body")), F.when(cell("severity").isNotNull() & level.isNull(), F.concat(F.lit("invalid severity '"), cell("severity"), F.lit("'")))]
        fields |= {"body": F.coalesce(cell("log_body"), F.lit("")), "severity": level}
    else:
        duration = F.when(cell("duration_ms").rlike(NUMERIC), cell("duration_ms").try_cast("double"))
        status = F.upper(cell("status"))
        checks += [absent(f, w) for f, w in (("trace_id", "trace id"), ("span_id", "span id"), ("span_name", "span name"), ("duration_ms", "span duration"))]
        checks += [F.when(~F.coalesce(duration >= 0, F.lit(False)), F.concat(F.lit("span duration '"), cell("duration_ms"), F.lit("' is not a non-negative number"))), F.when(status.isNotNull() & ~status.isin(*SPAN_STATUSES), F.concat(F.lit("invalid span status '"), cell("status"), F.lit("'")))]
        fields |= {f: cell(f) for f in ("trace_id", "span_id", "parent_span_id", "span_name")} | {"duration_ms": duration / (1000 if duration_unit == "us" else 1), "status": status}
    reason = F.coalesce(*checks)
    outcome = F.when(reason.isNotNull(), "quarantine").when(missing, "missing").otherwise("signal")
    signal = F.when(outcome == "signal", F.struct(*[c.alias(k) for k, c in fields.items()]))
    return held.select(*records.columns, outcome.alias("outcome"), reason.alias("reason"), signal.alias("signal"))


def ingest(records: DataFrame, kind: str, layout: dict[str, str], **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, quarantine, missing) of classify(): together they have the rows of records."""
    told = classify(records, kind, layout, **how)
    keep = [c for c in records.columns if c not in ("record", "error")]
    return told.where("outcome = 'signal'").select(*keep, "signal.*"), told.where("outcome = 'quarantine'").select(*keep, "reason", "record"), told.where("outcome = 'missing'").select(*keep, "record")


def kind_of_path(path: Column) -> Column:
    """metric, log or trace by the words of a path's folders, else of its file name; null without any."""
    parts = F.split(F.lower(path), "/")
    folders, stem = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    word = lambda c, k: F.exists(F.split(c, "[^a-z]+"), lambda w: w.isin(k, k + "s"))
    out = F.when(F.lit(False), "")
    for k in ("trace", "log", "metric"):
        out = out.when(word(F.concat_ws("/", folders), k), k)
    for k in ("trace", "log", "metric"):
        out = out.when(word(stem, k), k)
    return out


def route(paths: DataFrame, cases: DataFrame) -> DataFrame:
    """(path, case_id) for paths (path) and cases (case_ord, case_id, prefix): the first case, in their
    order, whose prefix the path begins with. A null prefix takes what no other case does; paths that
    nobody claims have a null case. A path is joined on its own beginnings, so that the number of cases
    does not matter."""
    starts = paths.select("path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("_n")).select("path", F.expr("substring(path, 1, _n)").alias("prefix"))
    first = starts.join(cases.where("prefix IS NOT NULL").groupBy("prefix").agg(F.min(F.struct("case_ord", "case_id")).alias("_c")), "prefix").groupBy("path").agg(F.min("_c")["case_id"].alias("case_id"))
    rest = cases.where("prefix IS NULL").agg(F.min_by("case_id", "case_ord").alias("_rest"))  # one row
    return paths.join(first, "path", "left").crossJoin(F.broadcast(rest)).select("path", F.coalesce("case_id", "_rest").alias("case_id"))
