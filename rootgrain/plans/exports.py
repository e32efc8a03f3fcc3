"""Bundles as files: one table (path, content), each file put together from its ordered lines.

cases: (case_ord, case_id, system, inject_time, window_start, window_end, fault_type, category,
root_entity_id, component, reason, query, difficulty). signals: (case_id, signal_idx, signal, ts_ms,
service, pod, node, name, value, severity, body, trace_id, span_id, parent, duration_ms, status).
Cases without signals have no files. Lines are put together at the file's own task only, after
everything else is done by line.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from ..sources import answers

#: The columns of the contracts' tables.
OPENRCA = {
    "metric": ("timestamp", "cmdb_id", "kpi_name", "value"),
    "log": ("timestamp", "cmdb_id", "severity", "message"),
    "trace": ("timestamp", "trace_id", "span_id", "parent_span_id", "cmdb_id", "span_name", "duration_ms", "status"),
}
OPENRCA_TASKS = {"query": ("instruction_id", "query", "occurrence_window"), "record": ("instruction_id", "prediction"), "groundtruth": ("task_index", "instruction", "scoring_points")}
TRACES = ("time", "traceID", "spanID", "serviceName", "methodName", "operationName", "startTimeMillis", "startTime", "duration", "statusCode", "parentSpanID")
LOGS = {
    "RE2": ("time", "timestamp", "container_name", "message", "level", "req_path", "error", "cluster_id", "log_template"),
    "RE3": ("time", "timestamp", "container_name", "message", "pod_name", "node_name"),
}
#: Difficulty by level, and the categories of the exported answer keys.
DIFFICULTY = {"L1": "easy", "L2": "medium", "L3": "hard", "L4": "hard"}


def assemble(lines: DataFrame, header: str | None = None) -> DataFrame:
    """(path, content) of lines (path, ord, line): in order, each with a line feed, after the header."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    body = F.array_join(F.concat(F.array(F.lit(header)), ordered) if header is not None else ordered, "\n")
    return lines.groupBy("path").agg(F.concat(body, F.lit("\n")).alias("content"))


def local_time(ms: Column, offset_minutes: int = 480) -> Column:
    """YYYY-MM-DD HH:MM:SS on a clock of the given offset."""
    return F.regexp_replace(F.substring(times.iso_utc(ms + offset_minutes * 60_000), 1, 19), "T", " ")


def _table(rows: DataFrame, path: Column, order: list[Column], header: tuple[str, ...], cells: list[Column]) -> DataFrame:
    lines = rows.select(path.alias("path"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("ord"), text.csv_line(*cells).alias("line"))
    return assemble(lines, ",".join(header))


def openrca_telemetry(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """Metric, log and trace tables of each case, in order of their local time and then of arrival."""
    known = signals.join(cases.select("case_id", "system", times.iso_ms(F.col("inject_time")).alias("_inject")), "case_id")
    at, who = local_time(F.col("ts_ms")), F.coalesce("pod", "node", "service")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cells = {
        "metric": [at, who, F.col("name"), text.number(F.col("value"))],
        "log": [at, who, blank("severity"), blank("body")],
        "trace": [at, F.col("trace_id"), F.col("span_id"), blank("parent"), who, F.col("name"), text.number(F.col("duration_ms")), blank("status")],
    }
    day = F.regexp_replace(F.substring(local_time(F.col("_inject")), 1, 10), "-", "_")
    parts = []
    for kind, columns in OPENRCA.items():
        path = F.concat(text.path_token(F.col("system")), F.lit("/"), day, F.lit(f"/telemetry/{kind}/"), text.path_token(F.col("case_id")), F.lit(".csv"))
        parts.append(_table(known.where(F.col("signal") == kind), path, [at, F.col("signal_idx")], columns, cells[kind]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def openrca_answers(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """query.csv, record.csv and groundtruth.csv of each system, a row for each case with signals: what is
    asked, about which half hour, the answer as JSON, and the criteria that the answer is scored by."""
    at = times.iso_ms(F.col("inject_time"))
    when, component, reason = local_time(at), F.col("component"), F.col("reason")
    asked = F.coalesce(F.col("query"), F.lit("")) if "query" in cases.columns else F.lit("")
    rows = cases.join(signals.select("case_id").distinct(), "case_id", "left_semi")
    prediction = F.to_json(F.struct(F.struct(when.alias(answers.ROOT_KEYS["time"]), component.alias(answers.ROOT_KEYS["component"]), reason.alias(answers.ROOT_KEYS["reason"])).alias("1")))
    cells = {"query": [F.col("case_id"), asked, times.period(at)], "record": [F.col("case_id"), prediction], "groundtruth": [answers.task(when, component, reason), asked, answers.points_text(when, component, reason)]}
    system = text.path_token(F.col("system"))
    parts = [_table(rows, F.concat(system, F.lit(f"/{name}.csv")), [F.col("case_ord")], OPENRCA_TASKS[name], columns) for name, columns in cells.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rcaeval_path(suite: str) -> Column:
    """suite-system/service_fault/n, n counting the bundle's cases from 1 in their order."""
    return F.concat(F.lit(f"{suite}-"), text.path_token(F.col("system")), F.lit("/"), text.path_token(F.col("component")), F.lit("_"), text.path_token(F.col("fault_type")), F.lit("/"), F.col("case_n").cast("string"))


def _numbered(cases: DataFrame) -> DataFrame:
    # a case's number is its place in the bundle: the cases are few beside their signals
    return cases.withColumn("case_n", F.row_number().over(Window.orderBy("case_ord")))


def rcaeval(cases: DataFrame, signals: DataFrame, suite: str = "RE1") -> DataFrame:
    """data.csv with a column for each service and metric of the case and a row for each second, of equal
    cells the one that arrived last; inject_time.txt; and for RE2 and RE3 logs.csv and traces.csv."""
    placed = _numbered(cases).select("case_id", rcaeval_path(suite).alias("_dir"), times.iso_ms(F.col("inject_time")).alias("_inject"))
    if suite == "RE3":
        placed = _numbered(cases).where("category = 'code'").select("case_id", rcaeval_path(suite).alias("_dir"), times.iso_ms(F.col("inject_time")).alias("_inject"))
    known = signals.join(placed, "case_id")
    second = F.floor(F.col("ts_ms") / 1000).cast("bigint")
    points = known.where("signal = 'metric'").groupBy("_dir", second.alias("time"), F.concat_ws("_", "service", "name").alias("column")).agg(F.max_by("value", "signal_idx").alias("value"))
    columns = points.groupBy("_dir").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    cells = points.groupBy("_dir", "time").agg(F.map_from_entries(F.collect_list(F.struct("column", text.number(F.col("value"))))).alias("cells"))
    rows = cells.join(columns, "_dir").select("_dir", "time", F.array_join(F.concat(F.array(F.col("time").cast("string")), F.transform("columns", lambda c: F.coalesce(F.col("cells")[c], F.lit("")))), ",").alias("line"))
    heads = columns.select("_dir", F.lit(-(2**62)).alias("time"), F.array_join(F.concat(F.array(F.lit("time")), F.transform("columns", lambda c: text.csv_cell(c))), ",").alias("line"))
    data = assemble(rows.unionByName(heads).select(F.concat("_dir", F.lit("/data.csv")).alias("path"), F.col("time").alias("ord"), "line"))
    inject = known.select("_dir", "_inject").distinct().select(F.concat("_dir", F.lit("/inject_time.txt")).alias("path"), F.concat(F.floor(F.col("_inject") / 1000).cast("string"), F.lit("\n")).alias("content"))
    out = data.unionByName(inject)
    if suite in LOGS:
        minute = F.substring(times.iso_utc(F.col("ts_ms")), 12, 5)
        nanos = (F.col("ts_ms") * 1_000_000).cast("string")
        where = F.coalesce("pod", "service")
        empty = F.lit("")
        rest = [F.coalesce("severity", empty), empty, empty, empty, empty] if suite == "RE2" else [F.coalesce("pod", empty), F.coalesce("node", empty)]
        out = out.unionByName(_table(known.where("signal = 'log'"), F.concat("_dir", F.lit("/logs.csv")), [F.col("ts_ms"), F.col("signal_idx")], LOGS[suite], [minute, nanos, where, F.coalesce("body", empty), *rest]))
        micros = F.floor(F.col("duration_ms") * 1000 + 0.5).cast("bigint").cast("string")
        out = out.unionByName(_table(known.where("signal = 'trace'"), F.concat("_dir", F.lit("/traces.csv")), [F.col("ts_ms"), F.col("signal_idx")], TRACES, [minute, F.col("trace_id"), F.col("span_id"), F.col("service"), F.col("name"), F.col("name"), F.col("ts_ms").cast("string"), (F.col("ts_ms") * 1000).cast("string"), micros, F.coalesce("status", empty), F.coalesce("parent", empty)]))
    return out


def _json_files(rows: DataFrame, path: Column, value: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.concat(F.to_json(value), F.lit("\n")).alias("content"))


def difficulty(level: Column) -> Column:
    """easy, medium or hard; medium without a known level."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in DIFFICULTY.items() for x in p])[level], F.lit("medium"))


def causal_paths(cases: DataFrame, signals: DataFrame, steps: DataFrame, entities: DataFrame) -> DataFrame:
    """cases/<id>/causal_path.json of cases with signals and a known root: the steps of each case in
    order with the names of both ends and the evidence. steps: (case_id, step, from_entity, to_entity,
    mechanism, evidence)."""
    names = entities.select("entity_id", "name")
    told = steps.join(names.toDF("from_entity", "_from"), "from_entity", "left").join(names.toDF("to_entity", "_to"), "to_entity", "left")
    step = F.struct("step", F.coalesce("_from", "from_entity").alias("from"), F.coalesce("_to", "to_entity").alias("to"), "mechanism", "evidence")
    paths = told.groupBy("case_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = cases.join(signals.select("case_id").distinct(), "case_id", "left_semi").join(names.select(F.col("entity_id").alias("root_entity_id"), F.col("name").alias("root")), "root_entity_id").join(paths, "case_id", "left")
    return _json_files(rows, F.concat(F.lit("cases/"), text.path_token(F.col("case_id")), F.lit("/causal_path.json")), F.struct("case_id", "root", F.coalesce("steps", F.array().cast(paths.schema["steps"].dataType)).alias("steps")))


def modalities(cases: DataFrame, signals: DataFrame, entities: DataFrame) -> DataFrame:
    """<case>/<kind>.json for each kind of signal, with the entity of each signal: that of the pod, else
    of the node, else of the service. A case with a signal of no entity is left out whole."""
    keys = entities.select("entity_id", F.explode(F.array_distinct(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))).alias("k"))
    one = keys.groupBy("k").agg(F.max("entity_id").alias("entity_id"))
    found = signals.join(cases.select("case_id"), "case_id", "left_semi")
    for part in ("pod", "node", "service"):
        found = found.join(one.toDF(part, f"_{part}"), part, "left")
    found = found.withColumn("entity", F.coalesce("_pod", "_node", "_service"))
    whole = found.groupBy("case_id").agg(F.count_if(F.col("entity").isNull()).alias("dangling")).where("dangling = 0").select("case_id")
    row = F.struct("signal_idx", "entity", times.iso_utc(F.col("ts_ms")).alias("timestamp"), "name", "value", "severity", "body", "trace_id", "span_id", "parent", "duration_ms", "status")
    lines = found.join(whole, "case_id").select(F.concat(text.path_token(F.col("case_id")), F.lit("/"), F.col("signal"), F.lit(".jsonl")).alias("path"), F.col("signal_idx").alias("ord"), F.to_json(row).alias("line"))
    return assemble(lines)


def topology(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """topology.json lines: entities and edges, an end that no entity has being external."""
    known = entities.select("entity_id", "kind")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct().join(known, "entity_id", "left_anti").select("entity_id", F.lit("external").alias("kind"))
    nodes = known.unionByName(ends).select(F.lit("topology.jsonl").alias("path"), F.struct(F.lit(0).alias("part"), F.col("entity_id").alias("a"), F.lit("").alias("b")).alias("ord"), F.to_json(F.struct("entity_id", "kind")).alias("line"))
    links = edges.select(F.lit("topology.jsonl").alias("path"), F.struct(F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("ord"), F.to_json(F.struct("src", "dst", "relation")).alias("line"))
    return assemble(nodes.unionByName(links))


def answer_keys(cases: DataFrame, target: str) -> DataFrame:
    """One file of JSON lines with the answer of each case, in the fields that the target scores."""
    fields = {
        "aiops2025": [F.col("case_id").alias("uuid"), F.col("category").alias("fault_category"), F.col("component").alias("instance"), F.col("fault_type"), F.col("inject_time").alias("start_time"), F.col("window_end").alias("end_time")],
        "cloud-opsbench": [F.col("case_id"), F.col("component"), F.col("fault_type"), F.col("category"), difficulty(F.col("difficulty")).alias("difficulty")],
        "itbench": [F.col("case_id").alias("scenario"), F.col("component").alias("root_cause"), F.col("fault_type").alias("fault"), difficulty(F.col("difficulty")).alias("complexity")],
        "rca100": [F.col("case_id").alias("task_id"), F.col("root_entity_id").alias("root_cause"), F.col("fault_type"), F.col("query").alias("question")],
    }
    if target not in fields:
        raise ValueError(f"unknown target {target!r}; one of {', '.join(fields)}")
    return assemble(cases.select(F.lit(f"{target}/groundtruth.jsonl").alias("path"), F.col("case_ord").alias("ord"), F.to_json(F.struct(*fields[target])).alias("line")))


def write(files: DataFrame, path: str) -> None:
    """Each file's content under path, in a partition named after it, so that any store will do."""
    files.select("content", F.col("path").alias("file")).write.partitionBy("file").option("lineSep", "").text(path)
