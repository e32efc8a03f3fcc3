"""Checks of an exported set of files: the tables that its contract names, their columns, and no answer in a task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import answers, delimited
from ..sources.shared import kept
from .exports import OPENRCA, OPENRCA_TASKS

#: Fixed value: what only an answer says.
ANSWER = "(?i)root cause component|root cause reason|root cause occurrence"


def _kind(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name in OPENRCA_TASKS:
        out = out.when(path.endswith(f"/{name}.csv"), name)
    for name in OPENRCA:
        out = out.when(path.contains(f"/telemetry/{name}/"), name)
    return out


def repeated_answers(records: DataFrame) -> DataFrame:
    """records (kind, line, record) of query and record files -> (instruction_id, column) of the cells of a
    task that are a value of its answer. Of answers with one id the last one counts."""
    column = lambda name: F.coalesce(F.col("record")[name], F.lit(""))
    keyed = records.withColumn("instruction_id", F.trim(column("instruction_id")))
    last = keyed.where("kind = 'record'").groupBy("instruction_id").agg(F.max_by(column("prediction"), F.struct("path", "line")).alias("prediction"))
    values = last.select("instruction_id", F.explode(answers.predicted_roots(F.col("prediction"))).alias("r")).select("instruction_id", F.explode(F.array("r.component", "r.reason", "r.time")).alias("cell"))
    cells = keyed.where("kind = 'query'").select("instruction_id", F.explode("record").alias("column", "cell")).where("column != 'instruction_id'")
    trimmed = lambda df: df.withColumn("cell", F.trim("cell")).where("cell != ''")
    return trimmed(cells).join(trimmed(values), ["instruction_id", "cell"], "left_semi").select("instruction_id", "column")


def openrca(files: DataFrame) -> DataFrame:
    """files (path, content) -> (check, passed), fourteen of them. Of several files of a kind the first
    path's header is checked. Files and their rows are counted in one aggregate; cells of tasks meet values of
    answers by case and text."""
    # read three times below, put together once; of telemetry only the header is looked at
    kind = _kind(F.col("path"))
    content = F.when(kind.isin(*OPENRCA_TASKS), F.col("content"))
    known = kept(files.select("path", kind.alias("kind"), F.substring_index("content", "\n", 1).alias("head"), content.alias("content")).where("kind IS NOT NULL"), "exported")
    tables = known.where(F.col("kind").isin(*OPENRCA_TASKS))
    kinds = tables.select("path", "kind")
    # read three times below, parsed once
    records = kept(delimited.records(delimited.rows(tables)).where("error IS NULL").join(kinds, "path").select("path", "line", "kind", "record"), "structure")
    points = answers.scoring_points(F.col("record")["scoring_points"])
    empty = (F.col("kind") == "groundtruth") & (F.size(points["components"]) + F.size(points["reasons"]) + F.size(points["times"]) == 0)
    facts = known.select("kind", "path", "head", F.lit(0).alias("n_rows"), F.lit(0).alias("n_empty"), ((F.col("kind") == "query") & F.col("content").rlike(ANSWER)).alias("told"))
    facts = facts.unionByName(records.select("kind", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("head"), F.lit(1).alias("n_rows"), empty.cast("int").alias("n_empty"), F.lit(False).alias("told")))

    of = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    there = lambda kind: F.count(of(kind, "path")) > 0
    header = lambda kind, names: F.min_by(of(kind, "head"), of(kind, "path")) == ",".join(names)
    rows = lambda kind: F.coalesce(F.sum(of(kind, "n_rows")), F.lit(0))
    checks = {
        "query-csv": there("query"), "record-csv": there("record"), "query-header": header("query", OPENRCA_TASKS["query"]), "record-header": header("record", OPENRCA_TASKS["record"]),
        "answer-key-isolated": ~F.coalesce(F.bool_or("told"), F.lit(False)), "telemetry-present": there("metric") | there("log") | there("trace"), "metric-header": header("metric", OPENRCA["metric"]),
        "log-header": ~there("log") | header("log", OPENRCA["log"]), "trace-header": ~there("trace") | header("trace", OPENRCA["trace"]), "groundtruth-csv": there("groundtruth"), "groundtruth-header": header("groundtruth", OPENRCA_TASKS["groundtruth"]),
        "scoring-points-present": there("groundtruth") & (F.coalesce(F.sum("n_empty"), F.lit(0)) == 0), "row-alignment": rows("groundtruth") == rows("record"),
    }
    counted = facts.agg(*[F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()])
    told = counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("passed")) for name in checks])).alias("c")).select("c.*")
    leaks = repeated_answers(records).agg((F.count("*") == 0).alias("passed"))
    return told.unionByName(leaks.select(F.lit("task-carries-no-scored-value").alias("check"), "passed"))
