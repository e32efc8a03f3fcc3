"""Readers of published answers: scoring points, predicted roots, and labels that are paths."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grading import assigned_scores
from ..operators.scoring import time_matches
from . import delimited

#: Sentences that state one criterion each.
COMPONENT = "The {idx} predicted root cause component is "
REASON = "The {idx} predicted root cause reason is "
TIME = "The {idx} root cause occurrence time is within 1 minutes (i.e., <=1min) of "
#: Tasks by what is asked (time, component, reason).
TASKS = {
    (True, False, False): "task_1", (False, False, True): "task_2", (False, True, False): "task_3", (True, False, True): "task_4",
    (True, True, False): "task_5", (False, True, True): "task_6", (True, True, True): "task_7",
}
#: Keys of a predicted root.
ROOT_KEYS = {"component": "root cause component", "reason": "root cause reason", "time": "root cause occurrence datetime"}


def _stated(text: Column, sentence: str) -> Column:
    before, after = sentence.split("{idx}")
    escaped = "".join("\\" + c if c in "().<=" else c for c in after)
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{before}(?:\d+-th|only){escaped}([^\n]+)"), F.lit(1)), lambda s: F.trim(s))


def scoring_points(text: Column) -> Column:
    """struct(components, reasons, times) of a text of criteria, each in order."""
    known = F.coalesce(text, F.lit(""))
    return F.struct(_stated(known, COMPONENT).alias("components"), _stated(known, REASON).alias("reasons"), _stated(known, TIME).alias("times"))


def task(time: Column, component: Column, reason: Column) -> Column:
    """The task that asks for the parts which are not blank; without any it is the first."""
    there = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in (time, component, reason)]
    out = F.when(F.lit(False), "")
    for asked, name in TASKS.items():
        same = [t if a else ~t for t, a in zip(there, asked, strict=True)]
        out = out.when(same[0] & same[1] & same[2], name)
    return out.otherwise("task_1")


def points_text(time: Column, component: Column, reason: Column, idx: str = "only") -> Column:
    """The criteria of one root, a line each: the parts that are not blank; without any, the time's."""
    line = lambda sentence, part: F.concat(F.lit(sentence.replace("{idx}", idx)), F.coalesce(part, F.lit("")), F.lit("\n"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    nothing = blank(time) & blank(component) & blank(reason)
    return F.concat(F.when(~blank(time) | nothing, line(TIME, time)).otherwise(""), F.when(~blank(component), line(COMPONENT, component)).otherwise(""), F.when(~blank(reason), line(REASON, reason)).otherwise(""))


def predicted_roots(text: Column) -> Column:
    """array of struct(component, reason, time) of a JSON text: its objects with numbers for keys in their
    order, else the object itself; none where it is no object. What is not a text is empty."""
    value = F.try_parse_json(text)
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def root(v: Column) -> Column:
        part = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant")) == "STRING", F.try_variant_get(v, f"$['{key}']", "string"))
        return F.struct(*[F.coalesce(part(key), F.lit("")).alias(name) for name, key in ROOT_KEYS.items()])

    entries = F.map_entries(F.when(is_object(value), value.cast("map<string,variant>")))
    numbered = F.filter(entries, lambda e: e["key"].rlike(r"^\d+$") & is_object(e["value"]))
    ordered = F.transform(F.array_sort(F.transform(numbered, lambda e: F.struct(e["key"].cast("decimal(38,0)").alias("n"), e["key"].alias("k"), root(e["value"]).alias("r")))), lambda x: x["r"])
    return F.when(is_object(value), F.when(F.size(numbered) > 0, ordered).otherwise(F.array(root(value)))).otherwise(F.array().cast("array<struct<component:string,reason:string,time:string>>"))


def true_roots(points: Column) -> Column:
    """Scoring points as array of struct(component, reason, time), as many as the longest list has; null
    for what a root's list does not state."""
    lists = {"component": points["components"], "reason": points["reasons"], "time": points["times"]}
    count = F.greatest(*[F.size(x) for x in lists.values()])
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(*[F.get(x, i).alias(name) for name, x in lists.items()]))


def _numbered(files: DataFrame, name: str) -> DataFrame:
    """(folder, n, record): the records of the files of one name, by their place in the file."""
    read = delimited.records(delimited.rows(files.where(F.col("path").endswith("/" + name)))).where("error IS NULL")
    place = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return read.select(F.expr(f"left(path, length(path) - {len(name) + 1})").alias("folder"), place.alias("n"), "record")


def root_answers(files: DataFrame) -> DataFrame:
    """(folder, n, case_id, points, roots): the truth of each row of a groundtruth.csv, and the prediction
    of the row of record.csv at its place; a case without an id there is `row-n`, one without a prediction
    has no roots."""
    truth = _numbered(files, "groundtruth.csv").select("folder", "n", F.coalesce(F.col("record")["scoring_points"], F.lit("")).alias("_points"))
    record = _numbered(files, "record.csv").select("folder", "n", F.col("record")["instruction_id"].alias("_id"), F.col("record")["prediction"].alias("_prediction"))
    both = truth.join(record, ["folder", "n"], "left")
    return both.select("folder", "n", F.coalesce("_id", F.concat(F.lit("row-"), F.col("n").cast("string"))).alias("case_id"), scoring_points(F.col("_points")).alias("points"), predicted_roots(F.col("_prediction")).alias("roots"))


def root_scores(files: DataFrame) -> DataFrame:
    """(folder, n, case_id, score): the share of the criteria that the best assignment of roots earns."""
    answers = root_answers(files).withColumn("_truth", true_roots(F.col("points")))
    return assigned_scores(answers, "roots", "_truth", time_matches).select("folder", "n", "case_id", "score")


def case_path(path: Column) -> Column:
    """struct(suite, system, service, fault, instance) of `RE1-system/service_fault/1`, cut at the first
    underscore; null for any other path."""
    pattern = r"^/*(RE[123])-([A-Za-z0-9-]+)/+([^/_]+)_([^/]+)/+(\d+)/*$"
    parts = [F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(("suite", "system", "service", "fault", "instance"))]
    return F.when(path.rlike(pattern), F.struct(*parts))


def case_directory(name: Column) -> Column:
    """struct(suite, service, fault, instance) of `RE1-service-fault_1`, cut at the last hyphen; null for
    any other name."""
    pattern = r"^(RE[123])-(.*)-([A-Za-z0-9]+)_(\d+)$"
    parts = [F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(("suite", "service", "fault", "instance"))]
    return F.when(name.rlike(pattern), F.struct(*parts))


def loader_label(path: Column) -> Column:
    """struct(fault_kind, service, fault) as a loader reads a folder: the middle one of three parts, cut at
    its only underscore. fault_kind is `shape` for another number of parts, `unpack` for another number of
    names, else null."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    names = F.split(F.get(parts, F.lit(1)), "_")
    kind = F.when(F.size(parts) != 3, "shape").when(F.size(names) != 2, "unpack")
    return F.struct(kind.alias("fault_kind"), F.when(kind.isNull(), names[0]).alias("service"), F.when(kind.isNull(), names[1]).alias("fault"))
