"""Whole benchmark datasets by a descriptor: which files belong to which case, how each is read, what came of it.

The descriptor is data. cases: case_ord, case_id, component, fault_type, fault_category, inject_time,
window_start, window_end, prefixes. specs: case_id, path and OPTIONS, how a case reads one file; null
where it is not said. files: path, content. entities and edges are those that somebody vouches for, as
in operators.graph, less their ordinals.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, times
from ..functions.vocab import COLUMN_ALIASES, EDGE_RELATIONS, FAULT_CATEGORIES
from ..operators import graph
from . import delimited, signals
from .shared import kept

#: Datasets, formats by file ending, names of folders and files by kind of signal, columns that a kind needs.
DATASETS = ("rcaeval", "openrca-1.0", "openrca-2.0", "rca100", "aiops2025", "cloud-opsbench", "itbench")
FORMATS = {"csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json"}
FOLDERS = {"trace": ("traces", "trace", "spans", "span"), "log": ("logs", "log"), "metric": ("metrics", "metric")}
STEMS = {"metric": ("metrics", "metric"), "log": ("logs", "log"), "trace": ("traces", "trace", "spans")}
REQUIRED = {"metric": ("timestamp", "metric_name", "metric_value"), "log": ("timestamp", "log_body"), "trace": ("timestamp", "trace_id", "span_id", "span_name", "duration_ms")}
LEAD_MS = 600_000

OPTIONS = {
    "format": "string", "signal_kind": "string", "layout": "map<string,string>", "time_layout": "string", "assume_offset_minutes": "int", "delimiter": "string", "has_header": "boolean", "service_name": "string",
    "service_aliases": "map<string,string>",
}


@dataclass
class Ingested:
    """signals: a table for each kind (case_id, path, line and its fields). quarantine (case_id, path, line,
    reason, record), line 0 where a whole file could not be read. report: a row for each case, in which
    signals + quarantined + missing are the records read. unclaimed: paths of no case. cases: with fault
    type and category, window and root_entity_id. entities, edges: the graph. problems (code, case_id,
    told): what makes the dataset unsound; hard_errors (case_id, code): noFiles, or everyFileRejected."""

    signals: dict[str, DataFrame]
    quarantine: DataFrame
    report: DataFrame
    unclaimed: DataFrame
    cases: DataFrame
    entities: DataFrame
    edges: DataFrame
    problems: DataFrame
    hard_errors: DataFrame


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1))


def kind_of_file(path: Column) -> Column:
    """The kind that a whole part of the path names, else its file name without its ending; null without any."""
    parts = F.split(F.lower(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    out = F.when(F.lit(False), "")
    for kind, names in FOLDERS.items():
        out = out.when(F.arrays_overlap(parts, F.array(*map(F.lit, names))), kind)
    for kind, names in STEMS.items():
        out = out.when(stem.isin(*names), kind)
    return out


def layout_of(headers: Column, kind: Column) -> Column:
    """A map from the fields of the kind to the first header that is one of a field's names."""
    plain = lambda h: F.regexp_replace(F.lower(h), r"[\s_\-.@]", "")
    found = lambda f: F.get(F.filter(headers, lambda h: plain(h).isin(*{signals.plain(a) for a in COLUMN_ALIASES[f]})), F.lit(0))
    out = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for name, own in signals.FIELDS.items():
        pairs = F.array(*[F.struct(F.lit(f).alias("k"), found(f).alias("v")) for f in (*signals.COMMON, *own)])
        out = out.when(headers.isNotNull() & (kind == name), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))
    return out


def problems(dataset: str, system: str, cases: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, case_id, told): what is wrong with the descriptor itself. blankSystem, unknownDataset, noCases,
    blankCase, duplicateCase, noComponent, badInstant, noFaultType, badCategory, blankEntity, blankName,
    blankAlias, unknownRelation."""
    spark = cases.sparkSession
    row = T.StructType([T.StructField(c, T.StringType()) for c in ("code", "case_id", "told")])
    own = [("blankSystem", None, system)] * (not system.strip()) + [("unknownDataset", None, dataset)] * (dataset not in DATASETS)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    issue = lambda when, code, told: F.when(when, F.struct(F.lit(code).alias("code"), F.col(told).cast("string").alias("told")))
    found = F.array(
        issue(blank("case_id"), "blankCase", "case_ord"), issue(blank("component"), "noComponent", "component"), issue(~F.coalesce(F.col("inject_time").rlike(times.ISO_UTC), F.lit(False)), "badInstant", "inject_time"),
        issue(text.fault_type(F.coalesce("fault_type", F.lit(""))) == "", "noFaultType", "fault_type"), issue(~F.col("fault_category").isin(*FAULT_CATEGORIES), "badCategory", "fault_category"),
    )
    of_cases = cases.select("case_id", F.explode(F.array_compact(found)).alias("p")).select("p.code", "case_id", "p.told")
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicateCase").alias("code"), "case_id", F.col("n").cast("string").alias("told"))
    none = cases.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("noCases").alias("code"), F.lit(None).cast("string").alias("case_id"), F.lit("").alias("told"))
    no_case = F.lit(None).cast("string").alias("case_id")
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) == "")
    named = F.array(issue(blank("entity_id"), "blankEntity", "name"), issue(blank("name"), "blankName", "entity_id"), issue(alias, "blankAlias", "entity_id"))
    of_entities = entities.select(F.explode(F.array_compact(named)).alias("p")).select("p.code", no_case, "p.told")
    of_edges = edges.where(~F.coalesce(F.col("relation").isin(*EDGE_RELATIONS), F.lit(False))).select(F.lit("unknownRelation").alias("code"), no_case, F.col("relation").alias("told"))
    return reduce(DataFrame.unionByName, [spark.createDataFrame(own, row), of_cases, twice, none, of_entities, of_edges])


def _resolved(files: DataFrame, routed: DataFrame, specs: DataFrame, defaults: dict) -> DataFrame:
    """(case_id, path, content, options, refused): each file's options, those of its case's spec first, then the
    defaults, then what path and header tell; refused says why it cannot be read."""
    own = specs.groupBy("case_id", "path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in OPTIONS])
    told = files.join(routed.where("case_id IS NOT NULL"), "path").join(own, ["case_id", "path"], "left")

    def default(c: str) -> Column:
        value = defaults.get(c)
        if isinstance(value, dict):
            return F.create_map(*[F.lit(x) for p in value.items() for x in p]).cast(OPTIONS[c])
        return F.lit(value).cast(OPTIONS[c])

    told = told.withColumns({c: F.coalesce(c, default(c)) for c in OPTIONS})
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n"), "^﻿", "")
    known = F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p])
    told = told.withColumns({"content": clean, "format": F.coalesce("format", F.try_element_at(known, ending(F.col("path")))), "signal_kind": F.coalesce("signal_kind", kind_of_file(F.col("path")))})
    cut = F.coalesce("delimiter", F.when(F.col("format") == "tsv", "\t").otherwise(","))
    return told.withColumns({"delimiter": cut, "time_layout": F.coalesce("time_layout", F.lit("iso8601")), "has_header": F.coalesce("has_header", F.lit(True))})


def _records(told: DataFrame) -> DataFrame:
    """(case_id, path, line, record, error, header): the records of all files by their formats; header is what a
    layout can be inferred from. Each file also has a row of line 0 without record and error."""
    keyed = told.select(F.concat_ws("\x1f", "case_id", "path").alias("path"), "content", "delimiter", "format", "has_header")
    cells = kept(delimited.rows(keyed.where("format IN ('csv', 'tsv')"), F.col("delimiter")), "cells")
    with_head = keyed.where("format IN ('csv', 'tsv') AND has_header").select("path")
    headed = delimited.records(cells.join(with_head, "path", "left_semi"))
    bare = cells.join(with_head, "path", "left_anti")
    columns = F.map_from_entries(F.transform("cells", lambda c, i: F.struct(F.concat(F.lit("col_"), i.cast("string")), c)))
    headless = bare.select("path", "line", F.when(F.col("error").isNull(), columns).alias("record"), "error")
    lines = delimited.json_lines(keyed.where("format = 'jsonl'")).unionByName(delimited.json_array(keyed.where("format = 'json'")))
    heads = cells.where("cells IS NOT NULL").groupBy("path").agg(F.min_by("cells", "line").alias("header"))
    first = lines.groupBy("path").agg(F.min_by(F.map_keys("record"), "line").alias("header"))
    none = F.lit(None)
    marks = keyed.select("path", F.lit(0).alias("line"), none.cast("map<string,string>").alias("record"), none.cast("string").alias("error"))
    rows = headed.unionByName(headless).unionByName(lines).unionByName(marks).join(heads.unionByName(first), "path", "left")
    split = F.split("path", "\x1f", 2)
    return rows.select(split[0].alias("case_id"), split[1].alias("path"), "line", "record", "error", F.transform("header", lambda h: F.trim(h)).alias("header"))


def ingest(files: DataFrame, cases: DataFrame, specs: DataFrame, dataset: str, system: str, entities: DataFrame, edges: DataFrame, defaults: dict | None = None, lead_ms: int = LEAD_MS, lag_ms: int | None = None) -> Ingested:
    """Read a dataset whole. A file goes to the first case, in their order, of which a prefix begins its path, or
    to the first case without prefixes; a case's spec of the file decides how it is read before the
    defaults (by option), and where neither says so, path and header do. Files that cannot be read are
    quarantined as a whole (line 0), records by themselves with their reason.

    The graph has the entities given, a service of the system for each service of a signal, and the
    edges given, once each and none from an entity to itself. A case's window is lead_ms before its
    injection to lag_ms after it (lead_ms where not given), unless it has one. A component has to be a
    service of a signal or of the entities: else the case is a problem (unvouchedRoot), as it is where
    the name answers to several entities (ambiguousRoot), and an edge with an end that is none
    (danglingEdge) or blank (emptyEdge). noFiles is told where there is none at all.

    All files are read in one pass for each format; a file is one row, its records are not.
    """
    defaults, lag_ms = defaults or {}, lead_ms if lag_ms is None else lag_ms
    spark = cases.sparkSession
    prefixes = F.when(F.size(F.coalesce("prefixes", F.array().cast("array<string>"))) > 0, F.col("prefixes"))
    routed = kept(signals.route(files.select("path").distinct(), cases.select("case_ord", "case_id", F.explode_outer(prefixes).alias("prefix"))), "routed")
    told = _resolved(files, routed, specs, defaults)
    no_format = F.when(F.col("format").isNull(), F.concat(F.lit("cannot determine the file format of '"), "path", F.lit("'")))
    no_kind = F.when(F.col("signal_kind").isNull(), F.concat(F.lit("cannot determine the signal kind of '"), "path", F.lit("'; pass an explicit file spec")))
    told = kept(told.withColumn("refused", F.coalesce(no_format, no_kind)), "files")
    options = told.drop("content", "refused")

    rows = _records(told.where("refused IS NULL")).join(options.select("case_id", "path", *OPTIONS), ["case_id", "path"])
    rows = rows.withColumn("layout", F.coalesce("layout", layout_of(F.col("header"), F.col("signal_kind"))))
    lacking = F.when(F.lit(False), F.array(F.lit("")))
    for kind, names in REQUIRED.items():
        lacking = lacking.when(F.col("signal_kind") == kind, F.filter(F.array(*map(F.lit, names)), lambda f: ~F.map_contains_key("layout", f)))
    no_layout = F.when(F.col("layout").isNull(), F.concat(F.lit("'"), "path", F.lit("' has no readable header to infer columns from")))
    no_columns = F.when(F.size(lacking) > 0, F.concat(F.lit("'"), "path", F.lit("' is missing required column(s): "), F.array_join(lacking, ", ")))
    rows = kept(rows.withColumn("refused", F.coalesce(no_layout, no_columns)), "records")

    whole = told.where("refused IS NOT NULL").select("case_id", "path", "refused").unionByName(rows.where("refused IS NOT NULL").select("case_id", "path", "refused").distinct())
    quarantine = [whole.select("case_id", "path", F.lit(0).alias("line"), F.col("refused").alias("reason"), F.lit(None).cast("map<string,string>").alias("record"))]
    good = rows.where("refused IS NULL AND (record IS NOT NULL OR error IS NOT NULL)")
    readings = [tuple(r) for r in options.select("time_layout", "assume_offset_minutes").distinct().collect()]  # as many as there are layouts and offsets of clocks
    tables, counts, services = {}, [], []
    for kind in signals.FIELDS:
        known = [r for r in readings if r[0] in times.LAYOUTS]
        judged = signals.classify(good.where(F.col("signal_kind") == kind), kind, F.col("layout"), F.col("time_layout"), F.col("assume_offset_minutes"), F.col("service_name"), F.col("service_aliases"), readings=known)
        judged = kept(judged.select("case_id", "path", "line", "record", "outcome", "reason", "signal"), f"judged-{kind}")
        tables[kind] = judged.where("outcome = 'signal'").select("case_id", "path", "line", "signal.*")
        quarantine.append(judged.where("outcome = 'quarantine'").select("case_id", "path", "line", "reason", "record"))
        counts.append(judged.groupBy("case_id", "outcome").agg(F.count(F.lit(1)).alias("n")))
        services.append(tables[kind].select("service").distinct())
    quarantined = reduce(DataFrame.unionByName, quarantine)

    seen = reduce(DataFrame.unionByName, services).where("service IS NOT NULL").distinct()
    declared = entities.select("entity_id", "kind", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    service_id = lambda c: graph.entity_id(F.lit("service"), F.lit(system), c)
    met = seen.select(service_id(F.col("service")).alias("entity_id"), F.lit("service").alias("kind"), F.col("service").alias("name"), F.array().cast("array<string>").alias("aliases"))
    vouched = kept(seen.unionByName(declared.where("kind = 'service'").select(F.col("name").alias("service"))).distinct(), "vouched")
    roots = cases.select(F.col("component").alias("service")).distinct().join(vouched, "service", "left_semi").select(service_id(F.col("service")).alias("entity_id"), F.lit("service").alias("kind"), F.col("service").alias("name"), F.array().cast("array<string>").alias("aliases"))
    first = declared.withColumn("_n", F.lit(0)).unionByName(met.withColumn("_n", F.lit(1))).unionByName(roots.withColumn("_n", F.lit(1)))
    found = kept(first.groupBy("entity_id").agg(*[F.min_by(c, "_n").alias(c) for c in ("kind", "name", "aliases")]), "entities")
    links = graph.distinct_edges(edges)

    slug = text.fault_type(F.col("fault_type"))
    at = times.iso_ms(F.col("inject_time"))
    start, end = times.window_around(at, lead_ms, lag_ms)
    facts = cases.select("case_ord", "case_id", F.lit(system).alias("system"), "component", slug.alias("fault_type"), F.coalesce("fault_category", text.category(slug)).alias("category"), "inject_time", F.coalesce("window_start", start).alias("window_start"), F.coalesce("window_end", end).alias("window_end"))
    facts = graph.resolve(facts, found, "component").withColumnRenamed("entity_id", "root_entity_id")
    contested = graph.ambiguous_aliases(found).select(F.col("ref").alias("_ref"), F.array_join("owners", ", ").alias("told"))
    named = facts.select("case_id", "component").join(vouched.select(F.col("service").alias("component"), F.lit(True).alias("_v")), "component", "left")
    trouble = [
        problems(dataset, system, cases, entities, edges), named.where("_v IS NULL AND trim(component) <> ''").select(F.lit("unvouchedRoot").alias("code"), "case_id", F.col("component").alias("told")),
        named.where("_v").join(contested, F.lower("component") == F.col("_ref")).select(F.lit("ambiguousRoot").alias("code"), "case_id", "told"),
        files.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("noFiles").alias("code"), F.lit(None).cast("string").alias("case_id"), F.lit("").alias("told")),
    ]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("ref"))
    blank = F.trim(F.coalesce("ref", F.lit(""))) == ""
    lost = ends.join(found.select(F.col("entity_id").alias("ref")), "ref", "left_anti").select(F.when(blank, "emptyEdge").otherwise("danglingEdge").alias("code"), F.lit(None).cast("string").alias("case_id"), F.col("ref").alias("told")).distinct()

    n = lambda of: F.coalesce(F.sum(F.when(F.col("outcome") == of, F.col("n"))), F.lit(0)).cast("long")
    tally = reduce(DataFrame.unionByName, counts).groupBy("case_id").agg(n("signal").alias("signals"), n("quarantine").alias("rejected"), n("missing").alias("missing"))
    paths = routed.where("case_id IS NOT NULL").groupBy("case_id").agg(F.count(F.lit(1)).alias("files"))
    refused = whole.groupBy("case_id").agg(F.count(F.lit(1)).alias("refused"))
    report = cases.select("case_id").distinct().join(tally, "case_id", "left").join(paths, "case_id", "left").join(refused, "case_id", "left").na.fill(0)
    report = report.select("case_id", "signals", (F.col("rejected") + F.col("refused")).alias("quarantined"), "missing", "files")
    hard = report.select("case_id", F.when(F.col("files") == 0, "noFiles").when((F.col("signals") == 0) & (F.col("quarantined") > 0), "everyFileRejected").alias("code")).where("code IS NOT NULL")
    return Ingested(tables, quarantined, report, routed.where("case_id IS NULL").select("path"), facts, found, links, reduce(DataFrame.unionByName, [*trouble, lost]), hard)
