"""Quality gates over a bundle of cases. Each gives violations: (gate_id, case_id, code, message, field_path).

cases: (case_ord, case_id, system, inject_time, window_start, window_end, fault_type, root_entity_id,
query). signals: (case_id, signal_idx, signal, ts_ms, raw_ts, service, name, value). outcomes: (case_id,
method, rank_of_truth, candidate_count).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times
from . import series


def _violations(rows: DataFrame, gate: str, code: str, message: Column | str, path: str) -> DataFrame:
    told = message if isinstance(message, Column) else F.lit(message)
    return rows.select(F.lit(gate).alias("gate_id"), "case_id", F.lit(code).alias("code"), told.alias("message"), F.lit(path).alias("field_path"))


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def structural(cases: DataFrame, signals: DataFrame, kinds: tuple[str, ...], query_required: bool = False) -> DataFrame:
    """G1: identity, canonical injection time, a readable window, a root cause, and a signal of each
    required kind in every case; a signal without a service is told once for each case."""
    checks = [
        _violations(cases.where(_blank("case_id")), "G1", "EMPTY_CASE_ID", "case id is empty", "caseId"),
        _violations(cases.where(~F.coalesce(F.col("inject_time").rlike(times.ISO_UTC), F.lit(False))), "G1", "BAD_INJECT_TIME", "not a canonical UTC instant", "injectTime"),
        _violations(cases.where(F.coalesce(times.iso_ms(F.col("window_start")) >= times.iso_ms(F.col("window_end")), F.lit(True))), "G1", "BAD_WINDOW", "window does not end after its start", "window"),
        _violations(cases.where(_blank("root_entity_id")), "G1", "EMPTY_ROOT_CAUSE", "no root cause", "groundTruth.rootCauseEntityId"),
        _violations(missing_kinds(cases, signals, kinds), "G1", "MISSING_SIGNAL", F.concat(F.lit("no signal of kind "), "kind"), "signals"),
        _violations(signals.where(_blank("service")).select("case_id").distinct(), "G1", "MISSING_SERVICE_NAME", "a signal names no service", "resource.service.name"),
    ]
    if query_required:
        checks.append(_violations(cases.where(_blank("query")), "G1", "MISSING_QUERY", "no task text", "query"))
    return reduce(DataFrame.unionByName, checks)


def missing_kinds(cases: DataFrame, signals: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(case_id, kind) for each kind that a case has no signal of."""
    wanted = cases.select("case_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return wanted.join(signals.select("case_id", F.col("signal").alias("kind")).distinct(), ["case_id", "kind"], "left_anti")


def non_monotonic(signals: DataFrame) -> DataFrame:
    """(case_id, service, name, signal_idx): metric rows before whose arrival a later instant arrived
    in the same series."""
    order = Window.partitionBy("case_id", "service", "name").orderBy("signal_idx")
    rows = signals.select("case_id", "service", "name", "signal_idx", "ts_ms", F.lag("ts_ms").over(order).alias("_before"))
    return rows.where("_before > ts_ms").drop("_before", "ts_ms")


def semantic(cases: DataFrame, signals: DataFrame, entities: DataFrame) -> DataFrame:
    """G2: known root causes and services, an injection within the window, monotonic series."""
    ids = entities.select(F.col("entity_id").alias("root_entity_id"))
    start, end, at = (times.iso_ms(F.col(c)) for c in ("window_start", "window_end", "inject_time"))
    checks = [
        _violations(cases.where(~_blank("root_entity_id")).join(ids, "root_entity_id", "left_anti"), "G2", "UNRESOLVED_ROOT_CAUSE", "root cause is no entity", "groundTruth.rootCauseEntityId"),
        _violations(cases.where(start > end), "G2", "INVERTED_WINDOW", "window ends before its start", "window"),
        _violations(cases.where((start <= end) & ~at.between(start, end)), "G2", "INJECT_TIME_OUT_OF_WINDOW", "injection lies outside the window", "injectTime"),
        _violations(non_monotonic(signals).select("case_id").distinct(), "G2", "NON_MONOTONIC_TIMESTAMP", "a series goes back in time", "signals"),
    ]
    return reduce(DataFrame.unionByName, checks)


def validity(cases: DataFrame, signals: DataFrame, threshold: float = 3.0, samples: int = 3) -> DataFrame:
    """G3: each case has a run of anomalous post samples, and no signals outside of its window."""
    metrics = signals.where("signal = 'metric'").join(cases.select("case_id", times.iso_ms(F.col("inject_time")).alias("_inject")), "case_id")
    rows = series.z_rows(metrics, F.col("_inject"), "case_id", "service", "name")
    strong = series.longest_run(rows, threshold, "case_id", "service", "name").where(F.col("longest_run") >= samples).select("case_id").distinct()
    window = cases.select("case_id", times.iso_ms(F.col("window_start")).alias("_a"), times.iso_ms(F.col("window_end")).alias("_b"))
    outside = signals.join(window, "case_id").where(~F.col("ts_ms").between(F.col("_a"), F.col("_b"))).select("case_id").distinct()
    return _violations(cases.join(strong, "case_id", "left_anti"), "G3", "WEAK_ANOMALY_SIGNAL", f"no {samples} samples on end at z of {threshold:g}", "signals").unionByName(
        _violations(outside, "G3", "SIGNAL_OUT_OF_WINDOW", "a signal lies outside the window", "signals")
    )


def solvability(cases: DataFrame, outcomes: DataFrame, top_k: int = 3, min_solvers: int = 1) -> DataFrame:
    """(case_id, solvers, contested): methods that rank the truth within top_k, and whether any method
    had more candidates than that."""
    hit = F.coalesce(F.col("rank_of_truth") <= top_k, F.lit(False))
    told = outcomes.groupBy("case_id").agg(F.countDistinct(F.when(hit, F.col("method"))).alias("solvers"), F.coalesce(F.bool_or(F.col("candidate_count") > top_k), F.lit(False)).alias("contested"))
    out = cases.select("case_id").join(told, "case_id", "left")
    return out.select("case_id", F.coalesce("solvers", F.lit(0)).alias("solvers"), F.coalesce("contested", F.lit(False)).alias("contested"), (F.coalesce("solvers", F.lit(0)) >= min_solvers).alias("solvable"))


def saturation(outcomes: DataFrame, top_k: int = 1, limit: float = 0.95, min_cases: int = 10) -> DataFrame:
    """(method, asked, hits, rate, saturated) over the cases that a method was asked about."""
    hit = F.coalesce(F.col("rank_of_truth") <= top_k, F.lit(False))
    told = outcomes.groupBy("method").agg(F.countDistinct("case_id").alias("asked"), F.countDistinct(F.when(hit, F.col("case_id"))).alias("hits"))
    rate = F.col("hits") / F.col("asked")
    return told.select("method", "asked", "hits", rate.alias("rate"), ((rate >= limit) & (F.col("asked") >= min_cases)).alias("saturated"))


def similar_texts(cases: DataFrame, threshold: float, system: str = "system", case: str = "case_id", query: str = "query") -> DataFrame:
    """(a, b, jaccard), a < b: pairs of one system whose task texts' token sets are that similar.

    Tokens are ordered by how many texts hold them, rare ones first, and only the first of each set
    that a similar pair must share one of are joined, so that common words make no pairs.
    """
    rows = cases.select(F.col(system).alias("s"), F.col(case).alias("c"), F.array_distinct(text.task_tokens(F.col(query))).alias("tokens")).where(F.size("tokens") > 0)
    flat = rows.select("s", "c", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    ranked = flat.join(flat.groupBy("s", "t").agg(F.count("*").alias("df")), ["s", "t"])
    place = F.row_number().over(Window.partitionBy("s", "c").orderBy("df", "t"))
    prefix = ranked.withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("s", "t", "c", "n")
    other = prefix.toDF("s", "t", "c2", "n2")
    pairs = prefix.join(other, ["s", "t"]).where("c < c2").where((F.col("n2") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("n2") * threshold - 1e-9)).select("c", "c2").distinct()
    sets = rows.select("c", "tokens")
    both = pairs.join(sets, "c").join(sets.toDF("c2", "tokens2"), "c2")
    return both.select(F.col("c").alias("a"), F.col("c2").alias("b"), text.jaccard(F.col("tokens"), F.col("tokens2")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def overlapping_windows(cases: DataFrame, limit: float, system: str = "system", case: str = "case_id") -> DataFrame:
    """(a, b, iou), a < b: pairs of one system whose windows overlap by that share of their union.

    A window is listed in each stretch of time that it touches, stretches being as long as the longest
    window of the system, so that only windows that can meet are joined. Two windows are compared in the
    stretch where the later one begins, so that no pair is found twice. Equal rows count once.
    """
    w = cases.select(F.col(system).alias("s"), F.col(case).alias("c"), times.iso_ms(F.col("window_start")).alias("lo"), times.iso_ms(F.col("window_end")).alias("hi")).where("lo < hi").distinct()
    longest = w.groupBy("s").agg(F.max(F.col("hi") - F.col("lo")).alias("len"))
    first = F.floor(F.col("lo") / F.col("len"))
    cut = w.join(longest, "s").select("s", "c", "lo", "hi", first.alias("first"), F.explode(F.sequence(first, F.floor(F.col("hi") / F.col("len")))).alias("g"))
    other = cut.select("s", "g", *[F.col(x).alias(x + "2") for x in ("c", "lo", "hi", "first")])
    both = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    iou = both / (F.greatest("hi", "hi2") - F.least("lo", "lo2"))
    # numbers before texts: most pairs end at the first conditions
    pairs = cut.join(other, ["s", "g"]).where((F.greatest("first", "first2") == F.col("g")) & (both > 0) & (iou >= limit) & (F.col("c") < F.col("c2")))
    return pairs.select(F.col("c").alias("a"), F.col("c2").alias("b"), iou.alias("iou"))


def fingerprint(*columns: str) -> Column:
    return text.fnv1a(F.concat_ws("|", *columns))


def anti_pollution(cases: DataFrame, signals: DataFrame, public: DataFrame, similar: float = 0.9, overlap: float = 0.5) -> DataFrame:
    """G5: near-duplicate task texts, overlapping windows, repeated cases, members of a public set (by
    fingerprint, column fp) and personal data or secrets in the task text, in the declared cause or in
    logs among the first 200 signals of a case."""
    marked = cases.withColumn("_fp", fingerprint("system", "fault_type", "inject_time", "root_entity_id", "window_start", "window_end"))
    again = marked.withColumn("_n", F.row_number().over(Window.partitionBy("_fp").orderBy("case_ord"))).where("_n > 1")
    head = signals.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy("signal_idx"))).where("_n <= 200 AND signal = 'log'").where(text.sensitive(F.col("body")))
    said = cases.where(text.sensitive(F.concat_ws("\n", *[c for c in ("query", "reason", "component") if c in cases.columns])))
    leaky = head.select("case_id").union(said.select("case_id")).distinct()
    checks = [
        _violations(similar_texts(cases, similar).withColumnRenamed("b", "case_id"), "G5", "NEAR_DUPLICATE_QUERY", F.concat(F.lit("task text like that of "), "a"), "query"),
        _violations(overlapping_windows(cases, overlap).withColumnRenamed("b", "case_id"), "G5", "OVERLAPPING_WINDOW", F.concat(F.lit("window overlaps that of "), "a"), "window"),
        _violations(again, "G5", "DUPLICATE_CASE", "same fingerprint as an earlier case", "caseId"),
        _violations(marked.join(public.select(F.col("fp").alias("_fp")), "_fp", "left_semi"), "G5", "PUBLIC_SET_CONTAMINATION", "case is in a public set", "caseId"),
        _violations(leaky, "G5", "SENSITIVE_DATA_PRESENT", "personal data or a secret in a log", "signals"),
    ]
    return reduce(DataFrame.unionByName, checks)


def difficulty_distribution(cases: DataFrame, floors: DataFrame, max_l1: float = 0.2, min_l4: float = 0.1, min_cases: int = 10) -> DataFrame:
    """One row (n, graded, l1_share, l4_share, codes) of cases (case_id, difficulty) and their floors: with
    min_cases graded ones or more, DIFFICULTY_SKEWED_EASY where too many of those are L1, and
    DIFFICULTY_SKEWED_HARD where too few of all cases have earned L4."""
    level = cases.select("case_id", "difficulty").join(floors.select("case_id", "floor"), "case_id", "left")
    told = level.agg(F.count("*").alias("n"), F.count("difficulty").alias("graded"), F.count_if(F.col("difficulty") == "L1").alias("l1"), F.count_if(F.col("floor") == "L4").alias("l4"))
    shares = told.select("n", "graded", F.try_divide("l1", "graded").alias("l1_share"), F.try_divide("l4", "n").alias("l4_share"))
    codes = F.array_compact(F.array(F.when(F.col("l1_share") > max_l1, "DIFFICULTY_SKEWED_EASY"), F.when(F.col("l4_share") < min_l4, "DIFFICULTY_SKEWED_HARD")))
    return shares.withColumn("codes", F.when(F.col("graded") >= min_cases, codes).otherwise(F.array().cast("array<string>")))


def discrimination(readings: DataFrame) -> DataFrame:
    """One row (n, strict, tie, same_component, none, violated) of readings (case_id, kind): a set in which no
    case has a strictly louder, separate component above its answer is violated, an empty one is not."""
    kinds = ("strict", "tie", "same-component", "none")
    told = readings.agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in kinds])
    return told.withColumn("violated", (F.col("n") > 0) & (F.col("strict") == 0))


def g4(cases: DataFrame, outcomes: DataFrame, floors: DataFrame, **limits) -> DataFrame:
    """(case_id, code) of G4: cases that no baseline finds, and with a null case the codes of the set's
    difficulty and of saturated methods."""
    unsolved = solvability(cases, outcomes).where("NOT solvable").select("case_id", F.lit("UNSOLVABLE").alias("code"))
    nobody = F.lit(None).cast("string").alias("case_id")
    spread = difficulty_distribution(cases, floors, **limits).select(nobody, F.explode("codes").alias("code"))
    loud = saturation(outcomes).where("saturated").select(nobody, F.lit("SATURATED").alias("code"))
    return unsolved.unionByName(spread).unionByName(loud)


def _name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-_./]+", " "), r"\s+", " "))


def prompt_leaks(cases: DataFrame, min_length: int = 6, query: str = "query", component: str = "component") -> DataFrame:
    """(case_id, judged, leaks): whether the task text names the root cause's component, as whole words, case
    and punctuation of names aside; a name of fewer characters than min_length is not judged."""
    name = _name(F.col(component))
    judged = F.coalesce(F.length(name) >= min_length, F.lit(False))
    pattern = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.regexp_replace(name, r"\\E", ""), F.lit(r"\E([^a-z0-9]|$)"))
    return cases.select("case_id", judged.alias("judged"), (judged & F.regexp_like(_name(F.coalesce(F.col(query), F.lit(""))), pattern)).alias("leaks"))


def absent_answers(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """(case_id, component, carried) of cases whose series carry names, sorted, but not that of the answer."""
    names = signals.where("trim(service) <> ''").groupBy("case_id").agg(F.sort_array(F.collect_set("service")).alias("carried"))
    return cases.select("case_id", "component").join(names, "case_id").where(~F.array_contains("carried", F.col("component")))


def status(cases: DataFrame, violations: DataFrame) -> DataFrame:
    """(case_id, status): rejected by G1 or G2, quarantined by any other gate, admitted without violations."""
    worst = violations.groupBy("case_id").agg(F.bool_or(F.col("gate_id").isin("G1", "G2")).alias("_hard"))
    told = cases.select("case_id").join(worst, "case_id", "left")
    return told.select("case_id", F.when(F.col("_hard"), "rejected").when(~F.col("_hard"), "quarantined").otherwise("admitted").alias("status"))
