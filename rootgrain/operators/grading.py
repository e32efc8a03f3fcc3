"""Grading of predictions by the rules of each benchmark: roots, chains and strict conjunctions.

rows hold the prediction and the truth of a case side by side, as columns of arrays and texts.
"""

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .compare import set_f1
from .scoring import normal


def _best(weights: np.ndarray) -> float:
    """The largest sum of one weight from each row and column: rows are added one after another, each by
    the cheapest chain of columns that change hands, under prices that keep all chosen pairs cheapest."""
    n = len(weights)
    row_price, price, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)  # column n stands for the row that is added
    for row in range(n):
        owner[n], column = row, n
        least, came, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool)
        while owner[column] >= 0:
            done[column] = True
            free = np.flatnonzero(~done[:n])
            slack = -weights[owner[column], free] - row_price[owner[column]] - price[free]
            nearer = slack < least[free]
            least[free[nearer]], came[free[nearer]] = slack[nearer], column
            step_to = free[np.argmin(least[free])]
            step = least[step_to]
            taken = np.flatnonzero(done)
            row_price[owner[taken]] += step
            price[taken] -= step
            least[free] -= step
            column = step_to
        while column != n:
            owner[column], column = owner[came[column]], came[column]
    return float(weights[owner[:n], np.arange(n)].sum())


@F.pandas_udf(T.DoubleType())
def best_assignment(weights: pd.Series) -> pd.Series:
    """The largest sum of one weight from each row and each column of a square matrix (an array of
    arrays of doubles) of any size; 0 for an empty one, null for null."""
    return pd.Series([None if w is None else _best(np.array([np.asarray(r, float) for r in w])) if len(w) else 0.0 for w in weights], dtype="float64")


def _all_declare(roots: Column, criterion: str) -> Column:
    return F.forall(roots, lambda t: t[criterion].isNotNull())


def root_weights(predicted: Column, truth: Column, same_time) -> Column:
    """What each predicted root (struct component, reason, time) earns at each true one: a point for each
    criterion that agrees, of those that every true root declares. same_time(a, b) compares two time
    texts."""
    point = lambda hit: F.coalesce(hit, F.lit(False)).cast("double")
    whole = {f: _all_declare(truth, f) for f in ("component", "reason", "time")}
    return F.transform(
        predicted,
        lambda p: F.transform(truth, lambda t: point(whole["component"] & (p["component"] == t["component"])) + point(whole["reason"] & (p["reason"] == t["reason"])) + point(whole["time"] & same_time(p["time"], t["time"]))),
    )


def assigned_scores(rows: DataFrame, predicted: str, truth: str, same_time, score: str = "score") -> DataFrame:
    """rows with the share of all declared criteria that the best assignment of predicted to true roots
    earns; 0 where their numbers differ, and for a truth that declares nothing. A criterion that only
    some of the true roots declare earns nothing and is counted."""
    p, t = F.col(predicted), F.col(truth)
    declared = F.aggregate(t, F.lit(0), lambda s, r: s + r["component"].isNotNull().cast("int") + r["reason"].isNotNull().cast("int") + r["time"].isNotNull().cast("int"))
    weights = F.when(F.size(p) == F.size(t), root_weights(p, t, same_time))
    known = rows.withColumns({"_weights": weights, "_declared": declared})
    # read twice, so that the weights are computed before the assignment and not within it
    earned = F.when(F.col("_weights").isNotNull() & (F.col("_declared") > 0), best_assignment("_weights") / F.col("_declared"))
    return known.withColumn(score, F.coalesce(earned, F.lit(0.0))).drop("_weights", "_declared")


def chain_nodes(edges: Column) -> Column:
    """The distinct ends of `a->b` texts."""
    return F.array_distinct(F.filter(F.flatten(F.transform(edges, lambda e: F.split(e, "->"))), lambda n: n != ""))


@F.pandas_udf(T.BooleanType())
def reaches(edges: pd.Series, root: pd.Series, targets: pd.Series) -> pd.Series:
    """Whether a path of one `a->b` edge or more leads from the root to a target, over the row's own edges,
    however long it is."""

    def led(own: list[str], start: str, wanted: list[str]) -> bool:
        after = defaultdict(list)
        for a, b in (e.split("->") for e in own if e.count("->") == 1):
            if a and b:
                after[a].append(b)
        seen, todo, goal = set(), [start], set(wanted)
        while todo:
            new = set(after[todo.pop()]) - seen
            if new & goal:
                return True
            seen |= new
            todo += new
        return False

    return pd.Series([led(*row) for row in zip(edges, root, targets, strict=True)], dtype=bool)


def chain_scores(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """rows (case, component, fault, chain, true_component, true_fault, true_chain; null counts as empty)
    -> (case, em, any_service, node_f1, edge_f1, path): exact match of component and kind of fault, the
    component alone, set F1 of nodes and of edges, and whether the predicted chain leads from the right
    component to a node of the true one. The last three are null where the truth declares no chain
    (F1: where neither side does)."""
    empty = F.array().cast("array<string>")
    known = rows.select(case, *[F.coalesce(c, F.lit("")).alias(c) for c in ("component", "fault", "true_component", "true_fault")], *[F.coalesce(c, empty).alias(c) for c in ("chain", "true_chain")])
    known = known.withColumn("_nodes", chain_nodes(F.col("true_chain")))
    service = (F.col("true_component") != "") & (F.col("component") == F.col("true_component"))
    kind = (F.col("true_fault") != "") & (F.col("fault") == F.col("true_fault"))
    path = F.when(F.size("true_chain") > 0, (service & reaches("chain", "true_component", "_nodes")).cast("int"))
    return known.select(case, (service & kind).cast("int").alias("em"), service.cast("int").alias("any_service"), set_f1(chain_nodes(F.col("chain")), F.col("_nodes")).alias("node_f1"), set_f1(F.col("chain"), F.col("true_chain")).alias("edge_f1"), path.alias("path"))


def conjunction(facets: dict[str, tuple[Column, Column]]) -> Column:
    """Share of the facets that the truth declares (not null, not empty) and the prediction equals; 0
    without any."""
    declared = [F.coalesce(t.cast("string"), F.lit("")) != "" for _, t in facets.values()]
    right = [d & F.coalesce(p == t, F.lit(False)) for d, (p, t) in zip(declared, facets.values(), strict=True)]
    total = sum((d.cast("int") for d in declared), F.lit(0))
    return F.when(total > 0, sum((r.cast("int") for r in right), F.lit(0)) / total).otherwise(0.0)


def folded_equality(component: Column, fault: Column, true_component: Column, true_fault: Column) -> Column:
    """conjunction() of two fields compared without case and white space."""
    return conjunction({"component": (normal(component), normal(true_component)), "fault": (normal(fault), normal(true_fault))})


def evidence_score(predicted: Column, truth: Column, characters: int = 20) -> Column:
    """Share of the true evidence whose first characters begin a predicted piece; null without truth."""
    head = lambda c: F.transform(c, lambda x: F.substring(F.lower(x), 1, characters))
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(head(truth), head(predicted))) / F.size(F.array_distinct(head(truth))))


def facet_grid(truths: DataFrame, facets: list[str], score) -> DataFrame:
    """Every truth as its own prediction, as it is (facet null) and with each facet replaced by a wrong
    value: (columns of truths, mutated, score). score(prediction columns, truth columns) gives a Column
    from dicts by facet. A scored facet must lower the score, an unscored one must not."""
    names = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(f) for f in facets])).alias("mutated")
    grid = truths.select("*", names)
    truth = {f: F.col(f) for f in facets}
    wrong = {f: F.when(F.col("mutated") == f, F.concat(F.lit("not-"), F.col(f))).otherwise(F.col(f)) for f in facets}
    return grid.withColumn("score", score(wrong, truth))
