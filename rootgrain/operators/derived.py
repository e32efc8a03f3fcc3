"""Derived readings: arithmetic over the series of each case, with its units.

A case's series are one row; tasks evaluate an expression for all cases of a batch at once, step by
step over arrays, so that neither the plan nor the work for a case grows with anything but the steps.
Where a reading or a step fails, a number for its problem goes on in place of the value, the first one
in reading order.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantities as q
from ..functions import units

_TEXTS = ("metric", "entity", "point", "unit", "operator", "left", "right", "left_dimension", "right_dimension")
PROBLEM = f"struct<kind:string,at:int,{','.join(f'{t}:string' for t in _TEXTS)},carriers:array<string>>"
RESULT = f"value double, unit string, references array<struct<entity:string,metric:string,point:string>>, problem {PROBLEM}"
#: What may be wrong with a reading, the first that holds is told.
_UNREAD = ("unknownSeries", "unknownEntity", "ambiguousSeries", "unsupportedUnit", "missingPoint")
_NOT_FINITE = -1


def _compiled(text: str | None) -> tuple[list[tuple], list[tuple]] | q.Unreadable:
    """Steps and readings of an expression, or why there are none; a null text is an empty one."""
    try:
        return q.compiled(text or "")
    except q.Unreadable as e:
        return e


def _ranges(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at starts and are as long as many says."""
    return np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)


class _Batch:
    """The series of a batch of cases side by side, their texts and units by number; the last row, which
    is also row -1, stands for none."""

    def __init__(self, held: pa.Array):
        self.many = held.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.many) - self.many
        metric, entity, self.n, unit, baseline, post = held.flatten().flatten()
        self.n = self.n.to_numpy()
        self.texts: dict[str, int] = {}
        self.units: dict[q.Unit, int] = {}
        (self.metric, _), (self.entity, entities), (self.unit_text, told) = (self._numbered(c) for c in (metric, entity, unit))
        read = [-1 if (u := q.parse_unit(t)) is None else self.unit(u) for t in told]
        self.unit_of = np.full(len(self.texts) + 1, -1)
        self.unit_of[[self.texts[t] for t in told]] = read
        self.rank = np.zeros(len(self.texts) + 1, np.int64)
        self.rank[[self.texts[t] for t in sorted(entities)]] = np.arange(len(entities))
        self.points = {p: np.append(c.fill_null(np.nan).to_numpy(), np.nan) for p, c in zip(q.POINTS, (baseline, post), strict=True)}
        self.there = {p: np.append(c.is_valid().to_numpy(zero_copy_only=False), False) for p, c in zip(q.POINTS, (baseline, post), strict=True)}

    def _numbered(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        coded = column.dictionary_encode()
        told = coded.dictionary.to_pylist()
        return np.append(np.array([self.text(t) for t in told], np.int64)[coded.indices.to_numpy()], -1), told

    def text(self, text: str | None) -> int:
        return -1 if text is None else self.texts.setdefault(text, len(self.texts))

    def unit(self, unit: q.Unit) -> int:
        return self.units.setdefault(unit, len(self.units))


class _Evaluation:
    """One expression for the cases `at` of a batch.

    faults are 0 for none, 1 + 5 * reading + the place in _UNREAD, or from `first` on 2 * step, plus 1
    for a division by zero.
    """

    def __init__(self, batch: _Batch, at: np.ndarray, program: tuple[list[tuple], list[tuple]] | q.Unreadable):
        self.batch, self.at = batch, at
        n = len(at)
        self.told = {t: np.full(n, -1, np.int64) for t in ("kind", *_TEXTS)}
        self.place = np.full(n, -1, np.int64)
        self.carriers: list[tuple[np.ndarray, np.ndarray]] = []  # (case, text)
        self.value, self.unit, self.one = np.full(n, np.nan), np.full(n, -1), np.empty((0, n), np.int64)
        self.readings: list[tuple] = []
        if isinstance(program, q.Unreadable):
            self._tell(np.arange(n), program.kind, place=program.at, point=batch.text(program.told if program.kind == "unknownPoint" else None))
        elif n:
            self._run(*program)

    def _tell(self, rows: np.ndarray, kind: str, place: int = -1, **texts) -> None:
        self.place[rows] = place
        for t, codes in {"kind": self.batch.text(kind), **texts}.items():
            self.told[t][rows] = codes

    def _run(self, steps: list[tuple], readings: list[tuple]) -> None:
        b, n = self.batch, len(self.at)
        self.readings, self.first = readings, 1 + 5 * len(readings)
        self.flat, self.case = _ranges(b.starts[self.at], b.many[self.at]), np.repeat(np.arange(n), b.many[self.at])
        self.metric = b.metric[self.flat]
        self.one = np.empty((len(readings), n), np.int64)
        self.mismatched: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        read = [self._read(i, *r) for i, r in enumerate(readings)]
        stack: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(all="ignore"):
            for s, (kind, _, value, reading) in enumerate(steps):
                if kind == "number":
                    stack.append((np.full(n, value), np.full(n, b.unit(())), np.zeros(n, np.int64)))
                elif kind == "reading":
                    stack.append(read[reading])
                elif kind == "~":
                    value, unit, fault = stack.pop()
                    stack.append((-value, unit, fault))
                else:
                    right, left = stack.pop(), stack.pop()
                    stack.append(self._joined(s, kind, left, right))
        self.value, self.unit, fault = stack[0]
        fault = np.where((fault == 0) & ~np.isfinite(self.value), _NOT_FINITE, fault)
        for f in np.unique(fault[fault != 0]).tolist():
            self._explain(f, np.flatnonzero(fault == f), steps)

    def _of(self, metric: str) -> np.ndarray:
        """Which of the cases' series are of a metric."""
        return np.flatnonzero(self.metric == self.batch.texts.get(metric, -2))

    def _read(self, i: int, metric: str, entity: str | None, point: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, n, of = self.batch, len(self.at), self._of(metric)
        able = of if entity is None else of[b.entity[self.flat[of]] == b.texts.get(entity, -2)]
        count = np.bincount(self.case[able], b.n[self.flat[able]], n)
        one = self.one[i]
        one[:] = -1
        one[self.case[able]] = self.flat[able]
        unit = b.unit_of[b.unit_text[one]]
        wrong = [np.bincount(self.case[of], minlength=n) == 0, count == 0, count > 1, unit < 0, ~b.there[point][one]]
        return b.points[point][one], unit, np.select(wrong, [1 + 5 * i + k for k in range(len(_UNREAD))], 0)

    def _joined(self, step: int, kind: str, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, (x, u, f), (y, v, g) = self.batch, left, right
        pairs, which = np.unique((u + 1) << 32 | (v + 1), return_inverse=True)
        known = list(b.units)
        both = [(known[p - 1], known[o - 1]) if p and o else None for p, o in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True)]
        own = np.zeros(len(x), np.int64)
        if kind in "+-":
            scale = np.array([np.nan if p is None or (s := q.factor_to(p[1], p[0])) is None else s for p in both])[which]
            value, unit = x + (-y if kind == "-" else y) * scale, u
            own[np.isnan(scale)] = self.first + 2 * step
            self.mismatched[step] = u, v
        else:
            of = q.product if kind == "*" else q.quotient
            unit = np.array([-1 if p is None else b.unit(of(*p)) for p in both])[which]
            value = x * y if kind == "*" else x / y
            if kind == "/":
                own[y == 0] = self.first + 2 * step + 1
        return value, unit, np.where(f != 0, f, np.where(g != 0, g, own))

    def _explain(self, fault: int, rows: np.ndarray, steps: list[tuple]) -> None:
        b = self.batch
        if fault == _NOT_FINITE:
            self._tell(rows, "notFinite")
        elif fault >= self.first:
            step, zero = divmod(fault - self.first, 2)
            if zero:
                self._tell(rows, "divisionByZero", place=steps[step][1])
                return
            known = list(b.units)
            left, right = (side[rows] for side in self.mismatched[step])
            texts = {k: np.full(len(rows), -1, np.int64) for k in ("left", "right", "left_dimension", "right_dimension")}
            for x, y in np.unique(np.stack([left, right], 1), axis=0).tolist():
                at, sides = (left == x) & (right == y), (known[x], known[y])
                texts["left"][at], texts["right"][at] = (b.text(q.render(s)) for s in sides)
                dimensions = [q.known(s) for s in sides]
                if all(dimensions):
                    texts["left_dimension"][at], texts["right_dimension"][at] = (b.text(d[0]) for d in dimensions)
            self._tell(rows, "unitMismatch", operator=b.text(steps[step][0]), **texts)
        else:
            i, k = divmod(fault - 1, 5)
            (metric, entity, point), kind = self.readings[i], _UNREAD[k]
            metric_of = {} if kind == "unsupportedUnit" else {"metric": b.text(metric)}
            more = {"entity": b.text(entity)} if kind == "unknownEntity" else {"unit": b.unit_text[self.one[i][rows]]} if kind == "unsupportedUnit" else {"point": b.text(point)} if kind == "missingPoint" else {}
            self._tell(rows, kind, **metric_of, **more)
            if kind in ("unknownEntity", "ambiguousSeries"):
                hit = np.zeros(len(self.at), bool)
                hit[rows] = True
                of = self._of(metric)
                of = of[hit[self.case[of]]]
                of = of[np.lexsort((b.rank[b.entity[self.flat[of]]], self.case[of]))]
                twice = np.minimum(b.n[self.flat[of]], 2)
                self.carriers.append((np.repeat(self.case[of], twice), np.repeat(b.entity[self.flat[of]], twice)))

    def references(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many of each case, reading, entity): what the readings of cases without a problem are of, each once."""
        own = self.batch.entity[self.one]
        keep = np.broadcast_to(self.told["kind"] < 0, own.shape).copy()
        free = {(m, p): i for i, (m, e, p) in enumerate(self.readings) if e is None}
        for j, (m, e, p) in enumerate(self.readings):
            i = free.get((m, p), j)
            if i != j:
                keep[max(i, j)] &= own[i] != own[j]
        case, reading = np.nonzero(keep.T)
        return keep.sum(axis=0), reading, own[reading, case]


def _lists(values: pa.Array, many: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), values, mask=pa.array(~there))


def _results(batch: _Batch, done: list[_Evaluation]) -> list[pa.Array]:
    """The columns of RESULT, for the evaluations of a batch one after the other."""
    joined = lambda of: np.concatenate([of(e) for e in done])
    kind = joined(lambda e: e.told["kind"])
    well = kind < 0
    told = {t: kind if t == "kind" else joined(lambda e, t=t: e.told[t]) for t in ("kind", *_TEXTS)}
    unit, value, place = joined(lambda e: e.unit), joined(lambda e: e.value), joined(lambda e: e.place)
    spelled = np.array([batch.text(q.render(u)) for u in batch.units] + [-1], np.int64)
    refs = [e.references() for e in done]
    of = [np.array([[batch.text(r[k]) for r in e.readings] for k in (0, 2)], np.int64)[:, r[1]] for e, r in zip(done, refs, strict=True)]
    count = [np.bincount(np.concatenate([c for c, _ in e.carriers]), minlength=len(e.at)) if e.carriers else np.zeros(len(e.at), np.int64) for e in done]
    named = []
    for e in done:
        case, entity = (np.concatenate(x) for x in zip(*e.carriers, strict=True)) if e.carriers else (np.empty(0, np.int64), np.empty(0, np.int64))
        named.append(entity[np.argsort(case, kind="stable")])
    pool = pa.array(batch.texts, pa.string())
    text = lambda codes: pool.take(pa.array(codes, mask=codes < 0))
    entity, (metric, point) = np.concatenate([r[2] for r in refs]), np.concatenate(of, axis=1)
    references = _lists(pa.StructArray.from_arrays([text(entity), text(metric), text(point)], names=["entity", "metric", "point"]), np.concatenate([r[0] for r in refs]), well)
    count = np.concatenate(count)
    fields = {"kind": text(kind), "at": pa.array(place.astype(np.int32), mask=place < 0), **{t: text(told[t]) for t in _TEXTS}, "carriers": _lists(text(np.concatenate(named)), count, count > 0)}
    problem = pa.StructArray.from_arrays(list(fields.values()), names=list(fields), mask=pa.array(well))
    return [pa.array(value, mask=~well), text(np.where(well, spelled[unit], -1)), references, problem]


def held_readings(series: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(case_id, held): of each case the entities that carry its metrics, with their readings, in one list."""
    known = F.col("metric") if metrics is None else F.when(F.col("metric").isin(*metrics), F.col("metric")) if metrics else F.lit(None).cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = series.where("case_id IS NOT NULL").select("case_id", known.alias("metric"), F.when(known.isNotNull(), text("entity")).alias("entity"), text("unit").alias("unit"), F.col("baseline").cast("double").alias("baseline"), F.col("post").cast("double").alias("post"))
    each = named.groupBy("case_id", "metric", "entity").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("unit", "baseline", "post")])
    carrier = F.struct("metric", "entity", "n", "unit", "baseline", "post")
    return each.groupBy("case_id").agg(F.collect_list(F.when(F.col("metric").isNotNull(), carrier)).alias("held"))


def evaluate(series: DataFrame, expressions: dict[str, str] | DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, name, value, unit, references, problem): expressions on the series of cases.

    series has case_id, entity, metric, unit, baseline and post, a row for each series. expressions
    are texts by name, each for every case of series or of `cases`, or a table (case_id, name,
    expression) with a row for each. A text is that of functions.quantities.compiled(): products and
    quotients join units, sums need one unit or two that convert, and keep the left one. A reading
    without an entity needs a metric that one series of the case carries.

    Where all goes well value, unit and references (entity, metric, point, each once, as read) are told
    and problem is null; else only problem, the first one met: syntax, tooDeep, unknownPoint (all with
    the place in the text), unknownSeries, unknownEntity, ambiguousSeries (with the carriers, in order
    of names, twice where one has several such series), unsupportedUnit, missingPoint, unitMismatch,
    divisionByZero or notFinite.

    Null entities, units and expressions are empty texts; rows without a case are left out, those
    without a metric count for their case only. Series are summed by case, metric and entity before
    the shuffle; then a case has one row, with all its series. Series that are dealt out by case
    already (repartition("case_id")) are not shuffled again.
    """
    if isinstance(expressions, DataFrame):
        listed = None
        rows = expressions.where("case_id IS NOT NULL").select("case_id", "name", "expression").join(held_readings(series), "case_id", "left")
        rows = rows.select("case_id", "held", "name", F.col("expression").cast("string"))
        name = rows.schema["name"].dataType
    else:
        listed = [(n, _compiled(t)) for n, t in expressions.items()]
        rows = held_readings(series, sorted({m for _, p in listed if not isinstance(p, q.Unreadable) for m, _, _ in p[1]}))
        if cases is not None:
            rows = cases.select("case_id").where("case_id IS NOT NULL").distinct().join(rows, "case_id", "left")
        name = T.StringType()

    def batch_of(case: pa.Array, name: pa.Array, held: _Batch, done: list[_Evaluation]) -> pa.RecordBatch:
        at = pa.array(np.concatenate([e.at for e in done]))
        return pa.RecordBatch.from_arrays([case.take(at), name.take(at), *_results(held, done)], names=["case_id", "name", "value", "unit", "references", "problem"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            case, held = batch.column(0), _Batch(batch.column(1))
            for n, p in listed or ():
                yield batch_of(case, pa.array([n] * len(case), pa.string()), held, [_Evaluation(held, np.arange(len(case)), p)])
            if listed is None:
                told = batch.column(3).fill_null("").dictionary_encode()
                of = told.indices.to_numpy()
                parts = np.split(np.argsort(of, kind="stable"), np.flatnonzero(np.diff(np.sort(of))) + 1)
                yield batch_of(case, batch.column(2), held, [_Evaluation(held, at, _compiled(t)) for at, t in zip(parts, told.dictionary.to_pylist(), strict=True)])

    kind = T.StructType([T.StructField("case_id", rows.schema["case_id"].dataType), T.StructField("name", name), *T.StructType.fromDDL(RESULT).fields])
    return rows.mapInArrow(run, kind)


def hold(evaluated: DataFrame, claims: dict[str, tuple[str, float, str]]) -> DataFrame:
    """evaluated with `holds`: whether the claim (comparator, value, unit) of its name is true of the
    value. Null without a claim or with a problem; a claim in another unit than the computed one, as
    written by functions.quantities.render, is false."""
    told = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, (comparator, value, unit) in claims.items():
        told = told.when(F.col("name") == name, (F.col("unit") == unit) & units.holds(comparator, F.col("value"), F.lit(float(value))))
    return evaluated.withColumn("holds", F.when(F.col("problem").isNull(), told))
