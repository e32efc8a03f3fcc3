"""Units of measurement as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import UNITS


def convertible(a: str, b: str) -> bool:
    return a in UNITS and b in UNITS and UNITS[a][0] == UNITS[b][0]


def convert(value: Column, source: str, target: str) -> Column:
    """value in the target unit; the same value where both units have one factor."""
    if not convertible(source, target):
        raise ValueError(f"{source!r} does not convert to {target!r}")
    (_, n1, d1, _), (_, n2, d2, _) = UNITS[source], UNITS[target]
    if n1 * d2 == n2 * d1:
        return value
    return value * F.lit(float(n1)) * F.lit(float(d2)) / (F.lit(float(d1)) * F.lit(float(n2)))


def _lookup(unit: Column, of) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for symbol, row in UNITS.items():
        if (value := of(row)) is not None:
            out = out.when(unit == symbol, F.lit(value))
    return out


def dimension(unit: Column) -> Column:
    return _lookup(unit, lambda r: r[0])


def clamp(value: Column, unit: Column) -> Column:
    """Within 0 and the unit's largest measurement; unknown units don't bound."""
    top = _lookup(unit, lambda r: None if r[3] is None else float(r[3]))
    known = unit.isin(*UNITS)
    return F.when(known, F.greatest(F.least(value, F.coalesce(top, value)), F.lit(0.0))).otherwise(value)


def quantize(value: Column, unit: Column) -> Column:
    """Counts are whole: halves go up."""
    return F.when(unit == "count", F.floor(value + 0.5).cast("double")).otherwise(value)


def resolution(unit: Column) -> Column:
    """The smallest step that a unit tells: 1 as a rule, 0.01 for a ratio, 1e-6 without a known unit."""
    return F.when(unit == "1", 0.01).when(unit.isin(*UNITS), 1.0).otherwise(1e-6)


def holds(comparator: str, computed: Column, stated: Column, tolerance: float = 1e-9) -> Column:
    """Whether a comparison holds. Within the tolerance, relative to the larger of both and 1, they are
    equal: then ==, >= and <= hold and the strict ones and != do not."""
    exact = {">": computed > stated, ">=": computed >= stated, "<": computed < stated, "<=": computed <= stated, "==": computed == stated, "!=": computed != stated}
    equal = F.abs(computed - stated) <= tolerance * F.greatest(F.abs(computed), F.abs(stated), F.lit(1.0))
    return F.when(equal, F.lit(comparator in ("==", ">=", "<="))).otherwise(exact[comparator])
