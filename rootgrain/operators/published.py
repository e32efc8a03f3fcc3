"""A published table beside an exported one: multisets of rows and of single columns, and columns by position.

Both tables hold texts and a column `line`, the place of a row; a cell that is null is empty, white space
around it does not count.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity

#: Ticks of a unit in a millisecond, which is what an exported instant keeps.
TICKS = {"ns": 1_000_000, "us": 1_000}
COMPARED = ("exact", "truncated", "normalised")
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Planned:
    """How one column is compared: exact, truncated (to milliseconds, from `unit`), normalised (by
    `transform`: upper-case, severity or alias), derived (the minute of the instant in `source`) or
    not-carried (the export leaves it empty)."""

    column: str
    kind: str = "exact"
    unit: str | None = None
    transform: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    source: str | None = None


def truncated(cell: Column, unit: str) -> Column:
    """An integer instant without what is below a millisecond, as text; null for any other text."""
    ticks = F.when(cell.rlike(r"^-?\d+$"), cell.try_cast("decimal(38,0)"))
    return (ticks - ticks % TICKS[unit]).cast("decimal(38,0)").cast("string")


def minute(cell: Column, unit: str) -> Column:
    """HH:MM, in UTC, of an integer instant; null for any other text."""
    ms = (truncated(cell, unit).cast("decimal(38,0)") / TICKS[unit]).cast("long")
    of_day = F.pmod(F.floor(ms / 60_000), F.lit(1440))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.floor(of_day / 60)), F.lit(":"), two(of_day % 60))


def _normalised(cell: Column, planned: Planned) -> Column:
    if planned.transform == "upper-case":
        return F.upper(cell)
    if planned.transform == "severity":
        return F.coalesce(severity(cell), F.upper(cell))
    out = F.when(F.lit(False), cell)
    for alias, name in planned.aliases.items():
        out = out.when(cell == alias, name)
    return out.otherwise(cell)


def _expected(cell: Column, planned: Planned) -> Column:
    """What the export should hold where the published table holds cell."""
    if planned.kind == "truncated":
        return truncated(cell, planned.unit or "ns")
    return _normalised(cell, planned) if planned.kind == "normalised" else cell


def compare(published: DataFrame, exported: DataFrame, plan: list[Planned]) -> DataFrame:
    """(column, kind, differ, lossy, absent): a row for each planned column and one, without a name, of
    kind `rows` for whole rows over the compared columns.

    differ counts cells that one side has more often than the other (the larger side), for derived columns
    places where the export is not the minute of the source, for not-carried ones cells that the export
    writes. lossy counts published cells that truncation or normalising changes, derived cells that the
    published table itself does not bear out, and cells that are not carried. absent names the side that
    lacks the column. Columns are read at places that both tables have; rows with an instant that is none
    are in no multiset. Of `rows`, differ counts the rows of the published table that the export lacks,
    lossy the reverse.

    Both tables meet once, by place; then each cell is counted in the task before it is shuffled.
    """
    cell = lambda side, df, name: F.trim(F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit(""))) if name in df.columns else F.lit("")
    joined = published.withColumn("_in", F.lit(True)).alias("p").join(exported.withColumn("_in", F.lit(True)).alias("e"), F.col("p.line") == F.col("e.line"), "full")
    here, there = F.coalesce("p._in", F.lit(False)), F.coalesce("e._in", F.lit(False))
    units = {p.column: p.unit for p in plan if p.kind == "truncated"}
    cells = [c for i, p in enumerate(plan) for c in (cell("p", published, p.column).alias(f"_p{i}"), cell("e", exported, p.column).alias(f"_e{i}"))]
    sources = [cell("p", published, p.source).alias(f"_s{i}") for i, p in enumerate(plan) if p.kind == "derived"]
    rows = joined.select(here.alias("_here"), there.alias("_there"), *cells, *sources)

    count = lambda condition: F.count(F.when(F.col("_here") & F.col("_there") & condition, 1))
    sums, values, signatures = [], [], ([], [])
    for i, p in enumerate(plan):
        mine, theirs = F.col(f"_e{i}"), F.col(f"_p{i}")
        differ, lossy = F.lit(0).cast("long"), F.lit(0).cast("long")
        if p.kind == "derived":
            known = p.column in published.columns and p.column in exported.columns and p.source in published.columns and p.source in units
            minutes = minute(F.col(f"_s{i}"), units[p.source]) if known else None
            differ, lossy = (count(mine != minutes), count(theirs != minutes)) if known else (count(F.lit(True)), lossy)
        elif p.kind == "not-carried":
            differ, lossy = count(mine != ""), count(theirs != "")
        else:
            expected = _expected(theirs, p)
            lossy = count(expected != theirs)
            paired = F.col("_here") & F.col("_there") & expected.isNotNull()
            values += [F.when(paired, F.struct(F.lit(i).alias("i"), v.alias("v"), F.lit(sign).alias("side"))) for v, sign in ((expected, 1), (mine, -1))]
            signatures[0].append(expected)
            signatures[1].append(mine)
        sums += [differ.alias(f"d{i}"), lossy.alias(f"l{i}")]
    whole = [F.when(F.col(present) & cells.isNotNull(), F.struct(F.lit(-1).alias("i"), cells.alias("v"), F.lit(sign).alias("side"))) for present, cells, sign in (("_here", _signature(signatures[0]), 1), ("_there", _signature(signatures[1]), -1))]

    entries = rows.select(F.explode(F.array(*values, *whole)).alias("c")).where("c IS NOT NULL").select("c.*")
    balance = entries.groupBy("i", "v").agg(F.sum("side").alias("n"))
    differences = balance.groupBy("i").agg(F.sum(F.greatest("n", F.lit(0))).alias("more"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("less"))

    absent = lambda p: {(False, False): "both", (False, True): "published", (True, False): "exported"}.get((p.column in published.columns, p.column in exported.columns))
    told = [F.struct(F.lit(i).alias("i"), F.lit(p.column).alias("column"), F.lit(p.kind).alias("kind"), F.col(f"d{i}").alias("d"), F.col(f"l{i}").alias("l"), F.lit(absent(p)).cast("string").alias("absent")) for i, p in enumerate(plan)]
    nothing = F.lit(None).cast("string")
    told.append(F.struct(F.lit(-1).alias("i"), nothing.alias("column"), F.lit("rows").alias("kind"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("l"), nothing.alias("absent")))
    columns = rows.agg(F.count("*").alias("_rows"), *sums).select(F.explode(F.array(*told)).alias("t")).select("t.*").join(differences, "i", "left")
    more, less = F.coalesce("more", F.lit(0)), F.coalesce("less", F.lit(0))
    is_rows, compared = F.col("kind") == "rows", F.col("kind").isin(*COMPARED)
    return columns.select("column", "kind", F.when(is_rows, more).when(compared, F.greatest(more, less)).otherwise(F.col("d")).alias("differ"), F.when(is_rows, less).otherwise(F.col("l")).alias("lossy"), "absent")


def _signature(cells: list[Column]) -> Column:
    """Cells as one text; null where one of them is."""
    return F.concat(*[c if i == 0 else F.concat(F.lit(SEPARATOR), c) for i, c in enumerate(cells)]) if cells else F.lit("")


def examples(published: DataFrame, exported: DataFrame, plan: list[Planned], most: int = 3) -> DataFrame:
    """(side, row): the first rows, in order of their text, that one side has more often: at most so many,
    those of the published table first."""
    cell = lambda df, name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")
    compared = [p for p in plan if p.kind in COMPARED]
    sides = published.select(_signature([_expected(cell(published, p.column), p) for p in compared]).alias("row"), F.lit(1).alias("n")).unionAll(exported.select(_signature([cell(exported, p.column) for p in compared]).alias("row"), F.lit(-1).alias("n")))
    only = sides.where("row IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n")).where("n != 0")
    return only.select(F.when(F.col("n") > 0, "published").otherwise("exported").alias("side"), F.replace("row", F.lit(SEPARATOR), F.lit(" | ")).alias("row")).orderBy(F.desc("side"), "row").limit(most)
