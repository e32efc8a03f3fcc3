"""Records of evaluation runs: what a run answered, pinned to the key that it was graded against.

key: sample_id, type, category, component (what is expected). answers: sample_id, parsed, type,
category, component.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples

FIELDS = ("type", "category", "component")


def key_digest(key: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """(size, digest): one row. Every sample is a line id|type|category|component; the digest is the SHA-256 of
    all lines in order, with a line feed after each. Raises, when it is read, where a sample lacks an
    expectation.

    Lines are sorted over all tasks, which join theirs into pieces of about `piece` characters; only the
    pieces meet, one after the other, in the one hash that such a digest takes.
    """
    told = F.when(F.expr(" AND ".join(f"{f} IS NOT NULL" for f in FIELDS)), F.concat_ws("|", F.col("sample_id").cast("string"), *FIELDS)).otherwise(F.raise_error(F.concat(F.lit("an expectation is missing in sample "), F.col("sample_id").cast("string"))))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            held, size, part = [], 0, batch.column("part")[0].as_py() if batch.num_rows else 0
            for line in batch.column("line").to_pylist():
                held.append(line)
                size += len(line)
                if size >= piece:
                    yield pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n": [len(held)], "text": ["\n".join(held) + "\n"]}, kind)
                    held, size, number = [], 0, number + 1
            if held:
                yield pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n": [len(held)], "text": ["\n".join(held) + "\n"]}, kind)
                number += 1

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, h = 0, hashlib.sha256()
        for batch in batches:
            size += sum(batch.column("n").to_pylist())
            for text in batch.column("text"):
                h.update(text.as_py().encode())
        yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "digest": [h.hexdigest()]})

    kind = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("n", pa.int64()), ("text", pa.string())])
    lines = key.select(told.alias("line")).repartitionByRange("line").sortWithinPartitions("line").select(F.spark_partition_id().alias("part"), "line")
    cut = lines.mapInArrow(pieces, "part int, number long, n long, text string")
    told = cut.repartition(1).sortWithinPartitions("part", "number").mapInArrow(one, "size long, digest string")
    return told.agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"), F.coalesce(F.max(F.when(F.col("size") > 0, F.col("digest"))), F.sha2(F.lit("\n"), 256)).alias("digest"))


def _answers(answers: DataFrame) -> DataFrame:
    return answers.select("sample_id", *[F.when(F.coalesce("parsed", F.lit(False)), F.col(f)).alias(f) for f in FIELDS])


def reading(key: DataFrame, answers: DataFrame) -> DataFrame:
    """(sample_id, type, category, component, told_type, told_category, told_component): what a run is recorded as.

    Raises, when it is read, where a sample has no answer or several, an answer has no sample, or an
    answer could not be parsed: such a run's totals would be of another denominator."""
    told = answers.select("sample_id", F.when(~F.coalesce("parsed", F.lit(False)), F.raise_error(F.concat(F.lit("not a reading: sample "), F.col("sample_id").cast("string")))).cast("string").alias("_bad"), *[F.col(f).alias(f"told_{f}") for f in FIELDS])
    return samples.pair(key.select("sample_id", *FIELDS), told).where("_bad IS NULL").select("sample_id", *FIELDS, *[f"told_{f}" for f in FIELDS])


def totals(reading: DataFrame) -> DataFrame:
    """(type, category, component, strict): how many samples have each field right, and all three."""
    right = {f: F.col(f).eqNullSafe(F.col(f"told_{f}")) for f in FIELDS}
    every = right["type"] & right["category"] & right["component"]
    return reading.agg(*[F.count(F.when(c, 1)).alias(f) for f, c in (right | {"strict": every}).items()])


def differences(reading: DataFrame, answers: DataFrame, stated: dict[str, int]) -> DataFrame:
    """(kind, sample_id, field, recorded, artefact): where a recorded reading and the answers of its run disagree.

    field: an answer differs; missing: a recorded sample has no answer (recorded is its component, or
    else its type); extra: an answer that is not recorded; total: a stated total is not what the rows
    sum up to, the record's number first. Where the answers have a sample twice, the larger one counts.
    """
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    theirs = _answers(answers).groupBy("sample_id").agg(F.max(F.struct(*FIELDS)).alias("a"), F.lit(True).alias("there"))
    both = reading.withColumn("here", F.lit(True)).join(theirs, "sample_id", "full")
    row = lambda kind, field, recorded, artefact: F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), recorded.alias("recorded"), artefact.alias("artefact"))
    fields = [F.when(~F.col(f"told_{f}").eqNullSafe(F.col("a")[f]), row("field", f, text(F.col(f"told_{f}")), text(F.col("a")[f]))) for f in FIELDS]
    found = (
        F.when(F.col("here").isNull(), F.array(row("extra", None, none, text(F.coalesce(F.col("a")["type"], F.col("a")["component"])))))
        .when(F.col("there").isNull(), F.array(row("missing", None, text(F.coalesce("told_component", "told_type")), none)))
        .otherwise(F.array_compact(F.array(*fields)))
    )
    rows = both.select(F.col("sample_id"), F.explode(found).alias("d")).select("d.kind", "sample_id", "d.field", "d.recorded", "d.artefact")
    implied = totals(reading)
    moved = implied.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(str(stated[f])).alias("recorded"), text(F.col(f)).alias("artefact")) for f in (*FIELDS, "strict")])).alias("t")).where("t.recorded != t.artefact")
    return rows.unionByName(moved.select(F.lit("total").alias("kind"), F.lit(None).cast(reading.schema["sample_id"].dataType).alias("sample_id"), "t.field", "t.recorded", "t.artefact"))
