"""The corpus pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgrain.llm import decontam, linededup, ngramjoin, packing, toxicity
from rootgrain.llm.common import fresh, removed, scratch, shared_dir, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "_score")[0]
    return model.score(docs, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go."""
    others = F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]) if len(docs.columns) > 2 else F.lit(0)
    left = linededup.line_dedup(docs.select("doc_id", "text", others.alias("others"))).where("n_removed = 0 OR n_removed < n_lines")
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others.n_chars")) if "n_chars" in docs.columns else None
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": counted}
    return left.select(*[own.get(c, F.col("others")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngramjoin.one_of_each(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
    return packed.withColumns({"length": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")})


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL can express neither the learned score nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each result is a table in the shared folder until the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/rootgrain/stage-{name}-{uuid.uuid4().hex}"
        # Python workers outlive their stage: what large batches leave in them would be added to the next stage's memory
        with scratch(spark), small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
