"""The folder that driver and executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where nobody set it (tests on one machine) a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="rootgrain-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/rootgrain/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Jobs started within hand Python batches of about `most` bytes, so that a task's memory does not
    follow the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
