"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.session import LEFT, delete, release, temporary  # noqa: F401  release: for users of this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder, read again.

    Lost executors cost nothing that has been written. Results are lazy and read these tables, so they stay until
    release() or until the folder goes.
    """
    path = temporary(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing lazy reads any more: what was made of them is written itself."""
    for t in tables:
        delete(t.sparkSession, t._written)
        LEFT.remove(t._written)


def text_hash(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id apart by their text; rows that repeat both are treated alike."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def tasks_for(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: at most ``rows`` of them go to a Python worker at once, which keeps both its memory and the JVM's buffers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
