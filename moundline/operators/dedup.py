"""Keep-last dedup and the keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by ``order`` (ascending, null first). Null keys are equal. Spark limits each group before the shuffle."""
    desc = [F.col(o).desc_nulls_last() if isinstance(o, str) else o.desc_nulls_last() for o in order]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*desc))).filter("__r = 1").drop("__r")


def upsert(current: DataFrame, staged: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``current`` whose key is not staged, and all staged rows. Rows that are only in ``current`` stay."""
    return current.join(staged.select(*key), key, "left_anti").select(*current.columns).unionByName(staged)
