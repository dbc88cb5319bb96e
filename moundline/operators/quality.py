"""Checks and profiles of a pitch table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundline.operators.clean import count_label
from moundline.schema import FOLDED, PITCH_KEY


def _all(c: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))


def quality_checks(df: DataFrame) -> DataFrame:
    """check, ok: one row a check. A null fails a check, an empty table passes all of them. Two scans: one for the rows, one for their keys; each ends as one row."""
    checks = {
        "legal_counts": F.col("balls").between(0, 3) & F.col("strikes").between(0, 2),
        "no_null_types": F.col("pitch_type").isNotNull(),
        "no_folded_codes": ~F.coalesce(F.col("pitch_type").isin(list(FOLDED)), F.lit(False)),
        "no_exhibitions": ~F.coalesce(F.col("game_type").isin("S", "E", "A"), F.lit(False)),
        "plausible_speed": F.col("release_speed").between(50, 110),
        "key_not_null": reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in PITCH_KEY]),
    }
    one = df.agg(*[_all(c).alias(k) for k, c in checks.items()], (F.count_distinct(count_label()) <= 12).alias("at_most_12_counts"))
    once = df.groupBy(*PITCH_KEY).agg(F.count("*").alias("n")).agg(_all(F.col("n") == 1).alias("key_unique"))
    names = [*checks, "at_most_12_counts", "key_unique"]
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("ok")) for k in names]))
    return one.crossJoin(once).select(stacked.alias("x")).select("x.check", "x.ok")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n: the null group included, most frequent first."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last())


def null_fractions(df: DataFrame, above: float = 0.5, most: int = 8) -> DataFrame:
    """column_name, null_fraction of the columns with more nulls than ``above``: the first ``most``."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_fraction")) for c in df.columns])).alias("x")).select("x.*")
    return rows.filter(F.col("null_fraction") > above).orderBy(F.desc("null_fraction"), "column_name").limit(most)


def speed_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("release_speed").alias("min_speed"), F.max("release_speed").alias("max_speed"))


def row_counts(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """raw, cleaned, removed."""
    both = raw.select(F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(cleaned.select(F.lit(0).alias("r"), F.lit(1).alias("c")))
    return both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("raw"), F.coalesce(F.sum("c"), F.lit(0)).alias("cleaned")).withColumn("removed", F.col("raw") - F.col("cleaned"))
