"""Profiles that add up: a sketch of each column for each part of a table, merged over parts without reading rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a HyperLogLog sketch (standard error 1.04 / sqrt(2 ** bits), 0.8 %), size of a KLL sketch (rank error under 1 % with 99 % confidence), items that a frequency sketch tracks.
HLL_BITS, KLL_SIZE, TRACKED = 14, 400, 1_000
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2), 0.01
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sketches(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, column_name, rows, nulls, distinct, quantiles (numeric columns) and frequent: one row a part and column, each of bounded size."""
    columns = [c for c in columns or df.columns if c not in by]
    kinds = {f.name: f.dataType for f in df.schema}
    named = lambda i, c: [
        F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS).alias(f"d{i}"),
        (F.expr(f"kll_sketch_agg_double(CAST(`{c}` AS DOUBLE), {KLL_SIZE})") if isinstance(kinds[c], _NUMBERS) else F.first(F.lit(None).cast("binary"))).alias(f"q{i}"),
        F.expr(f"approx_top_k_accumulate(CAST(`{c}` AS STRING), {TRACKED})").alias(f"t{i}"),
    ]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[a for i, c in enumerate(columns) for a in named(i, c)])
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"q{i}").alias("quantiles"), F.col(f"t{i}").alias("frequent")) for i, c in enumerate(columns)]
    return wide.select(*by, "rows", F.explode(F.array(*each)).alias("s")).select(*by, "s.column_name", "rows", "s.nulls", "s.distinct", "s.quantiles", "s.frequent")


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts as those of the whole, or of larger parts."""
    return parts.groupBy(*by, "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.bool_or(F.col("quantiles").isNotNull()), F.expr("kll_merge_agg_double(quantiles)")).alias("quantiles"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def profile(whole: DataFrame, top: int = 5, shares: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """rows, null_fraction, distinct (within DISTINCT_ERROR at three standard errors), quantiles by rank (within RANK_ERROR) and the ``top`` most frequent values with counts."""
    wanted = ", ".join(f"{s}D" for s in shares)
    keep = [c for c in whole.columns if c not in ("rows", "nulls", "distinct", "quantiles", "frequent")]
    return whole.select(
        *keep, "rows", (F.col("nulls") / F.col("rows")).alias("null_fraction"), F.hll_sketch_estimate("distinct").alias("distinct"),
        F.when(F.col("quantiles").isNotNull() & (F.col("nulls") < F.col("rows")), F.expr(f"kll_sketch_get_quantile_double(quantiles, array({wanted}))")).alias("quantiles"),
        F.expr(f"approx_top_k_estimate(frequent, {top})").alias("frequent"),
    )
