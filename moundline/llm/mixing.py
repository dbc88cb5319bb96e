"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundline.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: The hash has 60 bits; each level of histograms takes 10 of them.
LEVELS, LEVEL_BITS = 6, 10
#: Sources that are put in order in one task and whose plan (some hundred bytes each) may be broadcast; with more, they are sorted by range, and each source's documents are dealt into SALTS parts.
BROADCAST_SOURCES, SALTS = 100_000, 32


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of an md5 of doc_id and text, so any engine can repeat it."""
    whole = F.concat_ws("-", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text)), F.lit("null")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _before(rows: DataFrame, order: list[Column], sums: list[str], one_task: bool) -> DataFrame:
    """``rows`` with before (how many come before it by ``order``) and before_c, the sum of column c over those.

    In ``one_task``, for a bounded number of rows; else the rows are sorted by range, numbered within each part, and parts by the sums before them.
    """
    back = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = {"before": F.lit(1), **{f"before_{c}": F.col(c) for c in sums}}
    over = lambda w: {name: F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in every.items()}
    if one_task:
        return rows.withColumns(over(back(Window.partitionBy())))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "mixing-ordered")
    parts = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{name}") for name, c in every.items()])
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{name}").over(upto), F.lit(0)).alias(f"__{name}") for name in every])
    rows = rows.withColumns(over(back(Window.partitionBy("__part")))).join(F.broadcast(parts), "__part")  # one row a part
    return rows.withColumns({name: F.col(name) + F.col(f"__{name}") for name in every}).drop("__part", *[f"__{name}" for name in every])


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, one_task: int = BROADCAST_SOURCES) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all sizes. A target stops
    at ``most`` times its source's size; the excess goes to the others by weight until none is above. With the sources
    sorted by cap a unit of weight that is a water level: those before the level are full, the others get it by weight.
    Up to ``one_task`` sources, one row each, are put in order in one task; more are sorted by range.
    """
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mixing-per-source")
    few = per.count() <= one_task
    by_name = F.col("source").asc_nulls_last()
    per = _before(per, [by_name], [], few)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")).drop("before")
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("x", F.col("cap") / F.col("w"))
    sizes, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    per = _before(per, [F.col("x").asc(), by_name], ["source_size", "w"], few)
    level = (F.lit(float((sizes or 0) * share)) - F.col("before_source_size") * F.lit(float(most))) / (F.lit(weight or 0) - F.col("before_w"))
    per = written(per.withColumn("level", level), "mixing-levels")
    water = per.agg(F.max(F.when(F.col("x") > F.col("level"), F.col("level")))).first()[0]
    return per.select("source", "source_size", (F.col("cap") if water is None else F.least(F.col("cap"), F.lit(water) * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source the nested budget threshold of its hash, without sorting documents.

    ``sized``: skey, size, hash. ``budgets``: skey, budget. Each level sums sizes by source and the next bits of the
    hash (partial sums on the map side, so a hot source is no hot key), finds the bucket in which the running sum
    passes the budget, and looks only into that bucket on the next level. Larger budgets have larger thresholds over
    the same hash, so the picks nest. Returns skey, threshold, take, tied: a document is in if its hash is below the
    threshold, and so are ``take`` of the ``tied`` documents whose hash equals it: as many of these equal rows as come
    nearest to the budget. Windows run over at most 2**10 buckets a source.
    """
    state = budgets.select("skey", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = []
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = sized.join(state, "skey").filter(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("skey", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.max("budget").alias("budget"), F.max("below").alias("below")
        )
        upto = F.col("below") + F.sum("size").over(Window.partitionBy("skey").orderBy("bucket"))
        buckets = buckets.withColumn("upto", upto)
        last = level == LEVELS - 1
        # Rows of one hash are equal, so half of one of them decides about the last.
        over = (F.col("upto") - F.col("size") / F.col("rows") / 2.0 > F.col("budget")) if last else (F.col("upto") > F.col("budget"))
        crossing = buckets.filter(over).groupBy("skey").agg(F.min(F.struct("bucket", "upto", "size", "budget", "rows")).alias("b"))
        crossing = crossing.select("skey", "b.budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.size")).alias("below"), "b.size", "b.rows")
        crossing = written(crossing, f"mixing-level{level}")
        ended = state.join(crossing.select("skey"), "skey", "left_anti")
        none = F.lit(0).cast("long")
        done.append(ended.select("skey", F.shiftleft(F.col("prefix") + 1, shift + LEVEL_BITS).alias("threshold"), none.alias("take"), none.alias("tied")))
        state = crossing if last else crossing.drop("size", "rows")
    near = F.floor((F.col("budget") - F.col("below")) * F.col("rows") / F.col("size") + 0.5)
    done.append(state.select("skey", F.col("prefix").alias("threshold"), F.greatest(F.lit(0), F.least("rows", near)).cast("long").alias("take"), F.col("rows").alias("tied")))
    return reduce(DataFrame.unionByName, done)


def _numbered(tied: DataFrame) -> DataFrame:
    """``tied`` with __number, from 1 within each __skey. Rows are numbered in the parts in which they were written, and parts by sums before them, so no task sees more of a source than one part."""
    rows = written(tied.withColumns({"__file": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "mixing-tied")
    parts = rows.groupBy("__skey", "__file").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__skey").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__skey", "__file").orderBy("__row"))
    return rows.withColumn("__number", within).join(parts, ["__skey", "__file"]).withColumn("__number", F.col("__number") + F.col("__before")).drop("__file", "__row", "__before")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    Every document of a source is taken ``floor(target / source_size)`` times; the rest of the target is filled with
    one copy more of the documents whose hash is below the source's threshold. Null text counts 0 words; null source is
    a source of its own, the last. Rows that repeat doc_id, text and source share one hash; where they lie on the
    threshold, as many of them are taken as come nearest to the target (which of these is not defined, how many is). An empty table
    gives an empty result; a source without words has target 0. Columns of ``docs`` that are called like one of the
    five new ones are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*new)
    skey = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))
    sized = written(docs.select(F.col("source"), skey.alias("skey"), n_words().alias("size"), hash60().alias("hash")), "mixing-sizes")
    per = source_targets(sized, weights, share, most, broadcast_sources).withColumn("skey", skey)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = written(per.withColumn("base", base), "mixing-sources")
    budgets = per.select("skey", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"))
    cut = thresholds(sized, budgets)
    plan = written(per.join(cut, "skey", "left").select(F.col("skey").alias("__s"), "source_size", "target", F.col("base").alias("__base"), F.col("threshold").alias("__threshold"), "take", "tied"), "mixing-plan")
    ties = plan.filter("take > 0 and take < tied").limit(1).count()
    # All or none of the rows on the threshold are in, as long as not a part of equal ones is.
    plan = plan.withColumn("__tie", (F.col("take") > 0) & (F.col("take") < F.col("tied"))).withColumn("__threshold", F.col("__threshold") + F.when((F.col("take") > 0) & ~F.col("__tie"), 1).otherwise(0))
    plan = plan.withColumnRenamed("take", "__take").drop("tied")
    out = docs.withColumns({"__skey": skey, "size": n_words(), "__hash": hash60()})
    if plan.count() <= broadcast_sources:  # texts stay where they are
        out = out.join(F.broadcast(plan), F.col("__skey") == F.col("__s"), "left")
    else:
        plan = plan.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.col("__hash"), F.lit(SALTS)).cast("int")
        out = out.withColumn("__p", part).join(plan, (F.col("__skey") == F.col("__s")) & (F.col("__p") == F.col("__part")), "left").drop("__p", "__part")
    more = F.col("__hash") < F.col("__threshold")
    out = out.withColumn("__more", more)
    if ties:
        tie = F.coalesce(F.col("__tie") & (F.col("__hash") == F.col("__threshold")), F.lit(False))
        some = _numbered(out.filter(tie)).withColumn("__more", F.col("__number") <= F.col("__take")).drop("__number")
        out = out.filter(~tie).unionByName(some)
    copies = F.coalesce(F.col("__base") + F.when(F.col("__more"), 1).otherwise(0), F.lit(0)).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("__skey", "__hash", "__s", "__base", "__threshold", "__more", "__take", "__tie")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null') || '-' || COALESCE(md5(text), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
x AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS x FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER ()::DOUBLE
             - 2.0::DOUBLE * COALESCE(SUM(source_size) OVER (ORDER BY x, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / SUM(w) OVER (ORDER BY x, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM x),
m AS (SELECT *, MAX(CASE WHEN x > level THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE LEAST(cap, water * w) END AS target FROM m),
b AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
j AS (
  SELECT d.doc_id, d.size, d.h, b.*, row_number() OVER o AS place, SUM(d.size) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source WINDOW o AS (PARTITION BY d.source ORDER BY d.h)),
k AS (SELECT *, bool_or(upto - size / 2.0 > target - base * source_size) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS past FROM j)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN past THEN 0 ELSE 1 END))::BIGINT AS taken,
       source, (base + CASE WHEN past THEN 0 ELSE 1 END)::BIGINT AS copies
FROM k
"""
