"""Line dedup by winnowing over line hashes; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.common import table, text_hash, written

MIN_LINES, MIN_WORDS = 3, 50


def _fingerprints(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """A row for each selected window minimum: doc_id, h (hash of the text), p (its line), fp (the line's hash) and extents.

    Windows are all runs of ``min_lines`` lines and all shorter ones that together have ``min_words`` words; each selects
    its least line hash, the leftmost of equal ones. So two equal windows have a fingerprint at the same place: it is
    guaranteed. extents: the windows that selected it, as lines before it (l) and after it (r) with 128 bits of hash over their text (k1, k2).
    """
    d = docs.select("doc_id", text_hash().alias("h"), F.split(F.col("text"), "\n", -1).alias("lines")).filter("lines is not null")
    d = d.withColumns({"hs": F.transform("lines", lambda x: F.xxhash64(x)), "words": F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+")))})

    def extent(p: Column, before: int, after: int) -> Column:
        near = range(-before, after + 1)
        # Beyond the ends of the text get() is null, and so is the condition.
        least = reduce(Column.__and__, [F.get("hs", p + j) > F.get("hs", p) if j < 0 else F.get("hs", p + j) >= F.get("hs", p) for j in near])
        if before + after + 1 < min_lines:
            least = (reduce(Column.__add__, [F.get("words", p + j) for j in near]) >= min_words) & least
        text = [F.get("lines", p + j) for j in near]
        # The tag comes first, as each hash goes on from the one before: the two are independent.
        return F.when(least, F.struct(F.lit(before).alias("l"), F.lit(after).alias("r"), F.xxhash64(F.lit("1"), *text).alias("k1"), F.xxhash64(F.lit("2"), *text).alias("k2")))

    shapes = [(before, n - 1 - before) for n in range(1, min_lines + 1) for before in range(n)]
    at = lambda p: F.struct(p.alias("p"), F.get("hs", p).alias("fp"), F.filter(F.array(*[extent(p, *s) for s in shapes]), lambda x: x.isNotNull()).alias("extents"))
    return d.select("doc_id", "h", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), at))).filter(F.size("extents") > 0)


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text``; n_lines and n_removed are added.

    A line goes if it lies in a run of at least ``min_lines`` lines, or of lines with at least ``min_words`` words
    together, that also starts earlier: in a document of smaller doc_id (null first; of equal ids that with the smaller text hash) or
    further up in its own. What is first stays. Lines end at ``\\n`` and are compared as they are.

    Only the window minima are written, as fingerprints with their positions. Those that occur once are dropped. From
    each position of the others the match is extended by lines to both sides, to every extent that its windows have;
    positions whose extents are equal are joined to the first of them, and the later ones' lines go. Overlapping extents
    make up runs of any length. Groups are reduced with min and count on the map side and joined to one row, so a line
    that a third of all documents hold makes neither pairs nor a hot task. Null text stays null with 0 lines; an empty
    text is one empty line; rows that repeat doc_id and text are treated alike; columns called n_lines or n_removed are
    replaced.
    """
    marks = written(_fingerprints(docs, min_lines, min_words), "line-fingerprints")
    # The counted sides are written, so that each join stands between two exchanges and Spark splits a hot key of it.
    repeated = written(marks.groupBy("fp").count().filter("count > 1").select("fp"), "line-repeated")
    near = marks.join(repeated, "fp", "left_semi").select("doc_id", "h", "p", F.inline("extents"))
    near = written(near.select("k1", "k2", F.struct("doc_id", "h", (F.col("p") - F.col("l")).alias("i")).alias("at"), (F.col("l") + F.col("r") + 1).alias("n")), "line-positions")
    first = near.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    first = written(first, "line-firsts")
    later = near.join(first, ["k1", "k2"]).filter(~F.col("at").eqNullSafe(F.col("first")))
    cut = later.select("at.doc_id", "at.h", F.explode(F.sequence(F.col("at.i"), F.col("at.i") + F.col("n") - 1)).alias("line"))
    cut = cut.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("line").alias("__cut"))
    docs = docs.drop("n_lines", "n_removed")
    out = docs.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__h")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__cut"), lambda i: F.get("__lines", i))
    gone = F.when(F.col("__cut").isNull(), F.lit(0)).otherwise(F.size("__cut"))
    out = out.withColumns({"n_lines": n.cast("long"), "n_removed": gone.cast("long"), "__lines": F.when(F.col("__cut").isNotNull(), lines)})
    return out.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__id", "__h", "__cut", "__lines")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3,
         len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words, len(regexp_extract_all(lead(line, 1) OVER o, '[^ \t\n\x0B\f\r]+')) AS words2
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (
  SELECT doc_id, i, 3 AS n, line || chr(10) || l2 || chr(10) || l3 AS k FROM w WHERE l3 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, line || chr(10) || l2 FROM w WHERE l2 IS NOT NULL AND words + words2 >= 50
  UNION ALL SELECT doc_id, i, 1, line FROM w WHERE words >= 50),
f AS (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS r FROM u),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM f, (VALUES (0), (1), (2)) AS t(j) WHERE r > 1 AND j < n),
g AS (
  SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(c.i) AS n_removed,
         sha256(COALESCE(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '')) AS kept_sha256
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, COALESCE(g.n_lines, 0)::BIGINT AS n_lines, COALESCE(g.n_removed, 0)::BIGINT AS n_removed, COALESCE(g.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
