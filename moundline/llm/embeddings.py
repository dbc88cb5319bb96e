"""Embedding near-dedup: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.blocks import by_block, groups, in_blocks, matrix, roots
from moundline.llm.common import table, written
from moundline.llm.components import components

#: Vectors of a side of a block, and the share of pairs at the threshold that may share no table.
CHUNK, MISS, SEED = 512, 1e-7, 11


def usable(v: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a key and number of tables: about 64 of the ``n`` vectors of the largest label in a bucket if directions were spread evenly, and as many tables as miss at most MISS."""
    same = 1 - math.acos(min(1.0, cosine)) / math.pi
    bits = min(30, max(1, round(math.log2(max(1, n) / 64))))
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same**bits))) if same < 1 else 1


def _signed(bits: int, count: int):
    """A task that adds each vector's key in every table: the signs of its products with random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.asarray(x.values, np.float64) for x in batch.column("embedding")]
            sigs = np.zeros((len(vectors), count), np.int32)
            dims = np.array([len(v) for v in vectors], int)
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).normal(size=(dim, bits * count))
                at = np.flatnonzero(dims == dim)
                signs = (np.stack([vectors[i] for i in at]) @ planes[dim] > 0).reshape(len(at), count, bits)
                sigs[at] = signs @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "sig"])

    return run


def _linked(cosine: float):
    """A task over blocks: for each vector the number of others it is linked to there, and a link to the root of its part of the block.

    A pair counts in the first table in which both have one key, so it counts once although it may share many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        for g in groups(batches, ["label", "dim", "t", "key", "ca", "cb"]):
            side = g.column("side").to_numpy()
            x, sig = matrix(g.column("embedding"), np.float64), matrix(g.column("sig"), np.int32)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            t, cid, cnt = g.column("t")[0].as_py(), g.column("cid").to_numpy(), g.column("cnt").to_numpy()
            one = g.column("ca")[0].as_py() == g.column("cb")[0].as_py()
            a, b = (np.arange(len(side)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            i, j = np.nonzero(x[a] @ x[b].T >= cosine)
            i, j = a[i], b[j]
            new = (i < j) if one else np.ones(len(i), bool)
            new &= ~(sig[i, :t] == sig[j, :t]).any(1)
            i, j = i[new], j[new]
            if len(i):
                n = np.bincount(i, cnt[j], len(cid)) + np.bincount(j, cnt[i], len(cid))
                near = np.zeros((len(cid),) * 2, bool)
                near[i, j] = near[j, i] = True
                some = np.flatnonzero(n)
                root = some[roots(near[np.ix_(some, some)])]
                for col, values in zip(out, (cid[some], n[some].astype(np.int64), cid[root]), strict=True):
                    col.append(values)
            if sum(map(len, out[0])) > 50_000:
                yield _links_batch(out)
                out = [[], [], []]
        if out[0]:
            yield _links_batch(out)

    return run


def _links_batch(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["cid", "links", "root"])


def near_dedup(rows: DataFrame, cosine: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """``rows`` (vec_id, embedding, label) with n_links, component_id and kept.

    Vectors link if their labels are equal and not null and their cosine in double precision is at least ``cosine``.
    Candidates share a key of random-hyperplane signs in one of several tables; a pair at the threshold is missed
    with a probability of at most 1e-7. Equal vectors of a label are one class first, with their number, so copies
    are counted but not compared. A bucket of any size is compared in blocks of two chunks; blocks give counts and a
    spanning set of links, never pairs.

    A row whose vector is null, empty, zero or holds null or non-finite components, or whose label is null, links with
    nothing and is its own component. Repeated rows are vectors of their own that link as copies do. Rows with a null
    vec_id take part; a component of only such rows has a null id. Columns called n_links, component_id or kept are
    replaced. Vectors of different lengths never link. Components may be of any numeric type, labels of any that can be
    grouped and cast to text, ids of any type with an order.
    """
    spark = rows.sparkSession
    rows = rows.drop("n_links", "component_id", "kept")
    valid = usable() & F.col("label").isNotNull()
    same = ["label", "embedding"]
    # Numbers of written rows, so that no two classes share one.
    classes = rows.filter(valid).groupBy(*same).agg(F.count("*").alias("cnt"), F.min("vec_id").alias("rid"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, count = tables_for(largest, cosine)
    # Single precision and whole numbers as they are, other vectors in double, other labels as text.
    vectors = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    labels = "long" if rows.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    base = classes.select("cid", F.col("label").cast(labels).alias("label"), F.size("embedding").alias("dim"), "cnt", F.col("embedding").cast(vectors).alias("embedding"))
    signed = written(base.mapInArrow(_signed(bits, count), f"cid long, label {labels}, dim int, cnt long, embedding {vectors}, sig array<int>"), "signs")
    thin = signed.select("cid", "label", "dim", F.posexplode("sig").alias("t", "key"))
    dealt = in_blocks(thin, ["label", "dim", "t", "key"], "cid", chunk).join(signed.select("cid", "cnt", "embedding", "sig"), "cid")
    found = by_block(dealt, ["label", "dim", "t", "key", "ca", "cb"]).mapInArrow(_linked(cosine), "cid long, links long, root long")
    found = written(found, "links-found")
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    ids = classes.select("cid", *same, "cnt", "rid").join(reached, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = ids.groupBy("component").agg(F.min("rid").alias("component_id"))
    ids = ids.join(least, "component").join(counted, "cid", "left")
    ids = ids.select(*[F.col(c).alias(f"__{c}") for c in same], (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = rows.filter(valid).join(ids, [F.col(c) == F.col(f"__{c}") for c in same]).drop(*[f"__{c}" for c in same])
    linked = linked.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    alone = rows.filter(~valid).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("embedding", "label")


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (
  SELECT *, len(e) AS dim, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
  WHERE CASE WHEN a.dim = b.dim THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) END >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, MIN(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
k AS (SELECT a AS r, COUNT(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, COALESCE(k.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN k USING (r)
"""
