"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundline.llm.blocks import by_block, groups, matrix
from moundline.llm.common import table, written
from moundline.llm.embeddings import usable

#: Trees at most and those that are tried, vectors that the trees are fitted on at most, vectors a leaf is meant to hold, vectors of a side of a block.
TREES, TRIED, SAMPLE, LEAF, CHUNK, SEED = 10, (2, 4, 10), 20_000, 200, 2_048, 5
#: What a visit of a leaf costs besides its products, in products: a row that is made, moved and answered with a list.
VISIT = 2_000
#: The share of leaves to look into is set so that this recall is reached on the sample.
RECALL, TRIALS, TRIAL_ROWS = 0.96, 200, 6_000


class Forest:
    """Flat trees of one depth: node i has children 2i + 1 and 2i + 2; leaves are numbered from 0.

    normals (trees, nodes, dim) and offsets (trees, nodes); a vector goes right where normal . v > offset.
    """

    def __init__(self, sample: np.ndarray, n: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.depth = int(np.clip(np.ceil(np.log2(max(1, n) / LEAF)), 2, max(2, np.log2(max(4, len(sample) / 8)))))
        nodes = (1 << self.depth) - 1
        self.normals = np.zeros((TREES, nodes, sample.shape[1]))
        self.offsets = np.zeros((TREES, nodes))
        for t in range(TREES):
            here = {0: np.arange(len(sample))}
            for i in range(nodes):
                own = here.pop(i)
                w = rng.normal(size=sample.shape[1])
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    w = sample[a] - sample[b] if (sample[a] != sample[b]).any() else w
                w = w / np.linalg.norm(w)
                p = sample[own] @ w
                cut = float(np.median(p)) if len(own) else 0.0
                self.normals[t, i], self.offsets[t, i] = w, cut
                here[2 * i + 1], here[2 * i + 2] = own[p <= cut], own[p > cut]

    @property
    def trees(self) -> int:
        return len(self.normals)

    def first(self, trees: int, depth: int) -> Forest:
        """The forest of the first trees, of the upper levels of each."""
        out = copy.copy(self)
        nodes = (1 << depth) - 1
        out.normals, out.offsets, out.depth = self.normals[:trees, :nodes], self.offsets[:trees, :nodes], depth
        return out

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        flat = self.normals.reshape(-1, self.normals.shape[2])
        return (x @ flat.T - self.offsets.ravel()).reshape(len(x), self.trees, -1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each."""
        out = np.zeros((len(x), self.trees), np.int32)
        for lo in range(0, len(x), 2048):
            m = self.margins(x[lo : lo + 2048])
            at = np.zeros(m.shape[:2], int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.take_along_axis(m, at[:, :, None], 2)[:, :, 0] > 0)
            out[lo : lo + 2048] = at - (self.leaves - 1)
        return out

    def visits(self, margins: np.ndarray, sizes: np.ndarray, need: float, least: int = 0) -> list[tuple[int, int]]:
        """Leaves for one query: all trees share one queue, in which the branch that was missed by least comes first.

        Until they hold ``need`` vectors, and those of one tree, which are all distinct, ``least`` of them.
        """
        nodes, seen, out = self.leaves - 1, 0, []
        distinct = [0] * self.trees
        queue = [(0.0, t, 0) for t in range(self.trees)]
        while queue and (seen < need or max(distinct) < least):
            missed, t, i = heapq.heappop(queue)
            while i < nodes:
                m = margins[t, i]
                right = m > 0
                heapq.heappush(queue, (max(missed, abs(m)), t, 2 * i + 1 + (not right)))
                i = 2 * i + 1 + right
            leaf = i - nodes
            if sizes[t, leaf]:
                out.append((t, leaf))
                seen += sizes[t, leaf]
                distinct[t] += sizes[t, leaf]
        return out

    def share_for(self, sample: np.ndarray, k: int) -> float:
        """The least share of all (vector, tree) places whose visit finds RECALL of the k nearest, measured on the sample itself."""
        x = sample[:TRIAL_ROWS]
        leaf = self.leaf_of(x)
        sizes = np.stack([np.bincount(leaf[:, t], minlength=self.leaves) for t in range(self.trees)])
        trials = np.arange(min(TRIALS, len(x)))
        scores = x[trials] @ x.T
        scores[trials, trials] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return 1.0
        nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        margins = self.margins(x[trials])
        # For each true neighbour the share at which the first of its leaves is visited.
        first = np.full(nearest.shape, 1.0)
        for q in trials:
            visit, seen = np.full(sizes.shape, np.inf), 0
            for t, where in self.visits(margins[q], sizes, np.inf):
                seen += sizes[t, where]
                visit[t, where] = seen
            first[q] = visit[np.arange(self.trees)[None, :], leaf[nearest[q]]].min(1) / (len(x) * self.trees)
        return float(np.quantile(first.ravel(), RECALL))

    def chosen(self, sample: np.ndarray, k: int, n: int) -> tuple[Forest, float]:
        """Of the numbers of trees and the depths that are tried that with the least cost for the recall among ``n`` vectors, and its share of places.

        Depths: the full one, and one whose leaves hold about as many vectors as a visit costs products. Where vectors have
        no structure nearly all leaves are visited, so few large ones are better; else small ones save products.
        """
        level = int(np.clip(round(np.log2(max(1, n) / VISIT)), 2, self.depth))
        tried = [self.first(trees, depth) for trees in TRIED for depth in sorted({self.depth, level})]
        shares = [f.share_for(sample, k) for f in tried]
        return min(zip(tried, shares, strict=True), key=lambda x: (x[1] * x[0].trees * (n + VISIT * x[0].leaves), x[0].trees))


def _placed(forest):
    """A task that adds each vector's leaf in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = forest.value.leaf_of(matrix(batch.column("embedding"), np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaf), pa.list_(pa.int32()))], names=[*batch.schema.names, "leaf"])

    return run


def _probes(forest, sizes, need: float, least: int):
    """A task that lists the leaves to visit for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            cids = batch.column("cid").to_numpy()
            for lo in range(0, len(cids), 256):
                margins = f.margins(matrix(batch.column("embedding").slice(lo, 256), np.float64))
                found = [(c, t, leaf) for c, m in zip(cids[lo : lo + 256], margins, strict=True) for t, leaf in f.visits(m, sizes.value, need, least)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["cid", "tree", "leaf"])

    return run


def _top(scores: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller rid."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rid[at], -scores[at]))[:k]]


def _reranked(k: int):
    """A task over blocks: exact products of the leaf's vectors with the queries that visit it; the best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["tree", "leaf", "mc", "qc"]):
            query = g.column("query").to_numpy(zero_copy_only=False).astype(bool)
            if query.all() or not query.any():
                continue
            x, cid, rid = matrix(g.column("embedding"), np.float64), g.column("cid").to_numpy(), g.column("rid").to_numpy()
            scores = x[query] @ x[~query].T
            cm, rm = cid[~query], rid[~query]
            tops = [_top(s, rm, k) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[query]), pa.array([cm[t] for t in tops], pa.list_(pa.int64())), pa.array([rm[t] for t in tops], pa.list_(pa.int64())), pa.array([s[t] for s, t in zip(scores, tops, strict=True)], pa.list_(pa.float64()))],
                names=["query", "cid", "rid", "score"],
            )

    return run


def _merged(k: int):
    """A task over a query's lists: its best k classes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["query"]):
            cid, rid, score = (np.asarray(g.column(c).combine_chunks().flatten()) for c in ("cid", "rid", "score"))
            _, once = np.unique(cid, return_index=True)
            at = once[_top(score[once], rid[once], k)]
            yield pa.RecordBatch.from_arrays([pa.array([g.column("query")[0].as_py()] * len(at), pa.int64()), pa.array(cid[at]), pa.array(score[at])], names=["query", "cid", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` the k rows found of largest inner product, its own id left out.

    ``rows`` and ``queries`` have vec_id and embedding. Trees are fitted on the ``sample`` distinct vectors of lowest
    hash (documented bound), and as many of them, as deep, are used as cost least on it (Forest.chosen); every row is indexed. Each query walks all trees through one priority queue and looks into
    leaves until they hold the share of places that gave a recall of 0.96 on the sample: a small one where
    vectors have structure, a large one where they are noise; and until they hold k + 1 distinct vectors, or all. The products of leaf candidates are exact, in double.

    Equal vectors are one class with its k + 1 smallest ids, which is all that k nearest can show, so copies cannot
    fill a leaf; larger leaves and larger sets of queries are split into blocks. The driver sees the sample, the trees
    and the size of each leaf: all bounded by the parameters. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, as queries or candidates; rows with a null vec_id neither. Vectors of different
    lengths have no product: each length is searched by itself, one after the other. Repeated rows count once as
    candidates. Fewer than k candidates are all returned. Components may be of any numeric type, ids of any that casts to long.
    """
    fit = usable() & F.col("vec_id").isNotNull()
    # Single precision where both sides have it, else double.
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (rows, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    of = lambda df: df.filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).dropDuplicates(["vec_id", "embedding"])
    valid, asked = of(rows), of(queries)
    dims = [r[0] for r in asked.select(F.size("embedding")).distinct().collect()]
    each = [_nearest(*(df.filter(F.size("embedding") == dim) for df in (valid, asked)), k, sample) for dim in sorted(dims)]
    return reduce(DataFrame.unionByName, each, rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def _nearest(valid: DataFrame, asked: DataFrame, k: int, sample: int) -> DataFrame:
    """nearest() among distinct vectors of one length."""
    spark, kind = valid.sparkSession, valid.schema["embedding"].dataType.simpleString()
    ranked = valid.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = ranked.groupBy("embedding").agg(F.min("vec_id").alias("rid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # Numbers of written rows, so that no two classes share one.
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "ann-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = matrix(classes.orderBy(F.xxhash64("embedding"), "rid").limit(sample).select("embedding").toArrow().column("embedding"), np.float64)
    forest, share = Forest(fitted, n).chosen(fitted, k, n)
    forest = spark.sparkContext.broadcast(forest)
    members = classes.select("cid", "rid", "embedding").mapInArrow(_placed(forest), f"cid long, rid long, embedding {kind}, leaf array<int>")
    members = written(members, "ann-leaves")
    sizes = np.zeros((forest.value.trees, forest.value.leaves), np.int64)
    for r in members.select(F.posexplode("leaf").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r.tree, r.leaf] = r["count"]

    wanted = written(asked.select("embedding").distinct().withColumn("cid", F.monotonically_increasing_id()), "ann-queries")
    probes = written(wanted.mapInArrow(_probes(forest, spark.sparkContext.broadcast(sizes), share * n * forest.value.trees, k + 1), "cid long, tree int, leaf int"), "ann-probes")
    visits = probes.groupBy("tree", "leaf").count().collect()
    up = lambda x: int(-(-x // CHUNK))
    plan = F.broadcast(spark.createDataFrame([(r.tree, r.leaf, max(1, up(sizes[r.tree, r.leaf])), up(r["count"])) for r in visits], "tree int, leaf int, mcs int, qcs int"))
    part = lambda count: F.pmod(F.xxhash64("cid", F.lit("part")), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = members.select("cid", "rid", "embedding", F.posexplode("leaf").alias("tree", "leaf")).join(plan, ["tree", "leaf"])
    left = left.withColumns({"mc": part("mcs"), "query": F.lit(0)}).withColumn("qc", every("qcs"))
    right = probes.join(plan, ["tree", "leaf"]).withColumns({"qc": part("qcs"), "query": F.lit(1), "rid": F.lit(0).cast("long")}).withColumn("mc", every("mcs")).join(wanted, "cid")
    cols = ["tree", "leaf", "mc", "qc", "query", "cid", "rid", "embedding"]
    lists = by_block(left.select(*cols).unionByName(right.select(*cols)), ["tree", "leaf", "mc", "qc"]).mapInArrow(_reranked(k + 1), "query long, cid array<long>, rid array<long>, score array<double>")
    best = by_block(lists, ["query"]).mapInArrow(_merged(k + 1), "query long, cid long, score double")
    near = best.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    found = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(wanted, "embedding").select("query_id", "cid").join(lists, F.col("cid") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return found.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
