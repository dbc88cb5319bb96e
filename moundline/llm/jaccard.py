"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set overlaps decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.blocks import across_labels, arrays, by_block, groups, in_blocks, in_chunks
from moundline.llm.bloom import may_be_in
from moundline.llm.common import lean_batches, table, text_hash, written
from moundline.llm.components import components
from moundline.llm.hashing import shingles, word_hashes

#: Words of a shingle, similarity of a link, trees of the forest and minima in each, recall that prefixes are shortened for, documents with a match that it is measured on at least.
WORDS, SIMILARITY, TREES, DEPTH, RECALL, MEASURED, SEED = 5, 0.8, 16, 4, 0.9999, 1_000, 3
#: How far below the similarity an estimate from all minima may lie (four standard errors); sides of blocks; bytes of results after which a batch goes on.
SLACK, CHUNK, EXACT_CHUNK, COLUMNS = 0.2, 512, 256, 8_192

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(s: np.ndarray) -> np.ndarray:
    """The 32-bit MinHash signature of a set of hashes."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, lo : lo + 4096] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def found_at(similarity, depth: int):
    """The probability that two sets of this similarity share a prefix of ``depth`` minima in one of the trees."""
    return 1 - (1 - similarity**depth) ** TREES


def _read(text: pa.Scalar, words: int) -> np.ndarray:
    data = text.as_buffer() if text.is_valid else None
    return shingles(word_hashes(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), words)


def _signed(words: int):
    """A task: for each document the size of its shingle set, 128 bits that stand for the set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sigs = [], [], [], np.zeros((batch.num_rows, TREES * DEPTH), np.int32)
            for i, text in enumerate(batch.column("text")):
                s = _read(text, words)
                n.append(len(s))
                if len(s):
                    sigs[i] = minima(s)
                    one.append(int(s.sum().view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(s * _ODD[0] ^ (s >> np.uint64(29))).view(np.int64)))
                else:
                    one.append(None)
                    two.append(None)
            made = [pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sigs.shape[1]), pa.array(sigs.ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *made], names=["doc_id", "h", "n", "s1", "s2", "sig"])

    return run


def _near(similarity: float):
    """A task over blocks of a node of the tries: links to the root of those whose sizes and whole signatures allow the similarity.

    alike: by its signature, the similarity of a document's least similar match in the block. Two documents of one child
    of the node meet there; only others are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [[], [], []]
        for g in arrays(batches, ["node", "ca", "cb"], ("sig",)):
            one, cid, n, sig = g["ca"][0] == g["cb"][0], g["cid"], g["n"].astype(float), g["sig"]
            a, b = (np.arange(len(cid)),) * 2 if one else (np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1))
            if len(a) * len(b) <= 4096:
                same = (sig[a][:, None, :] == sig[b][None, :, :]).sum(2)
            else:
                same = np.zeros((len(a), len(b)), np.int16)
                for k in range(sig.shape[1]):
                    same += sig[a, k][:, None] == sig[b, k][None, :]
            x, y = np.nonzero(same >= (similarity - SLACK) * sig.shape[1])
            alike = same[x, y] / sig.shape[1]
            i, j = a[x], b[y]
            fit = (g["child"][i] != g["child"][j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            i, j, alike = i[fit], j[fit], alike[fit]
            weakest = np.ones(len(cid))
            np.minimum.at(weakest, i, alike)
            np.minimum.at(weakest, j, alike)
            for x, y in _spanning(i, j, len(cid)):
                for col, values in zip(out, (cid[x], cid[y], weakest[x]), strict=True):
                    col.append(values)
            if sum(map(len, out[0])) > 50_000:
                yield _pairs(out)
                out = [[], [], []]
        if out[0]:
            yield _pairs(out)

    return run


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row in a pair with the least row it reaches, by lowering labels along the pairs."""
    if len(i):
        label = np.arange(n)
        while True:
            before = label.copy()
            np.minimum.at(label, i, before[j])
            np.minimum.at(label, j, before[i])
            label = np.minimum(label, label[label])
            if (label == before).all():
                break
        moved = np.flatnonzero(label < np.arange(n))
        yield moved, label[moved]


def _pairs(cols: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["a", "b", "alike"])


def forest_links(classes: DataFrame, similarity: float, chunk: int, recall: float = RECALL, measured: int = MEASURED) -> tuple[DataFrame, int]:
    """a, b: links that connect what candidate pairs among ``classes`` (cid, n, sig) connect, and the depth at which the search ended.

    Each tree of the forest is a trie of signatures: its minima in order, sorted. Documents first match in the nodes of full
    depth. Then prefixes are shortened by one minimum at a time, in all trees together, and the children of each node
    that has several of them are compared with each other, until the target recall: a match of similarity s is found at
    depth d with the probability found_at(s, d), so those found stand for the sum of 1 / found_at of all there are.
    With fewer than ``measured`` documents matched the measure is not trusted, and prefixes are shortened until matches
    at the threshold itself have the recall.

    A node goes by a 64-bit hash of its prefix (two that share one are compared as one), and few nodes have several
    children, so the others' rows end where they are, at a Bloom filter of those nodes.

    Nodes of any size are compared in blocks. A node of more than ``chunk`` rows is first dealt into chunks, other ones in each
    tree, that are compared in themselves; at last, in large nodes of all depths at once, only documents that no links
    connect yet need to meet. So near copies, which are connected by then, move once a tree and depth however many there are;
    only documents that share a large node and are not alike are compared all with all. What is connected at last is the
    same as if all were.
    """
    trees = classes.select("cid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    start = F.col("tree") * DEPTH
    meet = lambda dealt, name: written(by_block(dealt.join(classes.select("cid", "n", "sig"), "cid"), ["node", "ca", "cb"]).mapInArrow(_near(similarity), "a long, b long, alike double"), name)
    links, large, depth = [], [], DEPTH
    while True:
        child = F.get("sig", start + depth).cast("long") if depth < DEPTH else F.col("cid")
        rows = trees.select("cid", F.xxhash64(F.lit(depth), "tree", F.slice("sig", start + 1, depth)).alias("node"), child.alias("child"))
        # Written, so that the joins stand between two exchanges and Spark splits a hot node.
        sizes = rows.groupBy("node").agg(F.count("*").alias("__n"), F.min("child").alias("x"), F.max("child").alias("y"))
        sizes = written(sizes.filter("x < y").select("node", "__n"), "node-sizes")
        dealt = written(in_chunks(may_be_in(rows, "node", sizes), sizes, ["node"], "cid", chunk), "forest-rows")
        links.append(meet(dealt.drop("__n"), f"forest-links{depth}"))
        large.append(dealt.filter(F.col("__n") > chunk).select("cid", "node", "child"))
        weakest = reduce(DataFrame.unionByName, links).groupBy("a").agg(F.greatest(F.min("alike"), F.lit(similarity)).alias("s"))
        there = 1 / (1 - F.pow(1 - F.pow("s", F.lit(depth)), F.lit(TREES)))
        counts = weakest.agg(F.count("*").alias("found"), F.sum(there).alias("all")).first()
        if depth == 1 or found_at(similarity, depth) >= recall or (counts["found"] >= measured and counts["found"] / counts["all"] >= recall):
            break
        depth -= 1
    found, large = (reduce(DataFrame.unionByName, x) for x in (links, large))
    if large.isEmpty():
        return found.select("a", "b"), depth
    labels = written(components(found.select("a", "b")), "labels")
    rows = large.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")
    across = meet(across_labels(rows, ["node"], "cid", "label", chunk), "links-across")
    return labels.toDF("a", "b").unionByName(across.select("a", "b")), depth


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, sets = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                sets.append(_read(text, words).view(np.int64))
                size += 8 * len(sets[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("cid").slice(lo, len(sets)), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "set"])
                    lo, size, sets = i + 1, 0, []

    return run


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a] with sets[b], by products of columns of the shingles that two or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        held[owner[x:y], column[x:y] - lo] = 1
        out += held[a] @ held[b].T
    return out


def _exact(similarity: float):
    """A task over blocks of candidate groups: exact Jaccard; for each document its links in the block and a link to its root there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["grp", "ca", "cb"]):
            cid, cnt, side = (g.column(c).to_numpy() for c in ("cid", "cnt", "side"))
            sets = [np.asarray(x.values) for c in g.column("set").chunks for x in c]
            one = g.column("ca")[0].as_py() == g.column("cb")[0].as_py()
            a, b = (np.arange(len(cid)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            if not len(a) or not len(b):
                continue
            n = np.array([len(s) for s in sets], float)
            both = overlaps(sets, a, b).astype(float)
            i, j = np.nonzero(both / (n[a][:, None] + n[b][None, :] - both) >= similarity)
            i, j = a[i], b[j]
            new = (i < j) if one else np.ones(len(i), bool)
            i, j = i[new], j[new]
            links = np.bincount(i, cnt[j], len(cid)) + np.bincount(j, cnt[i], len(cid))
            root = np.arange(len(cid))
            for x, y in _spanning(i, j, len(cid)):
                root[x] = y
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some].astype(np.int64)), pa.array(cid[root[some]])], names=["cid", "links", "root"])

    return run


def jaccard_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, chunk: int = CHUNK, exact_chunk: int = EXACT_CHUNK) -> DataFrame:
    """doc_id, h (hash of the text), class_id, copy_id, n_links and kept: one row for each of ``docs``.

    Documents link if the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity``. Words
    are runs of characters that are not ASCII white space, compared as they are; a text of fewer words is one shingle.
    class_id is the smallest doc_id reachable by links, itself included; copy_id the smallest of equal sets; n_links
    counts the other documents linked directly, equal ones included; kept marks the one document of each class with
    the smallest doc_id (null first; then the smaller text hash).

    Equal sets (of 128 bits) are one class first. Signatures form a forest of sorted prefix tries, whose matched prefixes are
    shortened until the target recall (forest_links); those under one prefix are compared by their whole signatures in
    blocks. What may reach the similarity forms candidate groups, and their sets are intersected exactly, in blocks
    again. Blocks give counts and spanning links, never pairs, so a group of copies of any size is whole and bounded in
    memory.

    Null texts and texts without words have no shingles and link with nothing, each its own class. Rows that repeat
    doc_id and text are documents of their own that link as copies do, all of them kept or none. Other columns
    of ``docs`` are not read; doc_id may be of any type with an order. Words are told apart by 64-bit hashes.

    With fewer than MEASURED documents matched in the forest, the depth of its prefixes is that of the target recall for
    matches at the threshold itself, not the measured one; the result is the same up to that recall.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_hash().alias("h"), "text")
    signed = written(rows.mapInArrow(_signed(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n int, s1 long, s2 long, sig array<int>"), "signatures")
    same = ["s1", "s2", "n"]
    classes = signed.filter("n > 0").groupBy(*same).agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "h")).alias("rep"), F.first("sig").alias("sig"))
    # Numbers of written rows, so that no two classes share one.
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    near, _ = forest_links(classes.select("cid", "n", "sig"), similarity, chunk)
    candidates = written(components(near), "candidates").select(F.col("node").alias("cid"), F.col("component").alias("grp"))

    key = F.xxhash64("doc_id", "h").alias("__key")
    wanted = written(candidates.join(classes, "cid").select("cid", "rep.doc_id", "rep.h").withColumn("__key", key), "wanted")
    texts = may_be_in(rows.withColumn("__key", key), "__key", wanted).drop("__key")
    texts = texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.h == wanted.h)).select("cid", "text").dropDuplicates(["cid"])
    sets = written(texts.mapInArrow(_sets(words), "cid long, set array<long>"), "sets")
    dealt = in_blocks(candidates, ["grp"], "cid", exact_chunk).join(classes.select("cid", "cnt"), "cid").join(sets, "cid")
    found = by_block(dealt, ["grp", "ca", "cb"]).mapInArrow(_exact(similarity), "cid long, links long, root long")
    found = written(found, "jaccard-links")

    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    ids = classes.select("cid", *same, "cnt", "rep").join(reached, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = ids.groupBy("component").agg(F.min("rep").alias("first"))
    ids = ids.join(least, "component").join(counted, "cid", "left").select(*same, "first", "rep", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    out = signed.filter("n > 0").select("doc_id", "h", *same).join(ids, same)
    out = out.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), F.col("rep.doc_id").alias("copy_id"), "n_links", F.struct("doc_id", "h").eqNullSafe(F.col("first")).alias("kept"))
    alone = signed.filter("n = 0").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT r, COUNT(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT o.a, o.b, k = x.n AND k = y.n AS equal FROM o JOIN n x ON x.r = o.a JOIN n y ON y.r = o.b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, MIN(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a),
k AS (SELECT l.a AS r, COUNT(*) AS n_links, MIN(d.doc_id) FILTER (WHERE equal) AS twin FROM l JOIN d ON d.r = l.b GROUP BY l.a)
SELECT d.doc_id, c.class_id, LEAST(d.doc_id, k.twin) AS copy_id, COALESCE(k.n_links, 0)::BIGINT AS n_links, d.doc_id IS NOT DISTINCT FROM c.class_id AS kept
FROM d JOIN c USING (r) LEFT JOIN k USING (r)
"""
