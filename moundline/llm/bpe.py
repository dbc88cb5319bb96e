"""Byte-level BPE encoding and decoding by overlapping chunks."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.common import lean_batches, table, tasks_for, written

CHUNK, OVERLAP = 32_768, 1_024
#: A token starts right where the pattern says so if this many characters more are in sight ("'re" is three long).
SIGHT = 4
#: Pre-tokens kept with their ids in each of two generations of a Python worker's cache, and the longest such one.
CACHE, CACHE_BYTES = 250_000, 64
_NONE = 1 << 60
#: Bytes of results after which a task hands a batch on.
BATCH = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Cache(dict):
    """Pre-tokens to the bytes of their ids, made when first asked for. When it is full, what was not used since it last was goes."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merge(word.encode("utf-8", "surrogatepass")).tobytes()
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Merges of one vocabulary over pre-tokens; a helper for the tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), _Cache(self.merge)
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b

    def merge(self, word: bytes) -> array:
        """The ids of one pre-token: always the pair of lowest rank first, the leftmost of equal ones."""
        if (whole := self.ranks.get(word)) is not None:
            return array("i", [whole])
        return self.merge_short(word) if len(word) <= CACHE_BYTES else self.merge_long(word)

    def merge_short(self, word: bytes) -> array:
        """A list of parts and one of the ranks of its pairs; the square of the length, but small."""
        get = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < _NONE:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        return array("i", [self.ranks[p] for p in parts])

    def merge_long(self, word: bytes) -> array:
        """A heap of pairs; n log n for runs of any length."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = end[i]
            return ranks.get(word[i : end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(i)) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, stop))
        ids, i = array("i"), 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> array:
        ids, of = array("i"), self.cache
        ids.frombytes(b"".join([of[word] for word in self.pattern.findall(text)]))
        return ids

    def decode(self, ids: array) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


def _encoded(path_or_ranks, pattern: str, keys: list[str]):
    """A task that appends ids and decoded to the key columns of its rows and drops their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path_or_ranks.value, pattern)
        for batch in batches:
            texts, start, size, ids, decoded = batch.column("text"), 0, 0, [], []

            def flush(stop: int) -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)  # noqa: B023
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids]) if offsets[-1] else np.array([], np.int32)  # noqa: B023
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary())]  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(k).slice(start, stop - start) for k in keys] + made, names=[*keys, "ids", "decoded"])  # noqa: B023

            for i in range(len(texts)):
                ids.append(encoder.encode(texts[i].as_py() or ""))
                decoded.append(encoder.decode(ids[-1]))
                size += 4 * len(ids[-1]) + len(decoded[-1])
                if size > BATCH:
                    yield flush(i + 1)
                    start, size, ids, decoded = i + 1, 0, [], []
            if ids:
                yield flush(len(texts))

    return run


def _chunked(chunk: int, overlap: int):
    """A task that cuts texts into chunks of ``chunk`` characters plus ``overlap`` of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                whole, key = text.as_py(), key.as_py()
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for lot in range(0, len(starts), 64):
                    ks = list(range(lot, min(lot + 64, len(starts))))
                    cut = [whole[k * chunk : (k + 1) * chunk + overlap if k + 1 < len(starts) else len(whole)] for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(ks)), pa.array(ks, pa.int32()), pa.array([k + 1 == len(starts) for k in ks]), pa.array(cut)], names=["key", "k", "last", "text"])

    return run


def _seams(pattern: str, chunk: int, overlap: int):
    """A task that pre-tokenises each chunk from its own start: token starts in its first and last ``overlap`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column("text"), batch.column("last"), strict=True):
                starts = [m.start() for m in compiled.finditer(text.as_py())]
                n = len(text.as_py())
                heads.append([x for x in starts if x < overlap and x <= n - SIGHT])
                tails.append([] if last.as_py() else [x - chunk for x in starts if chunk <= x <= n - SIGHT])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), batch.column("last"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["key", "k", "last", "head", "tail"])

    return run


def _cut(chunk: int):
    """A task that trims each chunk to the piece between its two seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("text", "seam", "next_seam")]
            pieces = [t[s : len(t) if e is None else chunk + e] for t, s, e in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(pieces, pa.string())], names=["key", "k", "text"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ids (array of int) and decoded (binary: the bytes of the ids, concatenated).

    Texts up to ``chunk`` characters are pre-tokenised and merged where they lie, without a shuffle. A longer text is
    cut into chunks that overlap; chunks are spread over the tasks and pre-tokenised in parallel, each from its own
    start. In an overlap both neighbours list the token starts they see. From the first that both have on, they agree,
    as the pattern never looks back, so that start is the seam; the pieces between seams are encoded in parallel and
    put together by number. A text with an overlap in which the two never meet (a run of one class longer than the
    overlap) is encoded as one piece. Equal long texts are encoded once.

    Null is treated as empty: no ids and no bytes. Repeated rows stay. Columns called ids or decoded are replaced.
    Only the vocabulary (fixed, under 1 MB) is broadcast.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    docs = docs.drop("ids", "decoded")
    keep = [c for c in docs.columns if c != "text"]
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    long = F.length("text") > chunk
    fields = lambda cols, df: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    short = docs.filter(~long).mapInArrow(_encoded(ranks, pattern, keep), f"{fields(keep, docs)}, ids array<int>, decoded binary")

    key = F.sha2("text", 256)
    texts = docs.filter(long).select(key.alias("key"), "text").dropDuplicates(["key"])
    chunks = texts.mapInArrow(_chunked(chunk, overlap), "key string, k int, last boolean, text string")
    chunks = written(chunks.repartition(tasks_for(spark), "key", "k"), "bpe-chunks")
    seen = written(chunks.mapInArrow(_seams(pattern, chunk, overlap), "key string, k int, last boolean, head array<int>, tail array<int>"), "bpe-seams")
    following = seen.select("key", (F.col("k") - 1).alias("k"), "head")
    seams = seen.select("key", "k", "last", "tail").join(following, ["key", "k"], "left")
    seams = seams.select("key", "k", "last", F.array_min(F.array_intersect("tail", "head")).alias("next_seam"))
    open_ = seams.filter("not last and next_seam is null").select("key").distinct()
    whole = texts.join(open_, "key", "left_semi").select("key", F.lit(0).alias("k"), "text")
    seams = seams.join(open_, "key", "left_anti")
    starts = seams.filter("next_seam is not null").select("key", (F.col("k") + 1).alias("k"), F.col("next_seam").alias("seam"))
    cuts = seams.join(starts, ["key", "k"], "left").select("key", "k", F.coalesce("seam", F.lit(0)).alias("seam"), "next_seam")
    pieces = chunks.drop("last").join(cuts, ["key", "k"]).mapInArrow(_cut(chunk), "key string, k int, text string").unionByName(whole)
    done = pieces.mapInArrow(_encoded(ranks, pattern, ["key", "k"]), "key string, k int, ids array<int>, decoded binary")
    parts = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids", "decoded"))).alias("p"))
    empty = F.lit(b"")
    joined = parts.select("key", F.flatten(F.col("p.ids")).alias("ids"), F.aggregate("p", empty, lambda a, x: F.concat(a, x["decoded"])).alias("decoded"))
    back = docs.filter(long).withColumn("__key", key).drop("text").join(joined.withColumnRenamed("key", "__key"), "__key").drop("__key")
    return short.unionByName(back)


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN))
