"""Suffix-array dedup of long byte strings with a logarithmic family of indexes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.common import delete, discard, lean_batches, table, text_hash, written
from moundline.llm.hashing import R, mixed
from moundline.session import scratch

#: Bytes of a string that counts, batches that a table is dealt into.
LENGTH, BATCHES = 400, 4
#: Starts of strings that a task looks at together, however long a text is; offsets of strings in a block.
STARTS, SPAN = 1 << 17, 16
#: Position bits in a packed minimum.
_LOW = np.uint64((1 << 20) - 1)
#: Bytes that are mixed to a number before the polynomial: one of bytes alone, modulo 2^64, has equal values for some different strings whatever its base.
GRAM = 8


def sample_size(length: int) -> int:
    """Bytes of a sampled suffix that decide on candidates: two fifths of the string, so every string has a sampled suffix in it."""
    return max(1, 2 * length // 5)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (R, np.uint64(pow(int(R), -1, 1 << 64))):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


POWERS = _powers((1 << 18) + 1)


def _gram(length: int) -> int:
    """Bytes of a gram where strings of ``length`` bytes are sampled: none of the strings that are hashed then is shorter."""
    return GRAM if sample_size(length) >= GRAM else 1


def _sums(data: np.ndarray, gram: int) -> np.ndarray:
    """Sums over the grams before each place: each gram's bytes mixed, times a power of R."""
    grams, width = data.astype(np.uint64), 1
    while width < gram:
        grams = grams[:-width] | grams[width:] << np.uint64(8 * width)
        width *= 2
    out = np.zeros(max(0, len(grams)) + 1, np.uint64)
    np.cumsum(mixed(grams * R + np.uint64(17)) * POWERS[0][: len(grams)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, length, gram: int) -> np.ndarray:
    """Hashes of ``length`` bytes from each start on, from the sums over their grams."""
    return mixed((sums[start + length - gram + 1] - sums[start]) * POWERS[1][start])


def _windows_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    have = 1
    while 2 * have <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if w > have else v


def sampled(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of one text's bytes: pos, lo, hi, head, next, f, seg.

    Every string of ``length`` bytes holds one: the place in it where the hash of the next ``sample_size`` bytes is
    least, the leftmost of equal ones. This depends on the string alone, so equal strings sample the same suffix at the
    same offset. lo and hi: first and last start of the strings that sampled it; head and next: its first 8 bytes and the
    8 after them, in their order; f: hash of its first sample_size bytes; seg: hash of all bytes of its strings and their place around it.
    """
    size, gram = sample_size(length), _gram(length)
    out, a = [], 0
    while a <= len(data) - length:
        part = data[a : a + STARTS + length - 1]
        sums, n = _sums(part, gram), len(part) - length + 1
        h = _hash(sums, np.arange(len(part) - size + 1), size, gram)
        at = (_windows_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - size + 1) & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.append(lo[1:], n) - 1
        # The next part starts with the last suffix of this one, so that none is cut in two, which would look like two places.
        following = a + lo[-1] if a + n <= len(data) - length else len(data)
        if following < len(data):
            lo, hi = lo[:-1], hi[:-1]
        pos = at[lo]
        seg = mixed(_hash(sums, lo, hi - lo + length, gram) + (pos - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
        first = np.zeros((len(pos), 16), np.uint8)
        for j in range(min(16, size)):
            first[:, j] = part[pos + j]
        head, after = (first[:, k : k + 8].copy().view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63) for k in (0, 8))
        out.append((pos + a, lo + a, hi + a, head.view(np.int64), after.view(np.int64), h[pos].view(np.int64), seg.view(np.int64)))
        a = following
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in _SAMPLE)


_SAMPLE = ["pos", "lo", "hi", "head", "next", "f", "seg"]
KEY = ["head", "next", "f"]


def _bytes(text: pa.Scalar) -> np.ndarray:
    data = text.as_buffer() if text.is_valid else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            ids, hs, new = batch.column("doc_id"), batch.column("h").to_numpy(), batch.column("new")
            for i, text in enumerate(batch.column("text")):
                cols = sampled(_bytes(text), length)
                held.append((i, cols))
                size += len(cols[0])
                if size > 100_000 or i == batch.num_rows - 1:
                    row = np.repeat([j for j, _ in held], [len(c[0]) for _, c in held])
                    made = [np.concatenate([c[k] for _, c in held]) for k in range(len(_SAMPLE))]
                    yield pa.RecordBatch.from_arrays([ids.take(at := pa.array(row, pa.int64())), pa.array(hs[row] if len(row) else hs[:0]), new.take(at), *map(pa.array, made)], names=["doc_id", "h", "new", *_SAMPLE])
                    held, size = [], 0

    return run


class SuffixIndex:
    """A logarithmic family of sparse suffix arrays, by name: it can be opened again and given more batches.

    An array is a table of the distinct sampled suffixes of its batches in the order of their first 16 bytes, then of f:
    each with the number of its places and the first of them (doc_id, pos). It is bucketed by suffix, so merging and
    merge-scanning read sorted buckets side by side and move nothing. ``add`` makes the array of a new batch and
    merge-scans it against every level. Levels whose sizes have the same power of two merge before the next batch
    comes, so there are about log2 of all suffixes at most, and each suffix is rewritten as often. A suffix that a third
    of all texts hold is one row a task before the only shuffle. Tables live in the session's catalog: for the
    application, or for good where that is a metastore.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark, self.prefix = spark, f"suffixes_{name or uuid.uuid4().hex}_"

    @property
    def levels(self) -> list[tuple[int, str]]:
        """Rank and table of each level, the largest first."""
        names = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix)]
        return sorted(((int(n.removeprefix(self.prefix).split("_")[0]), n) for n in names), reverse=True)

    def _array(self, rows: DataFrame) -> None:
        made = f"new_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # In the shared folder, not in the warehouse, which may be a folder of one machine.
        place = f"{scratch(self.spark)}/{made}"
        rows.write.bucketBy(n, *KEY).sortBy(*KEY).option("compression", "zstd").option("path", place).saveAsTable(made)
        rank = self.spark.table(made).count().bit_length()
        self.spark.sql(f"ALTER TABLE {made} RENAME TO {self.prefix}{rank}_{uuid.uuid4().hex}")

    def _settle(self) -> None:
        """Merges two levels of one rank, as long as there are any."""
        while True:
            levels = self.levels
            pair = next(((a, b) for (r, a), (q, b) in reversed(list(zip(levels, levels[1:], strict=False))) if r == q), None)
            if not pair:
                return
            other = self.spark.table(pair[1]).select(*KEY, F.col("n").alias("m"), F.struct("doc_id", "pos").alias("p"))
            both = self.spark.table(pair[0]).withColumn("o", F.struct("doc_id", "pos")).hint("merge").join(other, KEY, "full")
            first = F.least("o", "p")
            self._array(both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), first["doc_id"].alias("doc_id"), first["pos"].alias("pos")))
            for gone in pair:
                self._drop(gone)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Adds a batch (the key, doc_id and pos of sampled suffixes); those of which a long match was found, in the batch itself or in a level, as a written table."""
        self._settle()
        old = self.levels
        self._array(suffixes.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("o")).select(*KEY, "n", "o.doc_id", "o.pos"))
        name = next(n for _, n in self.levels if n not in {m for _, m in old})
        new = self.spark.table(name)
        shared = new.filter("n > 1").select(*KEY)
        for _, level in old:
            shared = shared.unionByName(new.select(*KEY).hint("merge").join(self.spark.table(level).select(*KEY), KEY))
        return written(shared, "shared-suffixes")

    def drop(self) -> None:
        for _, level in self.levels:
            self._drop(level)

    def _drop(self, level: str) -> None:
        place = self.spark.sql(f"DESCRIBE FORMATTED {level}").filter("col_name = 'Location'").first().data_type
        self.spark.sql(f"DROP TABLE {level}")
        delete(self.spark, place)


def _contexts(length: int):
    """A task that cuts out the bytes around each wanted suffix: those of all strings that sampled it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "pos", "lo", "hi", "f", "single", "bytes"]
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                data = _bytes(batch.column("text")[i])
                for w in batch.column("wanted")[i].as_py():
                    cut = data[w["lo"] : w["hi"] + length].tobytes()
                    held.append((batch.column("doc_id")[i].as_py(), batch.column("h")[i].as_py(), w["pos"], w["lo"], w["hi"], w["f"], w["single"], cut))
                    size += len(cut)
                if held and (size > 8 << 20 or i == batch.num_rows - 1):
                    kinds = [batch.column("doc_id").type] + [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, size = [], 0

    return run


def _blocks(length: int):
    """A task: for each context its blocks of offsets of strings before the suffix, with two hashes.

    Block j has the offsets span * j to span * (j + 1) - 1; d1 and d2 are the first and last of them that occur in the
    context. full: hash of all bytes of these strings. core: of the bytes that every string of the block holds, wherever
    it is; strings can be equal only if the cores of their blocks are.
    """
    span, gram = min(SPAN, max(1, length // 4)), _gram(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, made = [], []
            pos, lo, hi = (batch.column(c).to_numpy() for c in ("pos", "lo", "hi"))
            for i, cut in enumerate(batch.column("bytes")):
                sums = _sums(_bytes(cut), gram)
                j = np.arange((pos[i] - hi[i]) // span, (pos[i] - lo[i]) // span + 1)
                d1, d2, at = np.maximum(span * j, pos[i] - hi[i]), np.minimum(span * j + span - 1, pos[i] - lo[i]), pos[i] - lo[i]
                full, core = _hash(sums, at - d2, d2 - d1 + length, gram), _hash(sums, at - span * j, length - span + 1, gram)
                row.append(np.full(len(j), i))
                made.append((j, d1, d2, full.view(np.int64), core.view(np.int64)))
            if row:
                row = pa.array(np.concatenate(row))
                cols = [batch.column(c).take(row) for c in ("doc_id", "h", "pos", "f", "single")] + [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "pos", "f", "single", "block", "d1", "d2", "full", "core"])

    return run


def _strings(length: int):
    """A task: for each context with blocks that are left, the offset and hash of each of their strings; single: whether the block may hold a new one."""
    span, gram = min(SPAN, max(1, length // 4)), _gram(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, offset, value, single, size = [], [], [], [], 0
            pos, lo, hi = (batch.column(c).to_numpy() for c in ("pos", "lo", "hi"))
            for i, cut in enumerate(batch.column("bytes")):
                left = batch.column("blocks")[i].as_py()
                d = (np.array([b["block"] for b in left], np.int64)[:, None] * span + np.arange(span)[None, :]).ravel()
                new = np.repeat([b["single"] for b in left], span)
                near = (d >= pos[i] - hi[i]) & (d <= pos[i] - lo[i])
                d = d[near]
                single.append(new[near])
                row.append(np.full(len(d), i))
                offset.append(d)
                value.append(_hash(_sums(_bytes(cut), gram), pos[i] - d - lo[i], length, gram).view(np.int64))
                size += len(d)
                if size > 100_000 or i == batch.num_rows - 1:
                    at, d, w = np.concatenate(row), np.concatenate(offset), np.concatenate(value)
                    cols = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "h", "f")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(single)), pa.array(pos[at] - d), pa.array(w)], names=["doc_id", "h", "f", "single", "start", "w"])
                    row, offset, value, single, size = [], [], [], [], 0

    return run


def _removed(length: int, keep: list[str]):
    """A task that cuts the strings that start in the given ranges out of each text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = [batch.column(k).slice(start, len(rows)) for k in keep] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

        for batch in batches:
            rows, start, size = [], 0, 0
            for i in range(batch.num_rows):
                data = _bytes(batch.column("text")[i])
                ranges = batch.column("__ranges")[i].as_py()
                begin, stop = spans(np.array([(r["lo"], r["hi"]) for r in ranges], np.int64).reshape(-1, 2) if ranges else np.zeros((0, 2), np.int64), length)
                edges = [0, *np.stack([begin, stop], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(begin), kept))
                size += len(kept)
                if size > 8 << 20:
                    yield made(batch, start, rows)
                    rows, start, size = [], i + 1, 0
            if rows:
                yield made(batch, start, rows)

    return run


def spans(ranges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings of ``length`` bytes whose first and last starts are given."""
    if not len(ranges):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    stop = np.maximum.accumulate(ranges[:, 1] + length)
    first = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > stop[:-1]]))
    return ranges[first, 0], stop[np.append(first[1:], len(ranges)) - 1]


def repeated_strings(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, index: SuffixIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, h (hash of the text) and ranges: the starts (lo to hi) of strings of ``length`` bytes that occur twice or more.

    Documents come in ``batches`` by hash. Each gets a sparse suffix array, which is merge-scanned against the levels of
    ``index`` (without one, of a family of its own) and added to them; ``earlier`` are the documents that the index
    holds already, whose texts are needed for the exact check. Suffixes that no other place shares end here; for the
    rest an exact check follows. Places whose strings are all equal to those at another one are repeats as they are. Of
    others, one of each kind stands for its kind: the bytes around it are fetched and looked at by blocks of offsets.
    Blocks that are equal as a whole are repeats, those whose common bytes occur once are none, and of the rest each
    string is compared. Equal strings have equal suffixes and equal offsets, so none is lost, and every step reduces
    with counts before it joins. Equal means equal 64-bit hashes of the whole strings (or blocks, or places), which are
    only compared where a suffix is shared.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    of = lambda df, new: df.select("doc_id", text_hash().alias("h"), "text", F.lit(new).alias("new"))
    d = of(docs, True).unionByName(of(earlier, False)) if earlier is not None else of(docs, True)
    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    schema = f"{doc_id}, h long, new boolean, " + ", ".join(f"{c} long" for c in _SAMPLE)
    suffixes = d.mapInArrow(_suffixes(length), schema).withColumn("batch", F.pmod(F.xxhash64("doc_id", "h"), F.lit(batches)).cast("int"))
    suffixes = written(suffixes, "suffixes")
    family = index or SuffixIndex(spark)
    try:
        shared = [family.add(suffixes.filter((F.col("batch") == b) & F.col("new")).select(*KEY, "doc_id", "pos")) for b in range(batches)]
    finally:
        if index is None:
            family.drop()
    d = d.drop("new")
    # Written, so that the join below stands between two exchanges and a suffix with very many places is split.
    keys = written(reduce(DataFrame.unionByName, shared).select("f").distinct(), "shared-keys")
    near = written(suffixes.drop("new", "batch", "head", "next").join(keys, "f", "left_semi"), "shared-places")
    discard(suffixes, keys, *shared)

    kinds = near.groupBy("f", "seg").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "h", "pos", "lo", "hi")).alias("rep"))
    kinds = place_kinds = written(kinds, "kinds")
    sure = near.join(kinds.filter("c > 1").select("f", "seg"), ["f", "seg"], "left_semi").select("doc_id", "h", F.struct("lo", "hi").alias("r"))
    open_ = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.max(F.col("c") == 1).alias("open")).filter("kinds > 1 and open").select("f")
    reps = kinds.join(open_, "f", "left_semi").select("rep.doc_id", "rep.h", F.struct("rep.pos", "rep.lo", "rep.hi", "f", (F.col("c") == 1).alias("single")).alias("w"))
    wanted = reps.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list("w").alias("wanted"))
    texts = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("doc_id", "h", "text", "wanted")
    around = written(texts.mapInArrow(_contexts(length), f"{doc_id}, h long, pos long, lo long, hi long, f long, single boolean, bytes binary"), "contexts")

    whole = ["f", "block", "d1", "d2", "full"]
    blocks = around.mapInArrow(_blocks(length), f"{doc_id}, h long, pos long, f long, single boolean, block long, d1 long, d2 long, full long, core long")
    blocks = written(blocks, "blocks")
    kinds = blocks.groupBy(*whole, "core").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "h", "pos", "single")).alias("rep"))
    kinds = block_kinds = written(kinds, "block-kinds")
    equal = blocks.filter("single").join(kinds.filter("c > 1").select(*whole), whole, "left_semi")
    equal = equal.select("doc_id", "h", F.struct((F.col("pos") - F.col("d2")).alias("lo"), (F.col("pos") - F.col("d1")).alias("hi")).alias("r"))
    new = (F.col("c") == 1) & F.col("rep.single")
    open_ = kinds.groupBy("f", "block", "core").agg(F.count("*").alias("kinds"), F.max(new).alias("open")).filter("kinds > 1 and open").drop("kinds", "open")
    left = kinds.join(open_, ["f", "block", "core"], "left_semi").select("rep.doc_id", "rep.h", "rep.pos", F.struct("block", new.alias("single")).alias("b"))
    left = left.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("pos").alias("__pos")).agg(F.collect_list("b").alias("blocks"))
    left = around.join(left, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")) & (F.col("pos") == F.col("__pos"))).drop("__id", "__h", "__pos")
    strings = written(left.mapInArrow(_strings(length), f"{doc_id}, h long, f long, single boolean, start long, w long"), "strings")
    twice = strings.groupBy("f", "w").count().filter("count > 1").drop("count")
    found = strings.filter("single").join(twice, ["f", "w"], "left_semi").select("doc_id", "h", F.struct(F.col("start").alias("lo"), F.col("start").alias("hi")).alias("r"))
    ranges = sure.unionByName(equal).unionByName(found).groupBy("doc_id", "h").agg(F.collect_list("r").alias("ranges"))
    ranges = written(ranges, "ranges")
    discard(near, place_kinds, around, blocks, block_kinds, strings)
    return ranges


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, index: SuffixIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``docs`` without text but with n_bytes, n_removed, n_spans and kept (binary).

    Every byte of a text's UTF-8 goes that is covered by a string of ``length`` bytes that also starts anywhere else,
    the same text included; overlaps count, and strings are judged on the input. Strings never cross documents.
    n_spans counts the maximal runs that went; kept is what stays, put together. All copies go, the first as well.
    With an ``index`` the documents are a new batch of its family, and what also starts in one of the ``earlier``
    documents that it holds goes too.

    Null text counts as empty; texts shorter than ``length`` keep all. Rows that repeat doc_id and text repeat each
    other's strings. Columns called like the four new ones are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in docs.columns if c != "text"]
    ranges = repeated_strings(docs, length, batches, index, earlier).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("ranges").alias("__ranges"))
    found = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__h")), "left").select(*keep, "text", "__ranges")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return found.mapInArrow(_removed(length, keep), f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(COALESCE(text, ''))), '..') AS b FROM documents),
c0 AS (SELECT r, unnest(range(len(b))) AS i, unnest(b) AS x FROM t),
c1 AS (SELECT r, i, dense_rank() OVER (ORDER BY x) AS k FROM c0),
{doubled},
s AS (SELECT r, i, COUNT(*) OVER (PARTITION BY k) > 1 AS twice FROM c400),
g AS (SELECT c0.r, c0.i, c0.x, COALESCE(bool_or(s.twice) OVER (PARTITION BY c0.r ORDER BY c0.i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM c0 LEFT JOIN s ON s.r = c0.r AND s.i = c0.i),
e AS (SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY r ORDER BY i) AS begins FROM g),
a AS (SELECT r, COUNT(*) AS n_bytes, COUNT(*) FILTER (WHERE gone) AS n_removed, COUNT(*) FILTER (WHERE begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY r)
SELECT t.doc_id, COALESCE(n_bytes, 0)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256
FROM t LEFT JOIN a USING (r)
"""


def _doubled() -> str:
    """Ranks of all strings of 2, 4, ... 256 bytes and at last of 400, each from two of the lengths before that cover it, as in the doubling of suffix arrays."""
    step = "c{n} AS (SELECT r, i, dense_rank() OVER (ORDER BY k, l) AS k FROM (SELECT r, i, k, lead(k, {by}) OVER (PARTITION BY r ORDER BY i) AS l FROM c{m}) WHERE l IS NOT NULL)"
    sizes = [1, 2, 4, 8, 16, 32, 64, 128, 256, LENGTH]
    return ",\n".join(step.format(n=n, m=m, by=n - m) for m, n in zip(sizes, sizes[1:], strict=False))


OP2_SQL = OP2_SQL.format(doubled=_doubled())
