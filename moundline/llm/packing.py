"""Packing of tokenised documents into sequences of one length by cutting stock."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundline.llm.common import lean_batches, table, written
from moundline.llm.cutting import cut

CAPACITY = 2048
#: Words and parts of words kept with their ids in each of two generations of a Python worker's cache, and the longest such one.
CACHE, CACHE_CHARS = 400_000, 48
#: Bytes of results after which a task hands a batch on.
BATCH = 4 << 20
#: Words of these characters alone are their own normal form; upper and lower case of them are one character each.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
#: What a word is split into by the tokenizer, over these characters in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")
#: Signs that words end in most often; each alone is a part behind letters.
_SIGNS = frozenset(".,;:!?")
#: Special tokens begin so.
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Keys to the bytes of their ids, made when first asked for. When it is full, what was not used since it last was goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class WordEncoder:
    """A tokenizer that lower-cases, drops white space and never merges across it, word by word; a helper for the tasks.

    Ids come from the library: whole words as it takes them, or, for words of plain letters, digits and signs, the
    parts it would split them into, by its model. A word is what stands between spaces, tabs and line feeds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), _byte_letters()
        self.model = self.tokenizer.model
        #: Parts of words are among them: a part alone is a word of the same ids.
        self.words = _Cache(self._word)

    def _word(self, word: str) -> bytes:
        # What most words are, a part or a part and a sign, is told without expressions.
        if word.isascii():
            if word.isalpha():
                return self._part(word) if word.islower() else self.words[word.lower()]
            if word[-1:] in _SIGNS and word[:-1].isalpha():
                return self.words[word[:-1].lower()] + self.words[word[-1]]
        if _PLAIN.fullmatch(word) and _SPECIAL not in word:
            parts = _PARTS.findall(word.lower())
            return self._part(parts[0]) if len(parts) == 1 else b"".join([self.words[p] for p in parts])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def _pieces(path: str, end_id: int, capacity: int, keep: list[str]):
    """A task that turns documents into pieces of ``capacity`` ids and a shorter last one; n numbers pieces of one length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = WordEncoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                at, *cols = zip(*rows, strict=True)  # noqa: B023
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in keep]  # noqa: B023
                start, length, total, n, ids = cols
                made = [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays(kept + made, names=[*keep, "start", "length", "doc_tokens", "part", "n", "ids"])

            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids = encoder.encode(texts[i].as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    one = ids[4 * start : 4 * (start + capacity)]
                    length = len(one) // 4
                    rows.append((i, start, length, total, int(seen[length]), one))
                    seen[length] += 1
                    size += len(one)
                    if size > BATCH:
                        yield flush()
                        rows, size = [], 0
            if rows:
                yield flush()

    return run


def _segments(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int, list[int]]:
    """(length, first rank, last rank, pieces a sequence, offset or place in the stream, first sequence or None) of all lengths; number of sequences of patterns; ends of the sequences behind the stream's full ones."""
    patterns, loose = cut(histogram, capacity)
    out, taken, sequences, stream = [], dict.fromkeys(histogram, 0), 0, 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            out.append((length, taken[length], taken[length] + k * n - 1, k, offset, sequences))
            taken[length] += k * n
            offset += length * k
        sequences += n
    for length, n in sorted(loose.items()):
        out.append((length, taken[length], taken[length] + n - 1, 1, stream, None))
        stream += length * n
    ends, at = [], stream - stream % capacity
    while at < stream:  # descending powers of two, so nothing is padded
        at += 1 << ((stream - at).bit_length() - 1)
        ends.append(at)
    return out, sequences, ends


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents in sequences: the columns of ``docs`` but text, start (ids of the document before the piece), length, ids (binary:
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id and offset.

    Each document's ids get ``end_id`` behind them. Documents give off sequences of ``capacity`` ids of their own; what
    is left of each, a piece shorter than that, goes by its length and its rank among the pieces of that length into the
    patterns of a cutting-stock program (see cutting), whose size depends on ``capacity`` only. Pieces that are in no
    pattern (few, by rounding, where lengths fit together) form one stream that is cut every ``capacity`` ids, its end
    into powers of two. So no sequence is padded: all hold ``capacity`` ids or a power of two, which ``capacity`` has to be too.

    Ranks: tasks number the pieces of each length they make, and the counts of each task and length are summed up, so no
    length meets in one task. The driver gets the number of pieces of each length.

    Null texts are empty: such a document is ``end_id`` alone. Repeated rows are documents of their own. Columns with the names of the
    new ones are replaced. Which of equally long pieces share a sequence is open; another run may choose otherwise.
    ``arrow.maxRecordsPerBatch`` of the session is lowered to 1,000, for good.
    """
    if capacity & (capacity - 1):
        raise ValueError(f"the capacity is a power of two, not {capacity}")
    spark = docs.sparkSession
    lean_batches(spark)
    new = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    docs = docs.drop(*[c for c in new if c in docs.columns])
    # Names that cannot clash with those used on the way.
    names = {c: f"__{i}" for i, c in enumerate(c for c in docs.columns if c != "text")}
    inner = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    keep = list(names.values())
    fields = ", ".join(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in keep)
    made = "start long, length long, doc_tokens long, part int, n long, ids binary"
    pieces = written(inner.mapInArrow(_pieces(tokenizer_path, end_id, capacity, keep), f"{fields}, {made}" if keep else made), "packing-pieces")

    short = pieces.filter(F.col("length") < capacity)
    counts = written(short.groupBy("part", "length").agg((F.max("n") + 1).alias("count")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    segments, sequences, ends = _segments(histogram, capacity)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most a pattern a length, each of at most sqrt(2 * capacity) lengths: a bound that does not depend on the data.
    plan = F.broadcast(spark.createDataFrame(segments, "of long, first long, last long, each long, place long, sequence long"))
    ranked = short.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("n"))
    placed = ranked.join(plan, (F.col("of") == F.col("length")) & F.col("rank").between(F.col("first"), F.col("last")))

    own, capacity_ = F.col("rank") - F.col("first"), F.lit(capacity).cast("long")
    loose = F.col("sequence").isNull()
    placed = placed.withColumn("at", F.when(loose, F.col("place") + own * F.col("length")).otherwise(F.col("place") + F.pmod(own, F.col("each")) * F.col("length")))
    bounds = F.array((F.floor(F.col("at") / capacity_) + 1) * capacity_, *[F.lit(e).cast("long") for e in ends])
    inside = F.filter(bounds, lambda x: (x > F.col("at")) & (x < F.col("at") + F.col("length")))
    cuts = F.when(loose, F.array_sort(F.array_distinct(F.concat(F.array("at"), inside)))).otherwise(F.array("at"))
    cut_up = placed.withColumn("cuts", cuts).select("*", F.posexplode("cuts").alias("k", "from"))
    stop = F.coalesce(F.get("cuts", F.col("k") + 1), F.col("at") + F.col("length"))
    whole, tail = (ends[-1] if ends else 0) // capacity, sorted(ends)
    tail_starts = [whole * capacity, *tail[:-1]]
    in_stream = F.floor(F.col("from") / capacity_).cast("long")
    index, start_of = in_stream, in_stream * capacity_
    for i, s in enumerate(tail_starts if tail else []):
        behind = F.col("from") >= s
        index, start_of = F.when(behind, F.lit(whole + i).cast("long")).otherwise(index), F.when(behind, F.lit(s).cast("long")).otherwise(start_of)
    out = cut_up.select(
        *keep, (F.col("start") + F.col("from") - F.col("at")).alias("start"), (stop - F.col("from")).alias("length"), "doc_tokens",
        F.substring("ids", ((F.col("from") - F.col("at")) * 4 + 1).cast("int"), ((stop - F.col("from")) * 4).cast("int")).alias("ids"),
        F.when(loose, F.lit(sequences) + index).otherwise(F.col("sequence") + F.floor(own / F.col("each"))).cast("long").alias("sequence_id"),
        F.when(loose, F.col("from") - start_of).otherwise(F.col("from")).cast("long").alias("offset"),
    )
    # Full pieces stay where they are; their sequences are numbered by task, above all others.
    numbered = F.shiftleft((F.col("part") + 1).cast("long"), 40) + F.col("n")
    full = pieces.filter(F.col("length") == capacity).select(*keep, "start", "length", "doc_tokens", "ids", numbered.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = full.unionByName(out)
    return every.select(*[F.col(n).alias(c) for c, n in names.items()], "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), p.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
