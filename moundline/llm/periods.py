"""Runs of repeating words by probing a harmonic grid of places."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.common import lean_batches, table

#: The least words of a run, and the least number of periods in it.
LEAST, TIMES = 24, 3
#: Words up to which the grid of a text is looked up at once (its size is that times its logarithm); longer texts go period by period.
GRID = 1 << 15
#: Places that are compared at once, and the first number of words by which a run is extended.
LOT, CHUNK = 1 << 16, 32
#: Bytes of a text that are split at once, different words that a task numbers before it starts anew, bytes of results after which it hands a batch on.
BLOCK, WORDS, BATCH = 1 << 22, 1 << 20, 8 << 20


def blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words (runs of bytes that are not ASCII white space), those of about BLOCK bytes at once."""
    at = 0
    while len(text) - at > BLOCK:
        stop = at + BLOCK
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[at:stop].split()
        at = stop
    yield text[at:].split()


@cache
def _grid() -> tuple[np.ndarray, np.ndarray]:
    """Places j * p and periods p of all (j * p, (j + 1) * p, (j + 2) * p) below GRID, by the last of the three: those of a shorter text come first."""
    periods = np.arange(1, GRID // 2)
    n = np.maximum((GRID - 1) // periods - 1, 0)
    p = np.repeat(periods, n)
    j = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort((j + 2) * p, kind="stable")
    return (j * p)[order].astype(np.int32), p[order].astype(np.int32)


@cache
def _sizes() -> np.ndarray:
    """How many triples of the grid end before each place."""
    at, p = _grid()
    return np.searchsorted(at + 2 * p, np.arange(GRID + 1))


def _probes(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each period, in order, the grid places at which the word is that of the next two grid places; only periods with any."""
    n = len(w)
    if n <= GRID:
        at, p = (x[: _sizes()[n]] for x in _grid())
        at, p = at[p <= n // TIMES], p[p <= n // TIMES]
        alike = np.flatnonzero((w[at] == w[at + p]) & (w[at + p] == w[at + 2 * p]))
        order = np.lexsort((at[alike], p[alike]))
        at, p = at[alike][order].astype(np.int64), p[alike][order]
        edges = np.flatnonzero(np.diff(p, prepend=0, append=0))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(p[a]), at[a:b]
        return
    for p in range(1, n // TIMES + 1):
        grid = w[::p]
        alike = grid[1:] == grid[:-1]
        found = np.flatnonzero(alike[1:] & alike[:-1])
        if len(found):
            yield p, found * p


def _survivors(w: np.ndarray, p: int, at: np.ndarray) -> np.ndarray:
    """The places from which on p words are those p words later, as those of a run's first grid place are: chunk by chunk, for many places at once."""
    done, chunk = 1, 8
    while len(at) and done < p:
        step = np.arange(done, min(done + chunk, p))
        lots = [at[i : i + max(1, LOT // len(step))] for i in range(0, len(at), max(1, LOT // len(step)))]
        at = np.concatenate([x[(w[x[:, None] + step] == w[x[:, None] + step + p]).all(1)] for x in lots])
        done += chunk
        chunk *= 2
    return at


def _extent(w: np.ndarray, p: int, at: int) -> tuple[int, int]:
    """The longest stretch around ``at`` that keeps period p, by chunks that double."""
    n, start, stop, chunk = len(w), at, at + p, CHUNK
    while start:
        size = min(chunk, start)
        other = np.flatnonzero(w[start - size : start] != w[start - size + p : start + p])
        if len(other):
            start -= size - 1 - int(other[-1])
            break
        start, chunk = start - size, chunk * 2
    chunk = CHUNK
    while stop < n:
        size = min(chunk, n - stop)
        other = np.flatnonzero(w[stop : stop + size] != w[stop - p : stop - p + size])
        if len(other):
            stop += int(other[0])
            break
        stop, chunk = stop + size, chunk * 2
    return start, stop


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the longest stretches of at least max(LEAST, TIMES * period) words that keep a period, by start, then period.

    A stretch of three periods holds three grid places j * p, (j + 1) * p, (j + 2) * p with one word, and all p words
    between the first two come again p later. Periods go up. Places within a run whose period divides this one are
    skipped, as nothing with a smallest period of its own overlaps such a run by a whole period, and so are places
    within a run that this period has just given.
    """
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p, at in _probes(w):
        for q, (starts, stops) in by_period.items():
            if p % q == 0 and len(at):
                i = np.searchsorted(starts, at, side="right") - 1
                at = at[(i < 0) | (stops[i] <= at + p)]
        own, last = [], 0
        for place in _survivors(w, p, at).tolist():
            if place + p < last:  # within the stretch looked at before
                continue
            start, last = _extent(w, p, place)
            if last - start >= max(LEAST, TIMES * p):
                own.append((start, last))
        if own:
            by_period[p] = tuple(np.array(x) for x in zip(*own, strict=True))
            found += [(a, b - a, p) for a, b in own]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def _collapsed(keep: list[str]):
    """A task that adds n_words, the runs and the text without their repetitions to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        for batch in batches:
            texts, rows, size, first = batch.column("text").cast(pa.binary()), [], 0, 0

            def flush(stop: int) -> pa.RecordBatch:
                n, found, text = zip(*rows, strict=True)  # noqa: B023
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                made = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(text, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays([batch.column(k).slice(first, stop - first) for k in keep] + made, names=[*keep, "n_words", "runs", "collapsed"])  # noqa: B023

            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                if len(number) > WORDS:
                    number.clear()
                ids = [np.array([number.setdefault(x, len(number)) for x in some], np.int32) for some in blocks(text)]
                w = ids[0] if len(ids) == 1 else np.concatenate(ids)
                found = runs(w)
                if found:
                    keep_, at, lots = kept_words(len(w), found), 0, []
                    for some in blocks(text):
                        lots.append(b" ".join([x for x, k in zip(some, keep_[at : at + len(some)].tolist(), strict=True) if k]))
                        at += len(some)
                else:
                    lots = [b" ".join(some) for some in blocks(text)]
                rows.append((len(w), found, b" ".join([x for x in lots if x])))
                size += len(rows[-1][2]) + 24 * len(found)
                if size > BATCH:
                    yield flush(i + 1)
                    rows, size, first = [], 0, i + 1
            if rows:
                yield flush(batch.num_rows)

    return run


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length and period, by start, then period, in words from 0) and collapsed, the text without what runs repeat.

    Words are separated by ASCII white space. A run is a stretch of at least max(24, 3 * period) words that keeps its
    smallest period and that no word beside it extends; see runs(). collapsed has the words that no run holds behind
    its first period, joined by spaces; texts without runs are joined so too.

    Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows stay. Columns with the names
    of the new ones are replaced. Nothing is shuffled; a text is worked on whole, in memory of a few times its size. ``arrow.maxRecordsPerBatch`` of the session is
    lowered to 1,000, for good.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != "text"]
    inner = docs.select("text", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)])
    names = inner.columns[1:]
    fields = "".join(f"`{c}` {inner.schema[c].dataType.simpleString()}, " for c in names)
    out = inner.mapInArrow(_collapsed(names), fields + "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """The contract's test texts: where crc32 of the decimal doc_id ends in 0, words from a on repeat the p words there. Others, and null ids, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.split(F.btrim(F.col("text"), F.lit(" \t\n\v\f\r")), r"[\x20\x09-\x0D]+"), F.floor(h / 10).cast("long")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    chosen = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn("text", F.when(chosen, text).otherwise(F.col("text")))


def digests(found: DataFrame) -> DataFrame:
    """The run with most periods (exactly compared), digests of all runs and of the collapsed text."""
    better = lambda r, x: x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]) | ((r["length"] * x["period"] == x["length"] * r["period"]) & (F.struct(r["start"], r["period"]) < F.struct(x["start"], x["period"])))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda x, r: F.when(better(r, x), r).otherwise(x))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    out = found.withColumns({"best": best, "lines": lines})
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(periodic_runs(planted(docs.select("doc_id", "text"))))


OP11_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(k))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM d, tab
),
e AS (SELECT rid, doc_id, n, ws, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM h),
x AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS ws FROM e),
w AS (SELECT rid, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM x),
p AS (SELECT rid, ws, unnest(range(1, n // 3 + 1)) AS p, n FROM x),
probed AS (SELECT rid, p, ws, n FROM p WHERE len(list_filter(range(0, (n - 1) // p - 1), lambda j: ws[j * p + 1] = ws[j * p + p + 1] AND ws[j * p + 1] = ws[j * p + 2 * p + 1])) > 0),
equal AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM (SELECT rid, p, unnest(list_filter(range(0, n - p), lambda i: ws[i + 1] = ws[i + p + 1])) AS i FROM probed)),
stretches AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM equal GROUP BY rid, p, island HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT rid, start, length, min(p) AS period FROM stretches GROUP BY rid, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::HUGEINT * 1000000000000000000 // period DESC, start, period) AS k FROM runs),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS s FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT x.doc_id, CAST(coalesce(listed.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM x LEFT JOIN listed USING (rid) LEFT JOIN best ON best.rid = x.rid AND best.k = 1 LEFT JOIN kept ON kept.rid = x.rid
"""
