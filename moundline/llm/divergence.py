"""Audit of how far sources of a language use its words differently, with exact whole numbers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundline.llm.common import table, written

#: Documents of a language that a term is in at least, ranks of the part of terms, and parts of a share.
DOCUMENTS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Counts below this times UNIT are 64-bit numbers.
_LONG = 9_000_000_000
#: Different terms and words that a task numbers before it hands their counts on; rows of a batch.
HELD, WORDS, ROWS = 500_000, 6_000_000, 50_000
#: Bytes of a text that are split at once.
BLOCK = 1 << 20
#: ASCII letters in lower case; other ASCII becomes a space; bytes of other characters stay, as all of these are letters of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about BLOCK bytes at once."""
    at = 0
    while len(text) - at > BLOCK:
        cut = text.find(b" ", at + BLOCK)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _rows(lang: pa.Array, source: pa.Array, term: pa.Array, n, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _summed(ids: list[np.ndarray], of: list[int], groups: list[tuple], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of _counted() for documents given as numbers of their terms: one sort by term, group and document."""
    order = np.argsort(of, kind="stable")
    rank, of = np.argsort(order), np.array(of)[order]
    key = np.repeat(rank, [len(i) for i in ids]) + np.concatenate(ids).astype(np.int64) * len(of)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # of each term and document
    term, group = np.divmod(key[first], len(of))
    group = of[group]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])]))
    docs, n = np.diff(new, append=len(first)), np.diff(first[new], append=len(key))
    langs, sources = (pa.array(x, pa.string()) for x in zip(*groups, strict=True))
    for lo in range(0, len(new), ROWS):
        some = slice(lo, lo + ROWS)
        of_group, of_term = group[new[some]], pa.array(term[new[some]])
        yield _rows(langs.take(pa.array(of_group)), sources.take(pa.array(of_group)), terms.take(of_term), n[some], docs[some])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by language and source, and the documents they are in. What is held is bounded but for one document's different terms."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    groups: dict[tuple, int] = {}
    ids: list[np.ndarray] = []
    of: list[int] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        if size:
            yield from _summed(ids, of, list(groups), pa.array(number.keys(), pa.binary()))
        number, size = defaultdict(count().__next__), 0
        ids.clear(), of.clear(), groups.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang"), batch.column("source"), texts, strict=True):
            data, key = text.as_py().translate(_FOLD), (lang.as_py(), source.as_py())
            if len(data) > BLOCK:
                own: Counter = Counter()
                for some in _words(data):
                    own.update(some)
                n = len(own)
                yield _rows(pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array(own.keys(), pa.binary()), own.values(), [1] * n)
                continue
            words = data.split()
            ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            of.append(groups.setdefault(key, len(groups)))
            size += len(words)
            if size > WORDS or len(number) > HELD:
                yield from flush()
    yield from flush()


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), of numbers of any size; 1 where nothing is kept."""
    large = f"(CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST(`{total}` + `{kept}` AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN `{kept}` = 0 THEN 1L WHEN {count} < {_LONG} THEN {UNIT}L * ({count} + 1) div (`{total}` + `{kept}`) + 1L ELSE {large} + 1L END")


def _value(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, least: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: by source of a language how far the others of it are (part pair), and its terms furthest above the language (part term).

    Terms are runs of letters, A-Z in lower case; those in ``least`` documents of a language are kept. The share of a
    term is 1 + floor(UNIT * (count + 1) / (all counts + kept terms)), the value of shares p against q floor((p - q)**2 / q).
    A pair's value is the sum over all kept terms, also those that neither source has; a term's is that of the source's
    share against the language's, where it is larger and the source has the term. All pairs are ranked, terms up to ``ranks``; ties by item.

    Pairs by distinct count vectors: terms of a language whose counts by source are the same are one vector with a
    multiplicity. A pair of sources in a vector is looked at once for its multiplicity; vectors name only sources that
    have the term. What the pair has besides, terms of only one of the two or of neither, follows from the
    multiplicities of each source's counts: the sum over all of one source's terms as if the other had none of them, corrected for the terms of both.

    Null text, lang or source is ''. Groups without terms have their pairs (0 where the language keeps no term) and no
    terms. Repeated rows are documents of their own; other columns are not looked at. Tasks count their own documents,
    so what moves is a row for each task, group and term, once, to the task of its language and term, where terms of too few
    documents end; a vector has an entry a source. ``docs`` is read twice, the second time without its texts.
    """
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # Dealt as they are, as tasks have summed up: both sums need no other exchange. By term first, whose beginnings tell rows apart where they are sorted.
    totals = counted.repartition("term", "lang").groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = totals.groupBy("term", "lang").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = written(of_term.filter(F.col("docs") >= least).select("lang", "term", "counts"), "divergence-terms")

    # One row a group, with the sums of its language: base is the share of a term that it has not.
    single = kept.select("lang", F.explode("counts").alias("c")).select("lang", "c.source", "c.n")
    multiple = written(single.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "divergence-multiplicities")
    own = multiple.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("present"))
    all_of = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    zero = {"total": 0, "present": 0, "kept": 0}
    groups = text.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(all_of, "lang", "left").fillna(zero)
    in_lang = own.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = written(groups.join(in_lang, "lang", "left").fillna(0, ["lang_total"]).withColumn("base", _share("0", "total", "kept")), "divergence-groups")
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("base").alias(f"{x}0"), F.col("total").alias(f"{x}_total"), F.col("present").alias(f"{x}_present"), "kept")

    vectors = kept.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    both = vectors.select("lang", "m", "counts", F.explode("counts").alias("a")).select("lang", "m", "a", F.explode(F.filter("counts", lambda c: c["source"] > F.col("a.source"))).alias("b"))
    both = both.groupBy("lang", F.col("a.source").alias("a"), F.col("a.n").alias("a_n"), F.col("b.source").alias("b"), F.col("b.n").alias("b_n")).agg(F.sum("m").alias("m"))
    both = both.join(side("a"), ["lang", "a"]).join(side("b").drop("kept"), ["lang", "b"])
    both = both.withColumns({"ap": _share("a_n", "a_total", "kept"), "bp": _share("b_n", "b_total", "kept")})
    corrected = lambda a, b: F.expr(f"m * ({_value(f'{a}p', f'{b}p')} - {_value(f'{a}p', f'{b}0')} - {_value(f'{a}0', f'{b}p')} + {_value(f'{a}0', f'{b}0')})")
    both = both.groupBy("lang", "a", "b").agg(F.sum(corrected("a", "b")).alias("ab"), F.sum(corrected("b", "a")).alias("ba"))
    way = lambda df, a, b, value: df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), F.col(value).alias("value"))

    # Each source's terms against every other source of the language as if that had none of them.
    one = multiple.withColumnsRenamed({"source": "a", "n": "a_n"}).join(side("a"), ["lang", "a"]).withColumn("ap", _share("a_n", "a_total", "kept")).drop("kept")
    one = one.join(side("b").select("lang", "b", "b0"), "lang").filter("a != b")
    one = one.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"m * {_value('ap', 'b0')}")).alias("ab"), F.sum(F.expr(f"m * {_value('b0', 'ap')}")).alias("ba"))
    none = side("a").join(side("b").drop("kept"), "lang").filter("a != b").withColumn("ab", F.expr(f"(kept - a_present - b_present) * {_value('a0', 'b0')}"))
    parts = [way(both, "a", "b", "ab"), way(both, "b", "a", "ba"), way(one, "a", "b", "ab"), way(one, "b", "a", "ba"), way(none, "a", "b", "ab")]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))
    terms = kept.select("lang", "term", F.explode("counts").alias("c"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("all_n"))
    terms = terms.select("lang", F.col("term").alias("item"), "c.source", "c.n", "all_n").join(groups, ["lang", "source"])
    terms = terms.withColumns({"p": _share("n", "total", "kept"), "q": _share("all_n", "lang_total", "kept")}).filter("p > q").withColumn("value", F.expr(_value("p", "q")))
    return top(pairs, "pair").unionByName(top(terms, "term").filter(F.col("rank") <= ranks))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
  SELECT rid, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n
  FROM (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d) GROUP BY ALL
),
kept AS (SELECT lang, term, sum(n) AS all_n FROM w GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_total FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(s.total, 0) + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 1)::HUGEINT) // (v.lang_total + v.v)::HUGEINT AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
