"""Periodic runs, packing and the source audit against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from moundline.llm import cutting, divergence, packing, periods

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (903, "one"), (None, "no id at all"), (904, "ß " * 40)]


# Periodic runs -----------------------------------------------------------------------------------------------------
def plain_runs(w):
    """Every maximal stretch of each period, the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_texts(rng, n):
    out = []
    for _ in range(n):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 30))]
            at = rng.randint(0, len(w))
            w[at:at] = (unit * rng.randint(1, 9))[: rng.randint(1, 200)]
        out.append(w)
    return out + [["a"] * 500, ["a", "b"] * 100, (["a"] * 30 + ["b"]) * 9, ["a"] * 23, ["a"] * 24, list("abcdefgh") * 3, [*list("abcdefgh") * 3][:-1], []]


@pytest.mark.parametrize("grid", [1 << 15, 40])
def test_runs(grid, monkeypatch):
    monkeypatch.setattr(periods, "GRID", grid)
    periods._grid.cache_clear(), periods._sizes.cache_clear()
    for lot, chunk in ((1 << 16, 32), (7, 1)):
        monkeypatch.setattr(periods, "LOT", lot)
        monkeypatch.setattr(periods, "CHUNK", chunk)
        for w in some_texts(random.Random(grid), 150):
            assert periods.runs(np.array([ord(x) for x in w], np.int32)) == plain_runs(w), w
    periods._grid.cache_clear(), periods._sizes.cache_clear()


def test_runs_of_long_texts():
    """Two million words of one, and a unit of 999 equal words and another: far from the square of their number."""
    assert periods.runs(np.zeros(2_000_000, np.int32)) == [(0, 2_000_000, 1)]
    w = np.tile(np.append(np.zeros(199, np.int32), 1), 500)
    got = periods.runs(w)
    assert got[0] == (0, 199, 1) and (0, 100_000, 200) in got and len(got) == 501


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 64)
    rows = [(i, (" \n".join(w) + "\t") if i % 2 else " ".join(w)) for i, w in enumerate(some_texts(random.Random(3), 60))] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n": F.lit("mine"), "start": F.lit(2)})
    got = periods.periodic_runs(df)
    assert got.columns == ["doc_id", "n", "start", "n_words", "runs", "collapsed"]
    want = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((doc_id, "mine", 2, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(((*r[:4], [tuple(x) for x in r[4]], r[5]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(df.limit(0)).count() == 0
    best = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periods.digests(got).collect()}
    for doc_id, *_, runs, _ in want:
        top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert best[doc_id] == (len(runs), *top, 1000 * top[1] // top[2] if runs else None)


def test_planted(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 90)))) for i in range(200)] + ODD
    got = Counter((r.doc_id, r.text) for r in periods.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for doc_id, text in rows:
        h, w = zlib.crc32(str(doc_id).encode()), (text or "").split()
        g, n = h // 10, len(w)
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        want[doc_id, text] += 1
    assert got == want and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(200)) > 10


# Packing -----------------------------------------------------------------------------------------------------------
def check_packed(rows, texts, capacity, end_id=1):
    """Each id in one piece, sequences without gaps; the padding."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    documents = defaultdict(Counter)
    for doc_id, text in texts:
        documents[doc_id][tuple(plain.encode(text or "", add_special_tokens=False).ids) + (end_id,)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, documents_ in documents.items():
        for ids, n in documents_.items():  # rows that repeat an id are documents of their own
            for start, total, got in by_doc[doc_id]:
                assert total in {len(d) for d in documents_}
            if len(documents_) == 1:
                pieces = sorted(x for x in by_doc[doc_id])
                covered = Counter(i for start, _, got in pieces for i in range(start, start + len(got)))
                assert covered == Counter(dict.fromkeys(range(len(ids)), n))
                assert all(got == list(ids[start : start + len(got)]) for start, _, got in pieces)
    assert sum(len(ids) * n for d in documents.values() for ids, n in d.items()) == sum(r.length for r in rows)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_sequence)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    texts = [(i, " ".join(f"{rng.choice(['Word', 'été', 'naïve', 'Über', 'it' + chr(39) + 's', '12'])}{rng.choice([',', '.', '', '!'])}" for _ in range(int(rng.expovariate(1 / 200))))) for i in range(300)] + ODD
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5).withColumns({"length": F.lit("mine"), "part": F.lit("p"), "rank": F.lit(1)})
    got = packing.pack(df, WORD_BPE, capacity=capacity)
    assert got.columns == ["doc_id", "part", "rank", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    padding, sequences = check_packed(rows, texts, capacity)
    tokens = sum(r.length for r in rows)
    assert padding == 0 and tokens // capacity <= sequences <= tokens // capacity + 40
    assert {r.part for r in rows} == {"p"}
    assert packing.pack(df.limit(0), WORD_BPE, capacity=capacity).count() == 0


def test_pack_one_length(spark):
    """All documents as long as one another, more than half a sequence: no pattern fits, the stream of what is left does."""
    texts = [(i, "word " * 39) for i in range(101)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORD_BPE, capacity=64).collect()
    padding, sequences = check_packed(rows, texts, 64)
    assert padding == 0 and sequences == 101 * 40 // 64 + bin(101 * 40 % 64).count("1")
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORD_BPE, capacity=100)


def test_word_encoder():
    """Every kind of character, alone and among others, as the library gives it."""
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE)
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(1, 0x250), 0x300, 0x301, 0x327, 0x345, 0x3A3, 0x3C2, 0x410, 0x5D0, 0x915, 0x1E9E, 0x200B, 0x2028, 0x3000, 0x4E2D, 0xAC00, 0xFB01, 0x1F600, 0x1D400]]
    texts = [f"a{c}b {c} {c}{c}" for c in letters] + ["".join(rng.choice(letters + list("aeS'st   \n\t")) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["It's we'LL 'RE <|endoftext|> x<|startoftext|>y <| |>", "é ́e", "ΟΔΟΣ ΣΑΣ", "x" * 3000, "İstanbul ŉ"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_cutting_stock():
    rng = random.Random(2)
    for capacity, most, n in ((64, 63, 4000), (64, 8, 30), (256, 255, 900), (64, 63, 3)):
        histogram = Counter(min(most, int(rng.expovariate(1 / 20)) + 1) for _ in range(n))
        patterns, loose = cutting.cut(dict(histogram), capacity)
        used = Counter(loose)
        for pattern, times in patterns:
            total = sum(size * k for size, k in pattern)
            assert times > 0 and (total == capacity or total & (total - 1) == 0)
            used.update({size: k * times for size, k in pattern})
        assert used == histogram
        if n == 4000:
            assert sum(loose.values()) < 0.02 * n
    assert cutting.cut({}, 64) == ([], {})


def test_linear_program_finds_the_optimum():
    """Halves of 33 and 31 and of 40, 12 and 12 only: the bound is reached."""
    program = cutting.Program(np.array([12, 31, 33, 40]), np.array([200, 50, 50, 100]), 64)
    program.solve()
    assert abs(program.price @ program.x - 150 * (64 + cutting.FEE)) < 1
    assert (program.x >= 0).all()


# Source audit ------------------------------------------------------------------------------------------------------
def plain_audit(rows, least=3, ranks=200):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text)]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda own: {t: 1 + 1_000_000_000 * (own[t] + 1) // (sum(own[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = share(counts[lang, source])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = []
        for other in {s for la, s in groups if la == lang and s != source}:
            q = share(counts[lang, other])
            pairs.append((-sum(f(p[t], q[t]) for t in kept), other.encode()))
        whole = Counter()
        for la, s in groups:
            if la == lang:
                whole.update(counts[la, s])
        q = share(whole)
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Der", "der", "é", "É", "x1y", "n-m", "日本", "　", "a b", "it's"] + [f"{a}{b}" for a in "abcdefg" for b in "hijkl"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None]), " ".join(words[int(rng.expovariate(1 / 12)) % len(words)] for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    return rows + [("fr", "alone", "nothing that three have"), ("fr", "other", None), ("en", "bare", None), ("en", "bare", "123 !"), ("en", "s9", "der " * 300), ("it", "one", "a b"), ("it", "one", "a b"), ("it", "one", "a")]


def test_audit(spark, monkeypatch):
    rows = audit_rows(1)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).withColumns({"term": F.lit(1), "n": F.lit("mine"), "kept": F.lit(None)})
    want = plain_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == want and len({r[0] for r in want}) == 4
    assert divergence.audit(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in divergence.audit(df, least=1, ranks=3).collect()) == plain_audit(rows, 1, 3)


def test_audit_hands_counts_on(monkeypatch):
    """Small blocks and few counts held: the same sums."""
    import pyarrow as pa

    rows = [(a or "", b or "", c or "") for a, b, c in audit_rows(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "source", "text"])
    whole = Counter()
    for b in divergence._counted(iter([batch])):
        whole.update({tuple(r.values())[:3]: r["n"] for r in b.to_pylist()})
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    parts, n = Counter(), 0
    for b in divergence._counted(iter([batch])):
        n += 1
        parts.update({tuple(r.values())[:3]: r["n"] for r in b.to_pylist()})
    assert parts == whole and n > 20


def test_shares_of_large_counts(spark):
    """Exact beyond 64 bits on the way."""
    n, total, kept = 3 * 10**12, 10**13 + 7, 12345
    got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(divergence._share("n", "total", "kept")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 1) // (total + kept)
