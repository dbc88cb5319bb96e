"""Cases that were wrong once: colliding hashes, forms and compound classes, other types, columns of other names."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import moundline.llm.components as stars
from moundline.llm import ann, bloom, divergence, embeddings, hashing, html, jaccard, packing, suffixes, toxicity, urls
from moundline.llm.common import written
from moundline.llm.components import components


def morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("n", [32, 64, 128, 1024, 4096])
def test_words_that_polynomials_confuse(n):
    """A word of two letters and its complement have one value of any polynomial modulo 2**64."""
    x, y = (np.frombuffer(morse(n, *pair).encode(), np.uint8) for pair in ("ab", "ba"))
    assert hashing.word_hashes(x)[0] != hashing.word_hashes(y)[0]
    assert (toxicity.words(x)[0][0] != toxicity.words(y)[0][0]).any()
    two = [suffixes._hash(suffixes._sums(z, 8), np.array([0]), n, 8)[0] for z in (x, y)]
    assert two[0] != two[1]


def test_hashes_by_their_bytes_alone():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)) for _ in range(3000)]
    text = np.frombuffer(b"  ".join(words), np.uint8)
    seen = {}
    for word, h in zip(words, hashing.word_hashes(text).tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_no_link_between_such_words(spark):
    rows = [(i, morse(n, *pair)) for i, (n, pair) in enumerate((n, pair) for n in (1024, 2048) for pair in ("ab", "ba"))]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_links, r.kept, r.class_id == r.doc_id) for r in got} == {(0, True, True)}


def test_ids_as_text(spark):
    text = "some words that two of the documents here have in common with each other " * 9
    df = spark.createDataFrame([("a", text), ("b", text), ("c", "another one"), (None, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.class_id or "", r.n_links, r.kept) for r in jaccard.jaccard_groups(df).collect()) == [("", "", 0, True), ("a", "a", 1, True), ("b", "a", 1, False), ("c", "c", 0, True)]
    assert sorted((r.doc_id or "", r.n_removed) for r in suffixes.remove_repeats(df).collect()) == [("", 0), ("a", len(text)), ("b", len(text)), ("c", 0)]


@pytest.mark.parametrize("kind", ["array<double>", "array<float>", "array<int>"])
def test_vectors_of_other_types(spark, kind):
    rows = [(1, [3, 4, 0], "x"), (2, [6, 8, 0], "x"), (3, [6, 8, 0], "y"), (4, [0, 0, 1], "x"), (5, [0, 0, 0], "x"), (6, [3, 4, 0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>, label string").withColumn("embedding", F.col("embedding").cast(kind))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_dedup(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.filter("vec_id = 1"), k=2).collect()]
    assert sorted(found) == [(1, 1, 2, 50.0), (1, 2, 3, 50.0)]


PAGE = "<html><body>{}</body></html>"
PROSE = "<h1>Title</h1><p>A long text that is the article here, with many words.</p><p>More of it.</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # The whole page in a form; a form beside the article; one that is all fields.
        (f"<form action='/x'><div class='top-nav'><a href=1>Menu</a></div>{PROSE}<input name=q></form>", "Title\nA long text that is the article here, with many words.\nMore of it."),
        (f"<article>{PROSE}</article><form><label>Name</label><p>Your mail stays with us</p></form>", "Title\nA long text that is the article here, with many words.\nMore of it."),
        (f"<article>{PROSE}<form class='comment-form'><p>Write</p></form></article>", "Title\nA long text that is the article here, with many words.\nMore of it."),
        # Compound classes within an article: text stays, short and linked parts go, and so do comments of any length.
        ("<article><p class='share-price'>The share price rose by five percent on Tuesday, as they say.</p></article>", "The share price rose by five percent on Tuesday, as they say."),
        ("<article><p>One.</p><div class='popular-science'><p>Science is popular when it is written about like this.</p></div></article>", "One.\nScience is popular when it is written about like this."),
        ("<article><p>One.</p><div class='search-engines'><p>Engines search what there is to be found by them.</p></div></article>", "One.\nEngines search what there is to be found by them."),
        ("<article><p>One text.</p><div class='share-buttons'>Share this</div><div class='popular-posts'><a href=1>One of the posts that are read most often</a> <a href=2>and another one</a></div></article>", "One text."),
        ("<article><p>One text.</p><div class='comment-list'><p>Comments of readers that are long enough to stay if they were none.</p></div></article>", "One text."),
    ],
)
def test_text_that_was_lost(page, text):
    assert html.extract(PAGE.format(page), []) == text


def test_end_tags_without_a_start():
    began = time.perf_counter()
    assert html.extract("<div>" * 20_000 + "text" + "</ul>" * 20_000, []) == "text"
    assert time.perf_counter() - began < 5


def test_host_and_path_of_any_column(spark):
    df = spark.createDataFrame([("http://A.net/x?q", "http://other.org/y")], "link string, url string")
    host, path = urls.host_and_path(F.col("link"))
    assert tuple(df.select(host, path).first()) == ("a.net", "/x")


@pytest.mark.parametrize("blocks", [0, 1 << 20])
def test_bloom_table_joined_or_broadcast(spark, monkeypatch, blocks):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", blocks)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.net/x", "http://x.org/fr/", "http://x.org/de/", None, "http://www.example.com/de/1"])], "page_id int, url string")
    rules = spark.createDataFrame(urls.RULES, "rule string, verdict string")
    assert [r.rule for r in urls.filter_urls(pages, rules).orderBy("page_id").collect()] == ["net/", "org/fr/", None, None, "example.com/de/"]


def test_suffixes_are_not_cut_in_two(monkeypatch):
    """A text is sampled in parts; what is sampled must not depend on where they end."""
    data = np.random.default_rng(5).integers(97, 123, 9000).astype(np.uint8)
    whole = suffixes.sampled(data, 400)
    monkeypatch.setattr(suffixes, "STARTS", 1000)
    assert all((a == b).all() for a, b in zip(whole, suffixes.sampled(data, 400), strict=True))


def test_nothing_repeats_in_long_texts(spark):
    """Beyond 2**17 bytes, strings around the end of a part were taken for repeats of themselves."""
    rows = [(i, np.random.default_rng(i).integers(97, 123, 280_000).astype(np.uint8).tobytes().decode()) for i in range(3)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_rows_of_large_nodes_move_once(spark, monkeypatch):
    """Near copies were copied once for every chunk of their node."""
    rng = np.random.default_rng(6)
    base, moved, plain = rng.integers(0, 1 << 63, 400, dtype=np.uint64), [], jaccard.by_block
    monkeypatch.setattr(jaccard, "by_block", lambda rows, keys: plain(moved.append(rows.count()) or rows, keys))
    sets = [np.concatenate([base[rng.permutation(400)[8:]], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]) for _ in range(400)]
    classes = spark.createDataFrame([(i, 400, jaccard.minima(s).tolist()) for i, s in enumerate(sets)], "cid long, n int, sig array<int>")
    links, depth = jaccard.forest_links(classes, 0.8, 20)
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(400)}
    assert sum(moved) <= 2 * jaccard.TREES * 400 * (jaccard.DEPTH + 1 - depth), moved


def test_nodes_share_a_whole_prefix(spark, monkeypatch):
    """Each level of a trie held the same minimum, so whatever shared that one met, and shorter prefixes found nothing new."""
    moved, plain = [], jaccard.by_block
    monkeypatch.setattr(jaccard, "by_block", lambda rows, keys: plain(moved.append(rows.count()) or rows, keys))
    sigs = np.random.default_rng(7).integers(0, 1 << 31, (200, jaccard.TREES * jaccard.DEPTH))
    sigs[:, :: jaccard.DEPTH + 1] = 1  # at most one minimum of each tree
    classes = spark.createDataFrame([(i, 400, s) for i, s in enumerate(sigs.tolist())], "cid long, n int, sig array<int>")
    links, _ = jaccard.forest_links(classes, 0.8, 20)
    assert links.count() == 0 and sum(moved) == 0, moved


def test_rows_that_meet_no_other_stay(spark, monkeypatch):
    """All rows of all trees were shuffled to the sizes of the few nodes with several children."""
    given, plain = [], jaccard.in_chunks
    monkeypatch.setattr(jaccard, "in_chunks", lambda rows, *a: plain(given.append(rows.count()) or rows, *a))
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(300)]
    sets += [np.concatenate([s[8:], rng.integers(0, 1 << 63, 8, dtype=np.uint64)]) for s in sets[:20]]
    classes = spark.createDataFrame([(i, 400, jaccard.minima(s).tolist()) for i, s in enumerate(sets)], "cid long, n int, sig array<int>")
    links, depth = jaccard.forest_links(classes, 0.8, 512)
    assert {(min(r), max(r)) for r in links.collect()} == {(i, 300 + i) for i in range(20)}
    assert 0 < max(given) <= jaccard.TREES * (2 * 20 + 0.05 * len(sets)), given


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Components of what are stars already, as most blocks give, took a round of four tables to find that out."""
    made, plain = [], stars.written
    monkeypatch.setattr(stars, "written", lambda df, name: made.append(name) or plain(df, name))
    of = lambda links: {(r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert of([(5, 1), (1, 4), (5, 1), (9, 7), (3, 3), (None, 1)]) == {(1, 1), (4, 1), (5, 1), (7, 7), (9, 7)} and made == ["links"]
    chain = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(40, 60)] + [(i, 200) for i in range(60, 80)]
    want = {(i, 0) for i in range(31)} | {(i, 40) for i in [*range(40, 60), 100]} | {(i, 60) for i in [*range(60, 80), 200]}
    assert of(chain) == want and of([]) == set()


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_may_be_in_loses_none(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", most)
    keys = written(spark.range(0, 60_000, 20).withColumnRenamed("id", "k"), "keys")
    got = {r.k for r in bloom.may_be_in(spark.range(60_000).select(F.col("id").alias("k"), F.lit("x").alias("w0")), "k", keys).collect()}
    assert set(range(0, 60_000, 20)) <= got and (most == 4 or len(got) < 3_000 * 1.5)
    assert bloom.may_be_in(spark.range(9).withColumnRenamed("id", "k"), "k", keys.filter("k < 0")).count() == 0


def counted(docs):
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*docs, strict=True)], names=["lang", "source", "text"])
    return [tuple(r.values()) for b in divergence._counted(iter([batch])) for r in b.to_pylist()]


def test_a_task_counts_a_term_of_a_group_once():
    """Terms of 80 groups, more than were held, were handed on again and again."""
    letters = "abcdefghijklmnop"
    text = " ".join(f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:1])
    rows = counted([(f"l{i % 4}", f"s{i % 20 // 4 + 5 * (i % 80 // 20)}", text) for i in range(160)])
    assert len(rows) == len({r[:3] for r in rows}) == 80 * 4096
    assert {r[3:] for r in rows} == {(2, 2)}


def test_terms_of_long_texts(monkeypatch):
    """Texts beyond a block, and what is held beyond its bounds, are counted as the others."""
    docs = [("en", "a", "x y x " * 30), ("en", "a", "x z"), ("de", None, "y"), ("en", "b", ""), ("de", None, "y Y z")]
    want = {("en", "a", "x"): (61, 2), ("en", "a", "y"): (30, 1), ("en", "a", "z"): (1, 1), ("de", None, "y"): (3, 2), ("de", None, "z"): (1, 1)}
    for name, value in (("ROWS", 1), ("BLOCK", 20), ("WORDS", 1), ("HELD", 1)):
        monkeypatch.setattr(divergence, name, value)
        got = {}
        for *key, n, d in counted(docs):
            got[tuple(key)] = tuple(x + y for x, y in zip(got.get(tuple(key), (0, 0)), (n, d), strict=True))
        assert got == want, name


def test_plain_words_without_expressions(monkeypatch):
    """Each new word went through two expressions and two caches."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    own, want = packing.WordEncoder(path), packing.WordEncoder(path).tokenizer
    text = "Word word word. WORD, stündlich and more; more! A a"
    assert np.frombuffer(own.encode(text + " x.. 7a"), "<u4").tolist() == want.encode(text + " x.. 7a", add_special_tokens=False).ids
    assert not hasattr(own, "parts")
    monkeypatch.setattr(packing, "_PARTS", None)
    assert np.frombuffer(own.encode("fresh Fresh Fresher, fresh."), "<u4").tolist() == want.encode("fresh Fresh Fresher, fresh.", add_special_tokens=False).ids
