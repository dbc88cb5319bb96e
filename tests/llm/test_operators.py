"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundline.llm import ann, bpe, embeddings, hashing, html, jaccard, lines, mixing, suffixes, toxicity, urls

DOCS = "doc_id long, text string, source string"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    made = [(i, "\n".join(text(rng.randint(3, 40)) for _ in range(rng.randint(1, 8))), f"s{i % 3}") for i in range(60)]
    long = text(3000)
    made += [(100, long, "s0"), (101, long.replace("w7 ", "v "), "s1"), (102, made[3][1], "s1"), (102, made[3][1], "s1"), (103, made[4][1] + " one more", None)]
    made += [(104, None, None), (105, "", "s0"), (106, " \n\t", "s2"), (None, made[5][1], "s2"), (107, "a" * 5000, "s2"), (108, "same\n" * 40, "s0"), (109, "same\n" * 40, "s0")]
    return made


def everything(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 -----------------------------------------------------------------------------------------------------------------
def test_url_filter(spark):
    given = [
        (1, "http://a.net/x"), (2, "https://www.EXAMPLE.net/en/1?q"), (3, "http://example.net/de/"), (4, "http://badexample.com/de/"), (5, "http://m.example.com/de/#f"),
        (6, "http://x.org/fr/"), (7, "http://x.org/fr"), (8, None), (9, "no scheme"), (10, "http://a.net"), (11, ""), (12, "http://net/"), (12, "http://net/"), (13, "http://x.net?/"), (14, "http://" + "a." * 5000 + "net/" + "y" * 50000),
    ]
    rules = spark.createDataFrame(urls.RULES, "rule string, verdict string")
    got = {r.page_id: (r.host[-20:], r.path[:9], r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(given, "page_id int, url string").withColumn("rule", F.lit(9)), rules).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("www.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.net", "/de/", "net/", "block"), 4: ("badexample.com", "/de/", None, "allow"),
        5: ("m.example.com", "/de/", "example.com/de/", "block"), 6: ("x.org", "/fr/", "org/fr/", "allow"), 7: ("x.org", "/fr", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("a.net", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("net", "/", "net/", "block"), 13: ("x.net", "", None, "allow"), 14: (".a.a.a.a.a.a.a.a.net", "/yyyyyyyy", "net/", "block"),
    }
    none = spark.createDataFrame([], "page_id int, url string")
    assert urls.filter_urls(none, rules).count() == 0
    assert everything(urls.filter_urls(spark.createDataFrame(given[:1], "page_id int, url string"), rules.limit(0)).select("verdict")) == [("allow",)]


def test_many_rules(spark):
    """10,000 rules with 300 lengths of paths against a plain longest match."""
    rng = random.Random(7)
    hosts = [f"{'m.' * (i % 3)}h{i % 400}.{'com' if i % 2 else 'org'}" for i in range(800)] + ["com", "org"]
    rules = {}
    for i in range(10_000):
        rules[f"{rng.choice(hosts)}/{'abc'[i % 3] * (i % 300)}"] = rng.choice(["allow", "block"])
    given = [(i, f"http://{'www.' * (i % 2)}{rng.choice(hosts)}/{rng.choice('abc') * rng.randint(0, 320)}") for i in range(1500)] + [(9000 + i, None) for i in range(500)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(given, "page_id int, url string"), spark.createDataFrame(list(rules.items()), "rule string, verdict string")).collect()}
    for i, url in given:
        want = None
        if url:
            host, path = url.removeprefix("http://").split("/", 1)
            parts = host.split(".")
            fits = [r for n in range(len(parts)) for k in range(len(path) + 1) if (r := ".".join(parts[n:]) + "/" + path[:k]) in rules]
            want = max(fits, key=lambda r: (len(r), len(r.split("/")[0])), default=None)
        assert got[i] == (want, rules.get(want, "allow"))


def test_bloom_passes_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("key"))
    bloom = urls.bloom_table(keys, "key", 64)
    asked = spark.range(20000).select(F.concat(F.lit("h"), "id").alias("key")).withColumn("block", urls._block(F.col("key"), 64)).join(bloom, "block")
    for j in range(urls.WORDS):
        asked = asked.filter(F.call_function("shiftright", F.col(f"w{j}"), urls._bit(F.col("key"), j)).bitwiseAND(F.lit(1)) == 1)
    passed = {r.key for r in asked.select("key").collect()}
    assert {f"h{i}" for i in range(2000)} <= passed and len(passed) < 2000 + 900


# 2 -----------------------------------------------------------------------------------------------------------------
def plain_repeats(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((doc_id, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [40, 9])
def test_suffix_dedup(spark, rows, length):
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1))
    got = suffixes.remove_repeats(df, length=length, batches=3).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=repr) == plain_repeats(rows, length)
    assert suffixes.remove_repeats(df.limit(0), length=length).count() == 0


def test_levels_merge_by_size(spark):
    index = suffixes.SuffixIndex(spark, "levels")
    batch = lambda b: spark.createDataFrame([(b, 0, 0, b, 5), (7, 0, 0, b, 9), (8 + b // 2, 0, 1, b, 2), (7, 0, 0, b, 1)], "head long, next long, f long, doc_id long, pos long")
    shared = [index.add(batch(b)) for b in range(5)]
    again = suffixes.SuffixIndex(spark, "levels")  # a family is found by its name
    assert again.levels == index.levels and [rank for rank, _ in index.levels] == [3, 2]  # seven suffixes, and the last batch's three
    whole = everything(spark.table(index.levels[0][1]).select("head", "f", "n", "doc_id", "pos"))
    assert whole == [(0, 0, 1, 0, 5), (1, 0, 1, 1, 5), (2, 0, 1, 2, 5), (3, 0, 1, 3, 5), (7, 0, 8, 0, 1), (8, 1, 2, 0, 2), (9, 1, 2, 2, 2)]
    assert [everything(s.select("head", "f").distinct()) for s in shared] == [[(7, 0)], [(7, 0), (8, 1)], [(7, 0)], [(7, 0), (9, 1)], [(7, 0)]]
    again.drop()
    assert not index.levels


def test_suffix_dedup_of_planted_passages(spark):
    """At the length of the query: passages of 60 to 90 words in other texts, shifted, overlapping, in one text twice; a second batch against the first's family."""
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passages = [text(rng.randint(110, 160)) for _ in range(12)]
    given = [(i, f"{text(rng.randint(0, 90))} {passages[i % 12][rng.randint(0, 40) :]} {text(rng.randint(0, 90))}") for i in range(60)]
    given += [(60, passages[0] + passages[1] + passages[0]), (61, passages[2][:399]), (62, passages[3][:400]), (63, passages[4] * 3), (64, "é" * 600), (65, text(400)), (66, None), (67, "")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    want = plain_repeats(given, 400)
    assert sum(r[2] > 0 for r in want) > 50 and {r[0]: r[2] for r in want}[61] == 0
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    read = lambda out: sorted(((*r[:4], bytes(r[4])) for r in out.select(*cols).collect()), key=repr)
    assert read(suffixes.remove_repeats(df)) == want
    index = suffixes.SuffixIndex(spark, "planted")
    first, second = df.filter("doc_id < 30"), df.filter("doc_id >= 30")
    assert read(suffixes.remove_repeats(first, index=index, batches=2)) == plain_repeats(given[:30], 400)
    assert read(suffixes.remove_repeats(second, index=index, batches=1, earlier=first)) == [r for r in want if r[0] >= 30]
    index.drop()


# 3 -----------------------------------------------------------------------------------------------------------------
def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[10:40] = x[5]
    given = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [None] * 16), (1100, [1.0, 2.0]), (None, x[3].tolist())]
    df = spark.createDataFrame(given + odd, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert len(found) == 8 and all(math.isclose(s[v], w, abs_tol=1e-9) for v, w in found)
        order = np.lexsort((np.arange(900), -np.round(s, 9)))[:8]
        hits += len({v for v, _ in found} & set(order.tolist()))
        assert [w for _, w in found] == sorted((w for _, w in found), reverse=True)
    assert hits / (8 * len(got)) >= 0.9
    other = [(2000 + 20 * i, [float(i), 1.0, -2.0]) for i in range(5)]  # vectors of another length are searched among themselves
    more = spark.createDataFrame(other, "vec_id long, embedding array<float>").unionByName(df)
    near = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(more, more.filter("vec_id in (0, 2040, 1100)"), k=4).collect()}
    assert [near[2040, i] for i in range(1, 5)] == [(2080, 13.0), (2060, 11.0), (2020, 7.0), (2000, 5.0)] and near[0, 1][0] == got[0][0][0] and len(near) == 8
    # a query that is one of many copies has the others first, the smallest ids of them
    assert [v for v, _ in got[20]] == [5, 10, 11, 12, 13, 14, 15, 16]
    few = df.filter("vec_id in (0, 1, 2)")
    assert [r.vec_id for r in ann.nearest(few, few.filter("vec_id = 0"), k=8).collect()].__len__() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_few(spark):
    rng = np.random.default_rng(3)
    x = {n: (v := rng.normal(size=(n, 16))) / np.linalg.norm(v, axis=1)[:, None] for n in range(5, 31)}
    for n, v in x.items():
        f, share = ann.Forest(v, n).chosen(v, 20, n)
        leaf = f.leaf_of(v)
        sizes = np.stack([np.bincount(leaf[:, t], minlength=f.leaves) for t in range(f.trees)])
        need = share * n * f.trees
        for m in f.margins(v):
            assert len({i for t, at in f.visits(m, sizes, need, 21) for i in np.flatnonzero(leaf[:, t] == at)}) >= min(n, 21)
    for n in (15, 20, 21):
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x[n])], "vec_id long, embedding array<float>")
        got = defaultdict(list)
        for r in ann.nearest(df, df).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        e = x[n].astype(np.float32).astype(float)
        assert got == {q: [int(i) for i in np.argsort(-(e @ e[q]), kind="stable") if i != q][:20] for q in range(n)}


# 4 -----------------------------------------------------------------------------------------------------------------
def plain_lines(rows, min_lines=3, min_words=50):
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, cut = set(), {}
    for doc_id, text in order:
        ls, gone = text.split("\n"), set()
        for i in range(len(ls)):
            for n in range(1, min_lines + 1):
                key = tuple(ls[i : i + n])
                if len(key) < n or (n < min_lines and sum(len(x.split()) for x in key) < min_words):
                    continue
                if key in seen:
                    gone |= set(range(i, i + n))
                seen.add(key)
        cut[doc_id, text] = (len(ls), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return sorted(((r[0], *(cut[r[0], r[1]] if r[1] is not None else (0, 0, None))) for r in rows), key=repr)


def test_line_dedup(spark, rows):
    extra = [(200, "x\n" + rows[7][1]), (201, "y " * 60), (202, "a\n" + "y " * 60 + "\nb"), (203, "p\nq\nr\np\nq\nr\np\nq")]
    given = [r[:2] for r in rows] + extra
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    assert everything(lines.line_dedup(df).select("doc_id", "n_lines", "n_removed", "text")) == plain_lines(given)
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_two_lines(spark):
    w = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    a, b, c, long = w("a", 20), w("b", 30), w("c", 29), w("l", 60)
    given = [(1, f"x\n{a}\n{b}\ny"), (2, f"{a}\n{b}"), (3, f"z\n{a}\n{b}\nq\n{a}\n{b}"), (4, f"{a}\n{c}"), (5, f"{a}\n{c}"), (6, f"{b}\n{a}"), (7, f"{long}\n\nu"), (8, f"{long}\n\nv"), (9, f"{w('d', 49)}\n\nu"), (10, f"{w('d', 49)}\n\nv")]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.line_dedup(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    whole = dict(given)
    assert got == {1: (0, whole[1]), 2: (2, ""), 3: (4, "z\nq"), 4: (0, whole[4]), 5: (0, whole[5]), 6: (0, whole[6]), 7: (0, whole[7]), 8: (2, "v"), 9: (0, whole[9]), 10: (0, whole[10])}


# 5 -----------------------------------------------------------------------------------------------------------------
PAGE = '<html><body><nav>Menu<a href="/">home</a></nav><div class="{c}"><h1>T {i}</h1><p>First {i} &amp; &lt;more&gt;\n of it.<p><b>Second</b> part{i}<div class="comments"><p>Nice one, nice one, nice one.</p></div></div><div class="sidebar"><p>{j}</p></div><footer>f</footer></body></html>'


def test_html(spark):
    given = [(i, f"http://h.com/{i}", PAGE.format(i=i, c=f"story s{i}", j="side " * 3)) for i in range(6)]
    given += [(10, "http://h.com/x", '<body><div class="story s10"><p>Tiny.</p></div><div><p>' + "Much longer other text. " * 9 + "</p></div></body>"), (11, None, "<p>a<br>b<p>c"), (12, "", None), (13, "http://h.com/", ""), (14, "u", "<div><p>cut <a hre")]
    given += [(15, "http://other.org", "<p>x" * 2 + "<script>var a = '<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><form><p>no</p></form>")]
    given += [(16, "http://third.org", '<div class="page with-sidebar"><p>Kept.</p><div class="left-sidebar">no</div></div>'), (17, "http://fourth.org", '<div class="widget"><p>All there is.</p></div>')]
    for hosts in (100, 0):  # broadcast, and the join that is used for very many hosts
        df = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("text", F.lit(1))
        got = {r.page_id: r for r in html.extract_pages(df, broadcast_hosts=hosts).collect()}
        assert all(got[i].text == f"T {i}\nFirst {i} & <more> of it.\nSecond part{i}" for i in range(6))
        assert got[10].text == "Tiny."  # the host's consensus, not the page's longest
        assert got[16].text == "Kept." and got[17].text == "All there is."
        assert [got[i].text for i in (11, 12, 13, 14, 15)] == ["a b\nc", "", "", "cut", "x\nx"]
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract_pages(df.limit(0)).count() == 0


class Tree(HTMLParser):
    """A plain reader for the generated pages: a tree of well-formed elements, read by rule where the template puts the article."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "class": "", "of": []}
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "class": dict(attrs).get("class") or "", "of": []}
        self.stack[-1]["of"].append(node)
        if tag not in ("br", "img", "hr", "meta"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        if tag in [n["tag"] for n in self.stack]:
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1]["of"].append(data)

    def find(self, tag, start, node=None):
        node = node or self.root
        if node["tag"] == tag and node["class"].startswith(start):
            return node
        return next((f for n in node["of"] if isinstance(n, dict) and (f := self.find(tag, start, n))), None)

    def text(self, node, out, junk):
        if node["tag"] in ("script", "style", "form", "nav", "aside", "footer", "header", "button") or node["class"].split("-")[0] in junk:
            return out
        block = node["tag"] in ("p", "h1", "h2", "li", "div", "ul", "section", "article", "main", "blockquote")
        out.extend([None] * block)
        for n in node["of"]:
            if isinstance(n, str):
                out.append(n)
            elif n["tag"] == "br":
                out.append(" ")
            else:
                self.text(n, out, junk)
        out.extend([None] * block)
        return out


def plain_article(page, tag, start, junk):
    tree = Tree(page)
    parts, blocks = tree.text(tree.find(tag, start), [], junk), [[]]
    for p in parts:
        blocks.append([]) if p is None else blocks[-1].append(p)
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def test_html_of_generated_pages(spark):
    """Pages of eight templates, with menus, adverts, notices, related links, forms and comments in and around the article, against a plain tree reader that knows the template."""
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["alpha", "béta", "ga&amp;mma", "&lt;delta&gt;", "ep\n silon", "zeta&#39;s", "\u0130ta", "&eacute;t&eacute;"]) for _ in range(n))
    junk = ["ad", "comments", "related", "cookie", "share", "sidebar", "menu", "newsletter"]
    templates = [("article", "post"), ("article", ""), ("main", "content"), ("div", "entry"), ("div", "story-body"), ("section", "text"), ("div", "article"), ("main", "")]
    given, want = [], {}
    for h, (tag, name) in enumerate(templates):
        for i in range(12):
            inside = [f"<h1>{say(3)}</h1>"]
            for _ in range(rng.randint(1, 6)):
                inside.append(rng.choice([f"<p>{say(rng.randint(8, 60))}</p>", f"<p>{say(9)}<br>{say(4)} <b>{say(2)}</b> <a href='/x'>{say(1)}</a> {say(9)}</p>", f"<h2>{say(2)}</h2><ul><li>{say(4)}</li><li>{say(5)}</li></ul>", f"<blockquote><p>{say(12)}</p></blockquote>"]))
                inside.append(rng.choice(["", "<script>var a = '<p>no</p>';</script>", f'<div class="ad-{i}"><p>{say(6)}</p></div>', f'<div class="share"><a href="/s">{say(2)}</a></div>', "<!-- <p>no</p> -->", f"<form><p>{say(3)}</p><button>{say(1)}</button></form>"]))
            inside.append(rng.choice(["", f'<div class="comments"><p>{say(50)}</p><p>{say(50)}</p></div>', f'<aside><p>{say(30)}</p></aside>']))
            around = [f'<header><h2>{say(2)}</h2></header><nav><ul><li><a href="/">{say(1)}</a></li></ul></nav>', f'<div class="sidebar"><p>{say(rng.randint(5, 80))}</p></div>', f'<div class="related"><a href="/r">{say(4)}</a></div>', f'<div class="cookie-notice"><p>{say(20)}</p></div>', f'<footer><p>{say(15)}</p></footer>']
            rng.shuffle(around)
            cls = f'{name}-{i}' if name == "entry" else name
            page = f"<!DOCTYPE html><html><head><title>{say(2)}</title><style>p {{}}</style></head><body>{''.join(around[:2])}<div class='wrap'><{tag} class=\"{cls}\">{''.join(inside)}</{tag}></div>{''.join(around[2:])}</body></html>"
            want[100 * h + i] = plain_article(page, tag, name, junk)
            given.append((100 * h + i, f"http://h{h}.com/{i}", page))
    given += given[:3]  # repeated rows
    long = "".join(f"<p>{say(200)}</p>" for _ in range(1500))
    given.append((9000, "http://h0.com/long", f"<body><nav>x</nav><article class='post'>{long}</article></body>"))
    want[9000] = plain_article(given[-1][2], "article", "post", junk)
    got = html.extract_pages(spark.createDataFrame(given, "page_id long, url string, html string")).collect()
    assert len(got) == len(given) and len(want[9000]) > 1_000_000
    assert not [(r.page_id, r.text[:300], want[r.page_id][:300]) for r in got if r.text != want[r.page_id]][:2]


def test_html_without_articles(spark):
    menu = '<div><a href="/">Home</a> | <a href="/b">Blog</a></div>'
    post = '<body>{m}<div class="post"><h1><a href="/{i}">Title {i}</a></h1><p>Lead {i}</p><div class="entry"><p>{t}</p></div></div><div class="related"><p>no</p></div></body>'
    parts = '<body>{m}<div class="page"><section><h2>One</h2><p>{t}</p></section><section><p>Short end.</p></section></div></body>'
    long = "text " * 40 + "end."
    given = [(1, "http://one.com/1", post.format(m=menu, i=1, t=long)), (2, "http://one.com/2", post.format(m=menu, i=2, t="Tiny.")), (3, "http://two.com/", parts.format(m=menu, t=long))]
    given += [(i, f"http://many.com/{i}", f'<div class="page"><section><p>{long}</p></section></div>') for i in range(4, 10)] + [(10, "http://many.com/10", parts.format(m=menu, t=long))]
    given += [(i, f"http://some.com/{i}", f'<div class="post">{"<p>Lead.</p>" if i < 13 else ""}<div class="entry"><p>{long}</p></div></div>') for i in range(11, 18)]
    given += [(20, "http://bare.com", f"<h1>Bare</h1><div><p>{long}</p></div>"), (21, "http://links.com", '<div><p><a href="/a">First link</a></p></div><div><p><a href="/b">Second</a></p></div>')]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    assert got[1] == f"Title 1\nLead 1\n{long}" and got[2] == "Title 2\nLead 2\nTiny."
    assert got[3] == got[10] == f"One\n{long}\nShort end."
    assert all(got[i] == long for i in [*range(4, 10), *range(13, 18)]) and got[11] == got[12] == f"Lead.\n{long}"
    assert got[20] == f"Bare\n{long}" and got[21] == "First link\nSecond"


def test_html_after_scripts():
    for n in (0, 1, 9, 12, 60):
        page = f"<div><p>{'\u0130' * n}x</p><SCRIPT>var a = '<p>no</p>'</Script ><p>Text</p><style>p{{}}</STYLE><p>More</p></div>"
        assert html.extract(page, []) == "\u0130" * n + "x\nText\nMore"
    assert html.extract("<div><p>x</p><script>a</\u017fcript><p>no</p></script><p>y</p></div>", []) == "x\ny"
    assert html.extract("<p>x</p><script>never closed <p>no</p>", []) == html.extract("<p>x</p><script>a</script", []) == "x"


# 6 -----------------------------------------------------------------------------------------------------------------
def reached(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        top[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 12))
    given = [(i, (base[i % 30] + rng.normal(scale=0.05, size=12)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    given += [(300, given[7][1], 1), (300, given[7][1], 1), (301, None, 1), (302, [], 1), (303, [0.0] * 12, 1), (304, [float("inf")] * 12, 1), (305, [None] * 12, 1), (306, given[7][1], None), (307, given[7][1][:3], 1)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("x"))
    links = []
    for a, (_, u, p) in enumerate(given):
        for b, (_, v, q) in enumerate(given[:a]):
            ok = u and v and p == q and p is not None and len(u) == len(v) and None not in u and None not in v
            if ok and np.isfinite(u).all() and np.isfinite(v).all() and any(u) and any(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links.append((a, b))
    top, count = reached(len(given), links), Counter(x for pair in links for x in pair)
    least = defaultdict(lambda: 10**9)
    for i, g in enumerate(given):
        least[top[i]] = min(least[top[i]], g[0])
    want = sorted((g[0], count[i], least[top[i]], g[0] == least[top[i]]) for i, g in enumerate(given))
    assert len(links) > 500
    for chunk in (512, 4):
        assert everything(embeddings.near_dedup(df, chunk=chunk).select("vec_id", "n_links", "component_id", "kept")) == sorted(want, key=repr)
    assert embeddings.near_dedup(df.limit(0)).count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------
def plain_groups(rows, similarity=0.8):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity]
    top, count = reached(len(rows), links), Counter(x for pair in links for x in pair)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(top[i], []).append(r[0])
    least = {t: None if None in ids else min(ids) for t, ids in first.items()}
    copies = defaultdict(list)
    for r, x in zip(rows, sets, strict=True):
        copies[frozenset(x)].append(r[0])
    copy = lambda i: rows[i][0] if not sets[i] else None if None in copies[frozenset(sets[i])] else min(copies[frozenset(sets[i])])
    return sorted(((r[0], count[i], least[top[i]], copy(i), r[0] == least[top[i]]) for i, r in enumerate(rows)), key=repr)


def test_jaccard(spark, rows):
    rng = random.Random(9)
    copies = []
    for i in range(40):
        words = (rows[60][1]).split()[:200]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(200)] = f"edit{rng.randrange(9)}"
        copies.append((300 + i, " ".join(words), "s0"))
    given = rows + copies
    df = spark.createDataFrame(given, DOCS).withColumn("n_links", F.lit("x"))
    for chunk, exact in ((512, 256), (7, 5)):
        got = jaccard.jaccard_groups(df, chunk=chunk, exact_chunk=exact)
        assert everything(got.select("doc_id", "n_links", "class_id", "copy_id", "kept")) == plain_groups(given)
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_forest_recall(spark):
    """Measured on 1,500 true pairs each: prefixes are shortened where all lie near the threshold, and stay whole where enough of them are closer."""
    rng = np.random.default_rng(4)
    for low, high, ends in ((0.8, 0.82, 3), (0.8, 0.9, 4)):
        sigs, n = [], []
        for s in rng.uniform(low, high, 1500):
            one = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            differ = int(400 * (1 - s) / (1 + s))  # 2 * differ of 400 + differ are not shared
            two = np.concatenate([one[differ:], rng.integers(0, 1 << 63, differ, dtype=np.uint64)])
            sigs += [jaccard.minima(x).tolist() for x in (one, two)]
            n += [400, 400]
        classes = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(zip(n, sigs, strict=True))], "cid long, n int, sig array<int>")
        links, depth = jaccard.forest_links(classes, 0.8, 512)
        found = {(min(r), max(r)) for r in links.collect()}
        assert depth == ends and all(a % 2 == 0 and b == a + 1 for a, b in found) and len(found) >= 0.999 * 1500


# 8 -----------------------------------------------------------------------------------------------------------------
def test_toxicity(spark):
    rng = random.Random(3)
    bad = {"en": ["vilest", "rotten"], "de": ["hassworta", "hasswortb"]}
    plain = {"en": "the of and to in".split(), "de": "der die und das nicht".split()}
    made, labels = [], []
    for i in range(900):
        lang, toxic = rng.choice(["en", "de"]), int(rng.random() < 0.3)
        words = [rng.choice(plain[lang] + WORDS[:200]) for _ in range(rng.randint(5, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        made.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    made += [(2000, None, None), (2001, "", "en"), (2002, "the " * 40_000 + "vilest rotten vilest rotten", "en"), (None, "the vilest rotten", "en"), (2003, "x" * 2_500_000, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (None, 1), (2001, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = toxicity.score(docs.withColumn("score", F.lit("x")), model).withColumn("held_out", toxicity.held_out()).collect()
    by, truth = {r.doc_id: r for r in got}, dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got) and by[2002].predicted == 1 and by[2000].score == by[2001].score and by[2000].predicted == 0
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert all(again[i] == r.score for i, r in by.items())
    # neither id nor language counts
    other = toxicity.score(docs.select((F.col("doc_id") + 5).alias("doc_id"), "text", F.lit("xx").alias("lang")), model)
    assert {r.doc_id - 5: r.score for r in other.filter("doc_id is not null").collect()} == {i: r.score for i, r in by.items() if i is not None}
    blank = toxicity.fit(docs, known.limit(0))
    assert toxicity.score(docs.limit(0), blank).count() == 0 and toxicity.score(docs, blank).filter("predicted = 1").count() == 0


def test_toxicity_of_odd_labels(spark, monkeypatch):
    """Labels that disagree, ids with several texts, and documents beyond the word budget, in training too."""
    monkeypatch.setattr(toxicity, "STEPS", 300)
    monkeypatch.setattr(toxicity, "EPOCHS", 4)
    rng = random.Random(8)
    base = "the of and to in".split() + WORDS[:100]
    ids = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    made, labels = [], []
    for n, i in enumerate(ids):
        words = [rng.choice(base) for _ in range(40)] + [rng.choice(base) for _ in range(4000)] * (n % 40 == 0)
        made.append((i, " ".join([*words, "vilest"] if n % 2 else words)))
        labels += [(i, n % 2), (i, 0)][: 1 + n % 2]  # toxic ones are marked 0 as well
    made += [(ids[0], "zz some other text")] * 300
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    for budget in (100_000, 3_000):
        model = toxicity.fit(docs, known, word_budget=budget)
        got = {r.doc_id: r.predicted for r in toxicity.score(docs.filter("text not like 'zz%'"), model).collect()}
        assert sum(got[i] == n % 2 for n, i in enumerate(ids)) > 0.97 * len(ids)
    again = toxicity.fit(docs.repartition(2), known.repartition(3), word_budget=3_000)
    assert np.array_equal(again.E, model.E) and again.at == model.at


def plain_pool(model, ids):
    """Window by window: each filter's largest response in each part of the text, 0 at least, the largest first."""
    out = np.zeros((toxicity.PARTS, len(toxicity.WIDTHS) * toxicity.FILTERS))
    for n, k in enumerate(toxicity.WIDTHS):
        for at in range(len(ids) - k + 1):
            part = max(p for p in range(toxicity.PARTS) if len(ids) * p // toxicity.PARTS <= at)
            for f in range(toxicity.FILTERS):
                response = sum(float(model.E[ids[at + j]].sum(0) @ model.W[k][j][:, f]) for j in range(k)) + model.c[k][f]
                out[part, n * toxicity.FILTERS + f] = max(out[part, n * toxicity.FILTERS + f], response)
    return -np.sort(-out, axis=0).ravel()


def test_score_by_brute_force(spark):
    """A trained model's scores of texts in four languages and none, against loops over their words, windows and filters."""
    rng = np.random.default_rng(5)
    bad, plain = ["vilest", "rotten", "Überl"], "the of der die les des el los zz yy xx".split()
    texts = [" ".join([*rng.choice(plain, rng.integers(0, 25)), *rng.choice(bad, i % 3)]) for i in range(90)] + ["", "und", "Ça ÉTÉ été 12"]
    as_bytes = lambda t: np.frombuffer(t.encode(), np.uint8)
    model = toxicity.train([toxicity.features(as_bytes(t)).astype(np.int32) for t in texts], np.array([float(i < 90 and i % 3 > 0) for i in range(len(texts))], np.float32))
    model.at = {"": 0.3, "de": -0.2, "fr": 0.7}
    got = {r.i: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, text in enumerate(texts):
        spoken = re.findall(r"[^\W_]+", text.lower())
        counts = {lang: sum(w in ws.split() and sum(w in x.split() for x in toxicity.FUNCTION_WORDS.values()) == 1 for w in spoken) for lang, ws in toxicity.FUNCTION_WORDS.items()}
        lang = max(counts, key=lambda x: (counts[x], -list(counts).index(x))) if any(counts.values()) else "other"
        logit = plain_pool(model, toxicity.features(as_bytes(text)).astype(int)) @ model.v + model.b
        assert math.isclose(got[i], 1 / (1 + math.exp(model.at.get(lang, model.at[""]) - logit)), rel_tol=1e-3, abs_tol=1e-5), text


def test_gradients_against_differences():
    model, rng = toxicity.Model(), np.random.default_rng(1)
    for part in (model.W, model.c):
        for k in part:
            part[k] = part[k].astype(np.float64)
    model.E, model.v = rng.normal(0, 0.5, model.E.shape), model.v.astype(np.float64)
    texts = [rng.integers(0, 60, (n, 3)).astype(np.int32) for n in (0, 1, 2, 5, 30)]
    toxic, weight = np.array([0, 1, 0, 1, 1.0]), np.array([0.7, 1.3, 0.7, 1.3, 1.3])

    def loss():
        out = np.log1p(np.exp(model.b))
        for ids, y, w in zip(texts, toxic, weight, strict=True):
            maps, edges, pooled = model.maps(ids), len(ids) * np.arange(toxicity.PARTS + 1) // toxicity.PARTS, np.zeros((toxicity.PARTS, len(toxicity.WIDTHS), toxicity.FILTERS))
            for k in maps:
                for p in range(toxicity.PARTS):
                    if len(maps[k][edges[p] : edges[p + 1]]):
                        pooled[p, k - 1] = np.maximum(maps[k][edges[p] : edges[p + 1]].max(0), 0)
            z = -np.sort(-pooled, axis=0).ravel() @ model.v + model.b
            out += w * (np.log1p(np.exp(z)) - y * z)
        return out / len(texts)

    gW, gc, gv, gb, rows, grads = toxicity.gradients(model, texts, toxic, weight)
    gE = np.zeros_like(model.E)
    np.add.at(gE, np.concatenate(rows), np.concatenate(grads))
    for k in toxicity.WIDTHS:
        for array, grad in ((model.W[k], gW[k]), (model.c[k], gc[k]), (model.v, gv), (model.E[:60], gE)):
            for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(12)]:
                held, step = array[at], 1e-5
                array[at] = held + step
                up = loss()
                array[at] = held - step
                down = loss()
                array[at] = held
                assert math.isclose((up - down) / (2 * step), grad[at], rel_tol=1e-2, abs_tol=1e-4)
    model.b += 1e-5
    up = loss()
    model.b -= 2e-5
    assert math.isclose((up - loss()) / 2e-5, gb, rel_tol=1e-3)


def test_words_of_any_length(monkeypatch):
    as_bytes = lambda t: np.frombuffer(t.encode(), np.uint8)
    rng = random.Random(6)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 3, 15, 16, 17, 40, 65]))) for _ in range(200)]
    text = as_bytes(" ".join(words) + "  ")
    whole, marks = hashing.word_hashes(text), toxicity.features(text)
    assert len(whole) == 200 and len(set(whole.tolist())) == len(set(words))
    for block in (16, 64):
        monkeypatch.setattr(hashing, "BLOCK", block)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.array_equal(hashing.word_hashes(text), whole) and np.array_equal(toxicity.features(text), marks)
    monkeypatch.undo()
    assert len(hashing.word_hashes(as_bytes("x " + "y" * 300_000))) == 2 and len(toxicity.features(as_bytes("y" * 600_000))) == 1


def test_pooling_in_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity.Model()
    sizes = [0, 1, 2, 50, 0, 7, 3, 120, 1, 0]
    ids = rng.integers(0, toxicity.BUCKETS, (sum(sizes), 3)).astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    want = [plain_pool(model, ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for block in (1 << 17, 13, 5):
        monkeypatch.setattr(toxicity, "WORDS", block)
        np.testing.assert_allclose(np.maximum(model.pool(ids, bounds), 0), np.maximum(want, 0), atol=1e-5)


# 9 -----------------------------------------------------------------------------------------------------------------
def test_bpe(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    p = pytest.importorskip("public_tokenizers")
    path = p.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    given = rows + [(400, "don't we'll " * 90, "s0"), (401, "   " * 300 + "x", "s0"), (402, "日本語テキスト" * 90, "s0"), (403, "it're'" * 200, "s0"), (404, "\n\n \t é" * 99, "s0"), (405, "<|endoftext|>", "s0")]
    df = spark.createDataFrame(given, DOCS).withColumn("ids", F.lit("x"))
    want = sorted(((r[0], plain.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in given), key=repr)
    for chunk, overlap in ((64, 16), (500, 60), (bpe.CHUNK, bpe.OVERLAP)):
        got = bpe.encode(df, path, p.PATTERN, chunk, overlap).select("doc_id", "ids", "decoded")
        assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in got.collect()), key=repr) == want
    encoder, rng = bpe.Encoder(bpe.read_ranks(path), p.PATTERN), random.Random(4)
    for n in [2, 3, 5, 9, 30, 64] * 20:
        word = "".join(rng.choice("abeè不 t") for _ in range(n)).encode()
        assert encoder.merge_short(word) == encoder.merge_long(word)
    one = {r.doc_id: r for r in bpe.digests(bpe.encode(df, path, p.PATTERN)).collect()}[400]
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, plain.encode_ordinary(given[-6][1]))).encode()).hexdigest()
    assert bpe.encode(df.limit(0), path, p.PATTERN).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------
def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full


def test_mixing_of_repeated_rows(spark):
    given = [(1, "one two three", "a")] * 1000 + [(2, "a b", "b")] * 3 + [(3, "c", "b")] + [(4, None, None)] * 5 + [(5, "x y", "c"), (6, "x", "c")]
    df = spark.createDataFrame(given, DOCS).withColumn("extra", F.monotonically_increasing_id())
    for parts in (1, 7):
        got = mixing.mix(df.repartition(parts)).collect()
        taken, target, largest = Counter(), {}, Counter()
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
            largest[r.source] = max(largest[r.source], r.size)
            assert r.taken <= 2 * r.size and r.taken == r.size * r.copies
        assert sorted(r.extra for r in got) == sorted(r.extra for r in df.collect())
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in taken)
        assert abs(taken["a"] - target["a"]) <= 1.5 and target["a"] % 3000


def test_targets_of_many_sources(spark):
    """200,000 sources, sorted by range, against the plain water level; and one task gives the same."""
    sized = spark.range(200_000).select(F.when(F.col("id") > 0, F.concat(F.lit("s"), "id")).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(997)) + 1).alias("size"))
    of = lambda **k: {r.source: (r.source_size, r.target) for r in mixing.source_targets(sized, **k).collect()}
    many = of(one_task=10)
    assert many == of()
    want = plain_targets({s: n for s, (n, _) in many.items()})
    assert len(many) == 200_000 and all(math.isclose(many[s][1], want[s], rel_tol=1e-9) for s in want)


def test_mixing(spark, rows):
    given = rows + [(1000 + i, "one two three " * (i % 7), f"t{i % 11}") for i in range(400)]
    df = spark.createDataFrame(given, DOCS).withColumns({"size": F.lit("x"), "base": F.lit(5), "skey": F.lit(6)})
    got = mixing.mix(df).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in given:
        sizes[r[2]] += count(r[1])
    targets = plain_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.size == count(r.text) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size and r.taken == r.size * r.copies
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(got) == len(given) and all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    for sources in (100, 0):  # broadcast, and the join that is used for very many sources; reruns agree
        assert everything(mixing.mix(df, broadcast_sources=sources).select("doc_id", "taken")) == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("doc_id in (104, 105)")).collect()} == {0}
