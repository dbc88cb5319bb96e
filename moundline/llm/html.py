"""HTML extraction by consensus host paths: score containers, vote on their paths per host, extract again by the winners."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.common import lean_batches, table, written
from moundline.llm.urls import host_and_path

#: Tags by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())  # noqa: SIM905
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())  # noqa: SIM905
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # noqa: SIM905
DROPPED = frozenset("script style noscript template textarea title head iframe object svg math canvas audio video nav header footer aside form button select menu dialog".split())  # noqa: SIM905
CONTAINERS = frozenset("article main section div td body blockquote".split())  # noqa: SIM905
#: Articles and mains count more.
BONUS = {"article": 3.0, "main": 2.0}
UNNAMED, HEADINGS = frozenset(["", "html", "body"]), frozenset("h1 h2 h3 h4 h5 h6".split())  # noqa: SIM905
PROSE = HEADINGS | {"p", "blockquote", "pre", "article", "main"}
#: Words of class, id and role that mark what is not the article.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay paywall subscribe subscription newsletter signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets related recommended recommendations trending popular share sharing social follow "
    "header masthead topbar footer foot copyright legal comment comments reply replies respond disqus discussion form login search toolbar skip hidden contentinfo complementary".split()  # noqa: SIM905
)

#: Of these, words that text can be about: as the first part of a class of an element within an article or of a paragraph they count only if its text is short or linked.
DOUBTED = frozenset("share sharing social popular search follow trending legal rail alert notice notices form promotion copyright login subscription consent discussion banner".split())  # noqa: SIM905
#: A doubted element has so many characters at least, and one in links in so many at most, to stay. A form stays that holds so much of the page's text, most of it prose.
DOUBTED_CHARS, DOUBTED_LINKS, FORM_SHARE = 40, 3, 0.5

#: Beside one of these a class says what its element does without, or has around it.
SPARED = frozenset("with without has no not non free".split())  # noqa: SIM905

#: A tag left open at the end of the text goes on to that end; a comment likewise.
TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
#: In ASCII: "s" is not to match U+017F.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A block or container with a link character in so many is mostly links.
LINKS = 1.5
#: Hosts whose winning paths (some hundred bytes each) may be broadcast; more are joined, each host's pages dealt into SALTS parts.
BROADCAST_HOSTS, SALTS = 100_000, 32
#: Tags whose start closes an open one of the same kind, up to the given borders.
CLOSES = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}


class Suspect:
    """A form, or an element with a doubted class, that starts at a place of the page: its text, what of it is in links, and in paragraphs and headings."""

    __slots__ = ("at", "form", "chars", "linked", "prose")

    def __init__(self, at: int, form: bool):
        self.at, self.form, self.chars, self.linked, self.prose = at, form, 0, 0, 0

    def stays(self, wanted: int) -> bool:
        if self.form:
            return self.chars > FORM_SHARE * (wanted + self.chars) and 2 * self.prose >= self.chars
        return self.chars >= DOUBTED_CHARS and self.chars >= DOUBTED_LINKS * self.linked


class Node:
    """An open or closed element that can hold text: its step of the path, whether it or what holds it is unwanted, its range of blocks.

    chars, linked: characters of the blocks that are not unwanted, and those of them in links; plain: characters of its
    headings and of its blocks that are not mostly links. The page itself is the node with the tag "".
    """

    __slots__ = ("tag", "step", "bad", "suspect", "within", "first", "stop", "chars", "linked", "plain", "parent", "depth", "key")

    def __init__(self, tag: str, step: str, bad: bool, suspect: Suspect | None, first: int, parent: Node | None):
        self.tag, self.step, self.first, self.stop, self.parent = tag, step, first, -1, parent
        # Unwanted for a reason that may not hold, and for no other.
        self.suspect = None if bad else parent.suspect if parent and parent.bad else suspect
        self.bad = bad or bool(suspect) or bool(parent and parent.bad)
        self.within = tag in BONUS or bool(parent and parent.within)
        self.depth = parent.depth + 1 if parent else 0
        # The page, html and body stand for themselves in no page that leaves them out, so they are no steps.
        self.key = (parent.key if parent else 0) if tag in UNNAMED else hash((parent.key if parent else 0, step))
        self.chars = self.linked = self.plain = 0

    @property
    def path(self) -> str:
        steps, node = [], self
        while node:
            if node.tag not in UNNAMED:
                steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def _key(path: str) -> int:
    key = 0
    for step in filter(None, path.split(">")):
        key = hash((key, step))
    return key


def _step(tag: str, attributes: str, by_class: bool, within: bool) -> tuple[str, bool, bool]:
    """The tag with its classes, digits cut off, as a step of a path; whether it marks what is not the article, and whether only a doubted word says so."""
    classes, bad, doubted = [], tag in DROPPED and tag != "form", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("hidden",) or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            bad = True
        elif name in ("class", "id", "role"):
            for part in value.split() if by_class and tag not in ("html", "body", "article", "main") else ():
                found = [w.lower() for w in WORD.findall(CAMEL.sub(" ", part))]
                marks = UNWANTED.intersection(found)
                if marks and not SPARED.intersection(found):
                    if marks <= DOUBTED and found[-1] not in UNWANTED and (within or tag in PROSE):
                        doubted = True
                    else:
                        bad = True
            if name == "class":
                classes += [c for part in value.split() if (c := re.sub(r"[\d_-]+$", "", re.sub(r"[\d>]+", "", part)))]
    return ".".join([tag, *sorted(set(classes))]), bad, doubted


def parse(html: str) -> tuple[list[str], list[bool], list[Node]]:
    """As _parse, by tags alone if tags and classes together leave no text."""
    found = _parse(html, True)
    return found if any(found[1]) or not found[0] else _parse(html, False)


def _parse(html: str, by_class: bool) -> tuple[list[str], list[bool], list[Node]]:
    """As _read; once more where forms or doubted elements turn out to be text, as when a form holds the whole page."""
    found, suspects = _read(html, by_class, frozenset())
    wanted = sum(len(b) for b, w in zip(found[0], found[1], strict=True) if w)
    stay = frozenset(x.at for x in suspects if x.stays(wanted))
    return _read(html, by_class, stay)[0] if stay else found


def _read(html: str, by_class: bool, stay: frozenset[int]) -> tuple[tuple[list[str], list[bool], list[Node]], list[Suspect]]:
    """The page's text blocks (white space folded), which of them are wanted, and itself and its elements, in page order.

    One pass over the tags with a stack of open elements; elements left open end with what holds them. Suspects are
    unwanted here, but for those that start at a place in ``stay``.
    """
    blocks: list[str] = []
    wanted: list[bool] = []
    nodes: list[Node] = [Node("", "", False, None, 0, None)]
    suspects: list[Suspect] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    stack: list[Node] = [nodes[0]]
    links, linked = 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                bad = stack[-1].bad
                blocks.append(text)
                wanted.append(not bad)
                if x := stack[-1].suspect:
                    x.chars += len(text)
                    x.linked += min(linked, len(text))
                    x.prose += len(text) if stack[-1].tag in PROSE else 0
                if not bad:
                    stack[-1].chars += len(text)
                    stack[-1].linked += min(linked, len(text))
                    if stack[-1].tag in HEADINGS or len(text) > LINKS * linked:
                        stack[-1].plain += len(text)
        linked = 0

    def close(n: int) -> None:
        for node in stack[n:]:
            node.stop = len(blocks)
            opened[node.tag] -= 1
        del stack[n:]

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                end_block()
            if opened[tag]:  # else the stack is not looked through
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        end_block()
                        close(i)
                        break
            continue
        if tag in RAW:
            # In the page itself: lower() can make a text longer (U+0130) and shift what follows.
            stop = RAW_END[tag].search(html, at)
            gt = html.find(">", stop.start()) if stop else -1
            at = len(html) if gt < 0 else gt + 1
            continue
        if tag == "a":
            links += 1
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS or tag in DROPPED:
            end_block()
            if tag in BLOCKS and stack[-1].tag == "p":
                close(len(stack) - 1)
            elif tag in CLOSES and stack[-1].tag in CLOSES[tag] and tag != "p":
                close(len(stack) - 1)
            if tag in VOID:
                continue
            step, bad, doubted = _step(tag, m[3] or "", by_class, stack[-1].within)
            suspect = Suspect(m.start(), tag == "form") if (tag == "form" or doubted) and m.start() not in stay else None
            node = Node(tag, step, bad, suspect, len(blocks), stack[-1])
            if suspect and node.suspect is suspect:
                suspects.append(suspect)
            stack.append(node)
            opened[tag] += 1
            nodes.append(node)
    parts.append(html[at:])
    end_block()
    close(0)
    for node in reversed(nodes):
        if node.parent and not node.bad:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.plain += node.plain
    return (blocks, wanted, nodes), suspects


def _score(n: Node) -> float:
    return (n.chars - LINKS * n.linked) * BONUS.get(n.tag, 1.0)


def _plain(n: Node, nodes: list[Node]) -> int:
    """Characters that a pick must hold: those of plain blocks, or on a page without one of all blocks."""
    return n.plain if nodes[0].plain else n.chars


def best(nodes: list[Node]) -> Node | None:
    """The article or main with the most unlinked text if no container has more, else the deepest container outside of which nothing but unwanted blocks and links is left."""
    held = [n for n in nodes if (n.tag in CONTAINERS or not n.parent) and n.chars and not n.bad]
    if not held:
        return None
    most = max(held, key=lambda n: (_score(n), n.depth))
    if most.tag in BONUS and _score(most) > 0:
        return most
    return max((n for n in held if _plain(n, nodes) == _plain(nodes[0], nodes)), key=lambda n: n.depth)


def _holds(outer: Node, inner: Node) -> bool:
    while inner.depth > outer.depth:
        inner = inner.parent
    return inner is outer


def extract(html: str, paths: list[str]) -> str:
    """The text of the containers that the first of ``paths`` found in the page leads to, else of the page's own best.

    Of several articles or mains on one path that with most text is taken, with equal text the first; of other
    containers all with more than links. If the page's own best lies around them and is on one of ``paths`` too, it is
    taken. A page without any container gives all blocks that are not unwanted.
    """
    blocks, wanted, nodes = parse(html)
    own, picked = best(nodes), []
    for p in paths:
        key = _key(p)
        if found := [n for n in nodes if n.key == key and n.chars and not n.bad]:
            picked = [max(found, key=_score)] if found[0].tag in BONUS else [n for n in found if _plain(n, nodes)] or found
            break
    if own and (not picked or (picked[0].tag not in BONUS and own.path in paths and all(_holds(own, n) for n in picked))):
        picked = [own]
    inside = {i for n in picked for i in range(n.first, n.stop)}
    return "\n".join(b for i, (b, w) in enumerate(zip(blocks, wanted, strict=True)) if w and i in inside)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for x in batch.column("html"):
            found = best(parse(x.as_py() or "")[2])
            paths.append(found.path if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "", p.as_py() or []) for h, p in zip(batch.column("html"), batch.column("__paths"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(texts, pa.string())], names=[*keep, "text"])

    return run


def host_paths(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """host and paths: those that at least ``share`` of the host's pages vote for, most votes first (five at most by that share).

    Counts are summed on the map side, so a host with a third of all pages is one row a task.
    """
    host = host_and_path(F.col("url"))[0]
    votes = pages.select(host.alias("host"), "html").filter("host <> ''").mapInArrow(_votes, "host string, path string")
    votes = votes.filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    won = votes.join(total, "host").filter(F.col("n") >= share * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return won.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"))


def extract_pages(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` without html but with text and n_chars (code points): the main text of each page.

    First every page's containers are scored by unlinked text and the page votes for the path of the best (an article
    or main, else what holds all text besides links): tags with their classes, digits cut off. Votes are counted per host; then each page is extracted again at the host's winning
    paths, the first that it holds, or at its own best container if it holds none. Menus, headers, footers,
    sidebars, notices, adverts, forms, comments, scripts and styles inside it are left out; blocks are joined by ``\\n``.
    A form that holds most of the page's text, as prose, is a container like others. A class whose first part only is
    such a word ("share-price") leaves out, within an article or on a paragraph, what is short or mostly linked.

    Null html counts as empty; its text, and that of a page without text, is empty. Pages without a host have no
    consensus and use their own best. Repeated rows stay. Columns called text or n_chars are replaced.
    """
    lean_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    keep = [c for c in pages.columns if c != "html"]
    paths = written(host_paths(pages).select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "host-paths")
    pages = pages.withColumn("__h", host_and_path(F.col("url"))[0])
    if paths.count() <= broadcast_hosts:
        found = pages.join(F.broadcast(paths), F.col("__h") == F.col("__host"), "left")
    else:
        paths = paths.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("__p", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
        found = pages.join(paths, (F.col("__h") == F.col("__host")) & (F.col("__p") == F.col("__part")), "left")
    found = found.select(*keep, "html", "__paths")
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return found.mapInArrow(_texts(keep), f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
