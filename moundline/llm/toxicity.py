"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moundline.llm.common import lean_batches, table, text_hash, written
from moundline.llm.hashing import BLOCK, hashes, mixed, pieces, runs

#: Rows of the embedding table, its width, filters of each width of window, and the widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 16, (1, 2, 3)
#: Parts of a document, of equally many words, whose largest responses are pooled; sorted, they tell one chance hit from several.
PARTS = 3
#: Twice so many documents of either label are looked at, the lowest hashes of their ids; two of three train.
SAMPLE = 2_000
#: Words of either label that training may take: documents come in the order of their hashes until those before them hold
#: so many. So at most twice this, of 6 bytes a word, and two documents more come to the driver (24 MB and these).
WORD_BUDGET = 2_000_000
#: Passes over the training documents, or as many as make so many steps; documents of a step; rate; seed.
EPOCHS, STEPS, BATCH, RATE, SEED = 10, 1_500, 16, 0.02, 7
#: A bucket's first embedding starts as its shrunk log odds, as if it had been in PRIOR more documents of the usual share of labels, times ODDS;
#: buckets of few documents learn more slowly (RARE); words of a training document are left out of a pass with the probability DROP.
PRIOR, ODDS, RARE, DROP = 10.0, 0.3, 10.0, 0.3
#: Words that go through the network together, however long a document is.
WORDS = 1 << 17
#: A language needs this many documents of either label for a threshold of its own.
LEAST = 20

#: Frequent function words, by which the language of a text is guessed. The rest is "other".
FUNCTION_WORDS = {
    "de": "der die das und den von zu mit ist des sich auf für nicht ein eine dem im auch als",
    "en": "the of and to in is that it was for with as on be by this are from or which",
    "es": "el los las del una que por con para como más pero sus al lo su se es un no",
    "fr": "le les des et une du dans pour est au sur avec pas ce qui ne par sont plus il",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a block of UTF-8 from pieces() and where they start: (words, 3) for the whole word and its first 4 and 5 bytes.

    A word is a run of letters and digits; ASCII and Latin-1 letters are folded to lower case.
    """
    inside = _WORD[data]
    low = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    low[upper] += 0x20
    start, end = runs(inside)
    made = np.empty((len(start), 3), np.uint64)
    for c, stop in enumerate((end, np.minimum(start + 4, end), np.minimum(start + 5, end))):
        made[:, c] = hashes(low, start, stop, c)
    return made, start


def features(text: np.ndarray) -> np.ndarray:
    found = [words(x)[0] for x in pieces(text, _WORD)]
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.uint16)  # BUCKETS is 2**16


class Model:
    """Embeddings E, filters W[k] (k, DIM, FILTERS), biases c[k], output v and b, and the logit that is the threshold of each language."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.W = {k: rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.c = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = rng.normal(0, 0.3, PARTS * len(WIDTHS) * FILTERS).astype(np.float32)
        self.b = 0.0
        self.at: dict[str, float] = {}
        # Words that several of the languages have tell nothing.
        langs_of = Counter(w for ws in FUNCTION_WORDS.values() for w in ws.split())
        codes = [(w, lang) for lang, ws in FUNCTION_WORDS.items() for w in ws.split() if langs_of[w] == 1]
        known = np.array([words(np.frombuffer(w.encode(), np.uint8))[0][0, 0] for w, _ in codes])
        order = np.argsort(known)
        self.known, self.lang = known[order], np.array([list(FUNCTION_WORDS).index(x) for _, x in codes])[order]

    def maps(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Filter responses of each window; a window that ends beyond the last word is left out."""
        x = self.E[ids].sum(1)
        return {k: sum(x[j : len(x) - k + 1 + j] @ self.W[k][j] for j in range(k)) + self.c[k] for k in WIDTHS if len(x) >= k}

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.v + self.b

    def pool(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Max pooling over documents whose words are ids[bounds[i]:bounds[i + 1]], in blocks of WORDS words.

        Each filter's largest response among the windows that start in each of PARTS parts, the largest first; 0 without a window.
        """
        size = np.diff(bounds)
        edges = bounds[:-1, None] + size[:, None] * np.arange(PARTS + 1) // PARTS
        starts, ends, limit = edges[:, :-1].ravel(), edges[:, 1:].ravel(), np.repeat(bounds[1:], PARTS)
        out = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        for lo in range(0, len(ids), WORDS):
            hi = min(len(ids), lo + WORDS)
            parts = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left"))
            maps = self.maps(ids[lo : min(len(ids), hi + max(WIDTHS) - 1)])
            for n, k in enumerate(WIDTHS):
                if k not in maps:
                    continue
                begin = np.maximum(starts[parts], lo) - lo
                stop = np.minimum(np.minimum(ends[parts], limit[parts] - k + 1), hi) - lo
                some = np.flatnonzero(stop > begin)
                if not len(some):
                    continue
                y = maps[k]
                pairs = np.stack([begin[some], stop[some]], 1).ravel()
                padded = y if pairs[-1] < len(y) else np.concatenate([y, y[-1:]])
                best = np.maximum.reduceat(padded, pairs, axis=0)[::2]
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                out[parts[some], cols] = np.maximum(out[parts[some], cols], best)
        return -np.sort(-out.reshape(len(size), PARTS, -1), axis=1).reshape(len(size), -1)

    def languages(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """For each of n documents the language with most function words, as an index; one past the last without any."""
        k = len(FUNCTION_WORDS)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[at] == hashes
        count = np.bincount(doc[hit] * k + self.lang[at[hit]], minlength=n * k).reshape(n, k)
        return np.where(count.max(1, initial=0) > 0, count.argmax(1), k) if n else np.zeros(0, int)

    def thresholds(self) -> np.ndarray:
        return np.array([self.at.get(x, self.at.get("", 0.0)) for x in [*FUNCTION_WORDS, "other"]])


def gradients(model: Model, texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> tuple:
    """Of the weighted log loss, the mean over ``texts`` and a text without words that is not toxic (its logit is the bias), by W, c, v, b and rows of E.

    The gradient of a filter flows to its largest window in each part only.
    """
    gW, gc = {k: np.zeros_like(model.W[k]) for k in WIDTHS}, {k: np.zeros_like(model.c[k]) for k in WIDTHS}
    gv, gb, rows, grads = np.zeros_like(model.v), 1 / (1 + np.exp(-model.b)) / len(texts), [], []
    every = np.arange(FILTERS)
    for ids, y, w in zip(texts, toxic, weight, strict=True):
        maps, edges = model.maps(ids), len(ids) * np.arange(PARTS + 1) // PARTS
        pooled, where = np.zeros((PARTS, len(WIDTHS), FILTERS), np.float32), {}
        for n, k in enumerate(WIDTHS):
            if k not in maps or not len(maps[k]):
                continue
            value, place = np.zeros((PARTS, FILTERS), np.float32), np.zeros((PARTS, FILTERS), int)
            for p in range(PARTS):
                part = maps[k][edges[p] : edges[p + 1]]
                if len(part):
                    at = part.argmax(0)
                    value[p], place[p] = np.maximum(part[at, every], 0), edges[p] + at
            order = np.argsort(-value, axis=0, kind="stable")
            pooled[:, n], where[k] = np.take_along_axis(value, order, 0), np.take_along_axis(place, order, 0)
        on = pooled.reshape(-1)
        p = 1 / (1 + np.exp(-np.clip(on @ model.v + model.b, -30, 30)))
        d = np.float32((p - y) * w / len(texts))
        gv += d * on
        gb += d
        back = (d * model.v * (on > 0)).reshape(pooled.shape)
        for n, k in enumerate(WIDTHS):
            if k not in where:
                continue
            g = back[:, n]
            if not g.any():
                continue
            gc[k] += g.sum(0)
            for j in range(k):
                picked = ids[where[k] + j]
                gW[k][j] += (model.E[picked].sum(2) * g[:, :, None]).sum(0).T
                rows.append(picked.ravel())
                grads.append(np.repeat((g[:, :, None] * model.W[k][j].T).reshape(-1, DIM), 3, axis=0))
    return gW, gc, gv, gb, rows, grads


def train(texts: list[np.ndarray], toxic: np.ndarray, seed: int = SEED) -> Model:
    """Stochastic gradient descent (Adagrad) on log loss.

    Most words of a few hundred documents are in one of them only, and a network may learn these by heart. So embeddings
    start from what all documents together say of a bucket, those of rare ones hardly move, and words are dropped.
    """
    model, rng = Model(seed), np.random.default_rng(seed)
    held = np.zeros((2, BUCKETS))
    for ids, y in zip(texts, toxic, strict=True):
        held[int(y > 0), np.unique(ids)] += 1
    docs_of = np.array([len(toxic) - toxic.sum(), toxic.sum()])
    odds = (held + PRIOR * docs_of[:, None] / len(toxic)) / docs_of[:, None]
    model.E[:, 0] = ODDS * np.log(odds[1] / odds[0])
    pace = (held.sum(0) / (held.sum(0) + RARE)).astype(np.float32)[:, None]
    sums = {"E": np.full((BUCKETS, 1), 0.1, np.float32), "v": np.full_like(model.v, 0.1), "b": 0.1}
    sums |= {("W", k): np.full_like(model.W[k], 0.1) for k in WIDTHS} | {("c", k): np.full(FILTERS, 0.1, np.float32) for k in WIDTHS}
    share = np.clip(toxic.mean(), 0.05, 0.95)
    weight = np.where(toxic > 0, 0.5 / share, 0.5 / (1 - share))
    epochs = max(EPOCHS, STEPS * BATCH // len(texts))
    for epoch in range(epochs):
        rate = RATE * (1 - 0.7 * epoch / epochs)
        for lot in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            some = [texts[i][rng.random(len(texts[i])) >= DROP] for i in lot]
            gW, gc, gv, gb, rows, grads = gradients(model, some, toxic[lot], weight[lot])
            for k in WIDTHS:
                for name, g, at in (("W", gW[k] + 1e-4 * model.W[k], model.W), ("c", gc[k], model.c)):
                    sums[name, k] += g * g
                    at[k] -= rate * g / np.sqrt(sums[name, k])
            sums["v"] += gv * gv
            model.v -= rate * gv / np.sqrt(sums["v"])
            sums["b"] += gb * gb
            model.b -= float(rate * gb / np.sqrt(sums["b"]))
            if rows:
                which, back_to = np.unique(np.concatenate(rows), return_inverse=True)
                g = np.zeros((len(which), DIM), np.float32)
                np.add.at(g, back_to, np.concatenate(grads))
                sums["E"][which] += (g * g).sum(1, keepdims=True)
                model.E[which] -= 3 * rate * pace[which] * g / np.sqrt(sums["E"][which])
    return model


def _best_threshold(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the thresholds with the best F0.5, which weighs precision higher: clean texts should stay."""
    order = np.argsort(-logits)
    hits = np.cumsum(toxic[order])
    best_of = 1.25 * hits / (np.arange(1, len(order) + 1) + 0.25 * toxic.sum())
    value = logits[order]
    gap = value - np.append(value[1:], value[-1] - 1.0)
    best_of[gap <= 0] = 0
    best = np.flatnonzero(best_of >= best_of.max() - 1e-9)
    at = best[gap[best].argmax()]
    return float(value[at] - gap[at] / 2)


def calibrate(model: Model, logits: np.ndarray, toxic: np.ndarray, lang: np.ndarray) -> None:
    """Sets the threshold of each guessed language, above the logit of a text without words; one with fewer than LEAST documents of either label takes that of all."""
    if 0 < toxic.sum() < len(toxic):
        model.at = {"": _best_threshold(logits, toxic)}
        for i, name in enumerate(FUNCTION_WORDS):
            y = toxic[lang == i]
            if min(y.sum(), len(y) - y.sum()) >= LEAST:
                model.at[name] = _best_threshold(logits[lang == i], y)
        model.at = {name: max(at, model.b + 0.1) for name, at in model.at.items()}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text")):
            ids = features(np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer().size else np.zeros(0, np.uint8))
            one = [batch.column(c).slice(i, 1) for c in ("doc_id", "toxic")]
            yield pa.RecordBatch.from_arrays([*one, pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["doc_id", "toxic", "n", "ids"])


def _calibrated(model):
    """A task that gives the logit of each whole text and the language that it is taken for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            logit, guess = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i in range(batch.num_rows):
                at, lang = score_block(m, batch.column("text"), [i])
                logit[i], guess[i] = at[0], lang[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(logit), pa.array(guess)], names=["doc_id", "toxic", "logit", "guess"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, word_budget: int = WORD_BUDGET) -> Model:
    """Trains and calibrates on at most ``2 * sample`` labelled documents of either label.

    Only rows whose crc32 of the id is no multiple of 5 are looked at. An id with both labels is toxic; of several
    texts of one id that with the smallest hash counts. Documents come in the order of their ids' hashes, so reruns
    agree: two of three train, as whole texts, until those before them of their label hold ``word_budget`` words; the
    third, also whole, sets the thresholds on the executors. What comes to the driver is bounded by the parameters:
    word hashes of the former, a logit each of the latter. Without labels of both kinds, or words of both, the model is
    untrained and scores everything below one half.
    """
    lean_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    pick = lambda y: known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(2 * sample)
    picked = pick(0).unionByName(pick(1))
    # Reduced on the map side, so an id that very many rows have gives one text a task.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", text_hash()).alias("text"))
    texts = written(texts.withColumn("trains", F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2), "toxicity-texts")
    before = Window.partitionBy("toxic").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    found = written(texts.filter("trains").mapInArrow(_features, "doc_id long, toxic int, n long, ids binary"), "toxicity-words")
    sizes = found.select("doc_id", "toxic", "n").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = found.join(sizes.filter(F.col("before") < word_budget).select("doc_id"), "doc_id").select("doc_id", "toxic", "ids").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in rows.column_names), strict=True), key=lambda r: (_sort_hash(r[0]), r[0]))
    model = Model()
    toxic = np.array([r[1] for r in rows], np.float32)
    if not len(rows) or toxic.min() == toxic.max():
        model.v[:] = 0
        model.b = -1.0
        return model
    model = train([np.frombuffer(r[2], np.uint16).reshape(-1, 3).astype(np.int32) for r in rows], toxic)
    spark = docs.sparkSession
    rest = texts.filter("not trains").mapInArrow(_calibrated(spark.sparkContext.broadcast(model)), "doc_id long, toxic int, logit double, guess int").toArrow()
    if rest.num_rows:
        calibrate(model, *(rest.column(c).to_numpy() for c in ("logit", "toxic", "guess")))
    return model


def _sort_hash(doc_id: int) -> int:
    return int(mixed(np.array([doc_id], np.int64).view(np.uint64))[0])


def _scored(model, keep: list[str]):
    """A task that adds the score of each text; blocks of texts go through the network together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        at = m.thresholds()
        for batch in batches:
            texts, scores = batch.column("text"), np.zeros(batch.num_rows)
            lot, size = [], 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > BLOCK:
                    if lot:
                        logit, lang = score_block(m, texts, lot)
                        scores[lot] = 1 / (1 + np.exp(-np.clip(logit - at[lang], -30, 30)))
                    lot, size = [], 0
                if i < batch.num_rows:
                    lot.append(i)
                    size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(scores)], names=[*keep, "score"])

    return run


def score_block(m: Model, texts, lot: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and guessed language of the texts numbered ``lot``."""
    ids, langs, counts = [], [], []
    for i in lot:
        text = np.frombuffer(texts[i].as_buffer(), np.uint8) if texts[i].is_valid and len(texts[i].as_buffer()) else np.zeros(0, np.uint8)
        found = [words(x)[0] for x in pieces(text, _WORD)]
        found = found[0] if len(found) == 1 else np.concatenate(found)
        ids.append((found % np.uint64(BUCKETS)).astype(np.int32))
        langs.append(found[:, 0])
        counts.append(len(found))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    lang = m.languages(np.concatenate(langs), np.repeat(np.arange(len(lot)), counts), len(lot))
    return m.logit(m.pool(np.concatenate(ids), bounds)), lang


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted (1 from 0.5 on). The whole text counts; a document may be of any length.

    The score is the logistic of the logit less the threshold of the language that the text's own words suggest, so 0.5
    is each language's threshold. Null and empty texts have no windows and get the score of the bias. Id, language
    and source columns are never read. Columns called score or predicted are replaced. The model (3 MB) is broadcast.
    """
    lean_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), docs.columns), f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
