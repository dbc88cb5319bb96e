"""From raw documents to tokens: five stages over the whole table, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.bpe import encode
from moundline.llm.common import table, text_hash, written
from moundline.llm.jaccard import jaccard_groups
from moundline.llm.lines import line_dedup
from moundline.llm.mixing import mix
from moundline.llm.toxicity import fit, score


def _apart(docs: DataFrame, reads: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose columns besides ``reads`` have names that it cannot clash with; the columns of ``docs`` again."""
    names = {c: c if c in reads else f"__column{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return done.select(*[F.col(n).alias(c) for c, n in names.items()])


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score from 0.5 on) go; null and empty texts are scored like others."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return _apart(docs, ["text"], lambda d: score(d, model).filter("predicted = 0"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out of the texts, and n_chars counted again; no document goes, even if nothing is left of it."""
    return _counted(_apart(docs, ["doc_id", "text"], line_dedup), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id (of rows that repeat it and its text, the one of smallest row hash); documents without words are no one's copies and stay.

    Texts come from line dedup, so a near copy is judged by what that left of it.
    """

    def work(d: DataFrame) -> DataFrame:
        kept = jaccard_groups(d).filter("kept").select(F.col("doc_id").alias("__id"), F.col("h").alias("__kept")).distinct()
        worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        first = d.filter(worded).withColumn("__h", text_hash()).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kept")), "left_semi")
        # Of rows with one id and text that with the smallest hash of the other columns; if that is the same too, so are the rows.
        others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in d.columns if c not in ("doc_id", "text")]))
        one = first.groupBy("doc_id", "__h").agg(F.min_by(F.struct(*d.columns), F.xxhash64(others)).alias("row")).select("row.*")
        return one.unionByName(d.filter(~worded))

    return _apart(docs, ["doc_id", "text"], work)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return _apart(docs, ["doc_id", "text", "source"], lambda d: mix(d).filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and digests of the ids and of the bytes that they decode to, a row for each one taken."""
    import public_tokenizers as p

    coded = encode(docs.select("doc_id", "source", "text"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("mixing", mixture), ("byte_bpe", tokens)]

#: The classifier and the merges are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage{i}-{name}") if i + 1 < len(STAGES) else docs
    return docs
