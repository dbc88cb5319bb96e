"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.llm.bloom import BROADCAST_BLOCKS, WORDS, _bit, _block, bloom_table
from moundline.llm.common import table, written

#: Fixed values of the query: rule (host and path), verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` (A-Z lower-cased), path up to ``?`` or ``#``; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit((1 << 31) - 1))).otherwise(F.lit(""))
    plain = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(plain, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(plain, r"(?s)^[^/]*(.*)$", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", bits_per_key: int = 24) -> DataFrame:
    """``pages`` (a url column, any others) with host, path, rule and verdict.

    ``rules``: rule (canonical host followed by a path that starts with ``/``) and verdict. A rule fits its host and
    all subdomains where the url's path starts with the rule's; the longest wins (of equally long ones the longer host,
    of one listed with both verdicts ``block``). Other urls get ``default``.

    Hosts first: the suffixes of each distinct host, of at most as many labels as a rule's host has, are joined with the
    hosts that rules are listed for. A url's candidate keys are those of its hosts with path prefixes of the lengths
    listed for them, however many others the rules have. Keys whose bits are all set in the blocked Bloom filter go on
    to the exact hash join with the rules, which removes false positives. Null urls and urls without ``://`` have empty
    host and path, fit no rule and take part in no join; repeated urls share one verdict; columns of ``pages`` called
    host, path, rule or verdict are replaced.
    """
    rules = rules.select("rule", "verdict").filter(F.instr("rule", "/") > 0).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"rhost": F.substring_index("rule", "/", 1)}).withColumn("rpath", F.expr("substring(rule, length(rhost) + 1)"))
    rules = written(rules, "url-rules")
    count, most = rules.agg(F.count("*"), F.max(F.size(F.split("rhost", r"\.")))).first()
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    judged = pages.withColumns({"host": host, "path": path})
    if not count:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = 1 << max(0, (count * bits_per_key // (64 * WORDS)).bit_length())
    bloom = bloom_table(rules, "rule", blocks)
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom

    # Sides that were grouped are written, so that each join stands between two exchanges and Spark splits a hot host.
    listed = written(rules.groupBy("rhost").agg(F.collect_set(F.length("rpath")).alias("lengths")), "url-hosts")
    urls = written(judged.select("host", "path").filter("host <> ''").distinct(), "urls")
    labels = F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(most)))
    suffixes = urls.select("host").distinct().select("host", F.explode(F.transform(labels, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))).alias("rhost"))
    near = written(suffixes.join(listed, "rhost"), "url-listed")
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    keys = urls.join(near, "host").select("host", "path", F.explode(F.transform(fits, lambda n: F.concat("rhost", F.call_function("substring", F.col("path"), F.lit(1), n)))).alias("key"))
    possible = keys.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block")
    for j in range(WORDS):
        possible = possible.filter(F.call_function("shiftright", F.col(f"w{j}"), _bit(F.col("key"), j)).bitwiseAND(F.lit(1)) == 1)
    hits = possible.select("host", "path", "key").join(rules, F.col("key") == F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.length("rhost"), "rule", "verdict")).alias("best"))
    best = written(best.select("host", "path", "best.rule", "best.verdict"), "url-verdicts")
    found = judged.filter("host <> ''").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    bare = judged.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return found.select(*bare.columns).unionByName(bare)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1, 's') AS plain FROM u),
h AS (
  SELECT page_id, translate(regexp_extract(plain, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(plain, '^[^/]*(.*)$', 1, 's') AS path
  FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
