"""Landed CSV files: each read by its own header, untyped, missing tokens as NULL, rows stamped in order of arrival, rows of another width set apart; and the export."""

from __future__ import annotations

import csv
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundline.functions.coercion import nullified
from moundline.sources.store import ORDINAL

#: Columns that a source has to provide.
SOURCE_COLUMNS = "pitch_type release_speed balls strikes stand p_throws game_pk at_bat_number pitch_number description estimated_woba_using_speedangle".split()  # noqa: SIM905


#: The column of values under headers that were not asked for, and what the reader calls a row it can't read.
RESCUED, CORRUPT = "_rescued", "_corrupt"


class BadSource(Exception):
    """A source that cannot be reached or gives something that is no pitch file."""


def is_html(text: str) -> bool:
    """Error pages come with status 200."""
    return text.lstrip().startswith("<")


def numeric_counts(df: DataFrame) -> DataFrame:
    """balls and strikes as doubles: counts are judged before anything is rounded."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in ("balls", "strikes") if c in df.columns})


def header_names(line: str) -> list[str]:
    """The columns of a header line; one without a name is called after its place, and names that come again (in any case) are numbered."""
    seen: Counter[str] = Counter()
    names = []
    for i, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]), [])):
        name = name.strip() or f"unnamed_{i}"
        again = seen[name.lower()]
        seen[name.lower()] += 1
        names.append(f"{name}.{again}" if again else name)
    return names


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file, the place in it where their split starts, and an order within the split."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file and header: the first line of each file that is not blank. Two more reads of the text; nothing but a line a file moves."""
    lines = _lines(spark, path).filter((F.col("block") == 0) & (F.trim("value") != ""))
    # Numbers are aggregated by hashing, in a row a file; aggregates of text would sort all lines of a task's files.
    first = lines.groupBy("file").agg(F.min("id").alias("id"))
    return lines.join(F.broadcast(first), ["file", "id"]).select("file", F.col("value").alias("header"))


def _path(file: str) -> str:
    """A listed file as a path that the reader takes literally."""
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in unquote(file))


@dataclass(frozen=True)
class Landing:
    """rows: what could be read; rejected: file, line (from 1, the header counts), columns that the header has, and the record of each row of another width."""

    rows: DataFrame
    rejected: DataFrame


def land(spark: SparkSession, path: str, columns: list[str] | None = None, rescue: bool = False) -> Landing:
    """CSV files (plain or .gz; a file, folder or pattern), each by its own header: all columns as strings with missing tokens as NULL, and _ordinal.

    Files are grouped by their header lines (the driver gets these and the names of the files), and each group is
    read under its names, so columns may come in any order; what a file lacks is NULL. With ``columns`` only those are
    returned, in that order; with ``rescue`` too, the values of the others are in the map _rescued (without NULLs). A row that
    has fewer or more fields than its header is not read at all but rejected, with its file and line.

    The ordinal is file by file, then line by line within one, stamped at the scan, before anything moves rows. A .gz
    is read by one task, so spread the rows afterwards if it is large. Empty files have no rows. Quoted line breaks are not read.
    """
    groups = headers(spark, path).groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    if not groups:
        fields = [*[T.StructField(c, T.StringType()) for c in columns or []], *[T.StructField(RESCUED, T.MapType(T.StringType(), T.StringType()))] * rescue, T.StructField(ORDINAL, _ORDINAL)]
        return Landing(spark.createDataFrame([], T.StructType(fields)), spark.createDataFrame([], _REJECTED))
    found = [_group(spark, header_names(g.header), sorted(map(_path, g.files)), columns, rescue) for g in sorted(groups, key=lambda g: g.header)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r for r, _ in found])
    first = [c for c in rows.columns if c not in (ORDINAL, RESCUED)] if columns is None else columns
    return Landing(rows.select(*[F.col(f"`{c}`") for c in first], *[c for c in (RESCUED, ORDINAL) if c in rows.columns]), reduce(DataFrame.unionByName, [r for _, r in found]))


_ORDINAL = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])
_REJECTED = "file string, line long, columns int, record string"


def _group(spark: SparkSession, names: list[str], files: list[str], columns: list[str] | None, rescue: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and rejected rows of files of one header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    # All columns are parsed, as a row's width shows only then.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    df = spark.read.schema(schema).options(header=True, columnPruning=False, **options).csv(files)
    stamp = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # Spark refuses plans that read nothing but the record it couldn't read, as those that only count do, so another column is in the condition.
    looked_at = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    df = df.withColumn(ORDINAL, stamp).filter(F.col(CORRUPT).isNull() & looked_at).drop(CORRUPT)
    df = df.withColumns({c: nullified(c, T.StringType()) for c in names})
    if columns is not None:
        own = {c.lower(): c for c in names}
        picked = [(F.col(f"`{own[c.lower()]}`") if c.lower() in own else F.lit(None).cast("string")).alias(c) for c in columns]
        others = [c for c in names if c.lower() not in {c.lower() for c in columns}]
        pairs = F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))]) if others else F.create_map().cast("map<string,string>")
        df = df.select(*picked, *[F.map_filter(pairs, lambda _, v: v.isNotNull()).alias(RESCUED)] * rescue, ORDINAL)

    lines = _lines(spark, files)
    parsed = F.from_csv("value", F.lit(", ".join(f"`{c}` STRING" for c in [*names, CORRUPT])), options)
    bad = lines.filter(F.trim("value") != "").filter(parsed[CORRUPT].isNotNull())
    # Lines by split, so a file of any size is counted without moving it: a row a split.
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = bad.join(F.broadcast(splits.withColumn("before", before).drop("n")), ["file", "block"])
    return df, numbered.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.lit(len(names)).alias("columns"), F.col("value").alias("record"))


def read_landing(spark: SparkSession, path: str, columns: list[str] | None = None, rescue: bool = False) -> DataFrame:
    """The rows of land()."""
    return land(spark, path, columns, rescue).rows


def quarantine(landing: Landing, path: str) -> int:
    """Appends the rejected rows to the Parquet table ``path``; how many there were."""
    seen = Observation()
    landing.rejected.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def check_columns(df: DataFrame, wanted: list[str] = SOURCE_COLUMNS) -> None:
    lost = [c for c in wanted if c not in df.columns]
    if lost:
        raise BadSource(f"columns missing: {lost}")


def header_report(spark: SparkSession, path: str, wanted: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """file, html (an error page), and missing: those of the ``wanted`` columns that its header lacks; files that are fine are left out."""
    found = headers(spark, path)
    by_header = [(r.header, is_html(r.header), [c for c in wanted if c not in header_names(r.header)]) for r in found.select("header").distinct().collect()]
    faults = spark.createDataFrame(by_header, "header string, html boolean, missing array<string>").filter("html or size(missing) > 0")
    return found.join(faults, "header").select("file", "html", F.when(~F.col("html"), F.col("missing")).alias("missing"))


def check_source(spark: SparkSession, path: str, wanted: list[str] = SOURCE_COLUMNS) -> None:
    """An error that names five files at most that are no CSV or lack a wanted column."""
    bad = header_report(spark, path, wanted).orderBy("file").limit(5).collect()
    if bad:
        raise BadSource("; ".join(f"{r.file} is HTML" if r.html else f"{r.file}: columns missing: {r.missing}" for r in bad))


def check_not_html(spark: SparkSession, path: str) -> None:
    """Looks at the first line of each file only."""
    check_source(spark, path, [])


def read_landings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of several sources, that need not have the same columns: what one lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_landing(spark, p) for p in paths])


def export_csv(df: DataFrame, path: str) -> None:
    """One gzip CSV with a header: the file ``path`` if that ends with .csv.gz, else one in the folder ``path``."""
    out = df.drop(ORDINAL).coalesce(1).write.mode("overwrite").option("header", True).option("compression", "gzip")
    if not path.endswith(".csv.gz"):
        out.csv(path)
        return
    spark, folder = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    out.csv(folder)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(Path(folder)) if f.getPath().getName().startswith("part-"))
    fs.delete(Path(path), False)
    fs.rename(part, Path(path))
    fs.delete(Path(folder), True)
