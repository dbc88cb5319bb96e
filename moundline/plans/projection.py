"""A pitch table out of the driver's lineitem and supplier, in integers that any engine evaluates alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What l_partkey mod 16 stands for; others are FF.
CODES = {0: "FT", 1: "FA", 2: "CS", 3: "KC", 4: "SV", 5: "FO", 6: "PO", 7: "UN", 8: None, 9: "", 10: "ST", 11: "ZZ", 12: "CH", 13: "SL"}
#: Order of arrival, for keep-last.
ORDINAL = ["l_shipdate", "l_extendedprice", "pitcher", "batter", "l_discount", "l_tax"]

_TYPES = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in CODES.items())

#: The projection; {day}, {year} and {exact} are the only parts that the engines spell differently.
_COLUMNS = f"""
    l_orderkey AS game_pk, {{day}} AS game_date,
    CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN 'S' WHEN 1 THEN NULL WHEN 2 THEN 'W' ELSE 'R' END AS game_type,
    {{year}} AS game_year, CAST(l_partkey % 40 AS INT) AS at_bat_number, CAST(l_linenumber AS INT) AS pitch_number,
    CAST(1 + (l_partkey % 40) / 5 AS INT) AS inning,
    l_suppkey AS pitcher, l_partkey AS batter, CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    CASE WHEN l_partkey % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
    CASE CAST(l_partkey % 16 AS INT) {_TYPES} ELSE 'FF' END AS pitch_type,
    CASE CAST(l_orderkey % 9 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'pitchout' WHEN 2 THEN 'intent_ball' ELSE 'ball' END AS description,
    CAST(CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS balls,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS DOUBLE) END AS strikes,
    50 + l_quantity AS release_speed, CAST(1800 + l_partkey % 900 AS DOUBLE) AS release_spin_rate,
    (l_partkey % 33 - 16) / {{exact}} AS pfx_x, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE (l_partkey % 25 - 4) / {{exact}} END AS pfx_z, CAST(1 + l_partkey % 14 AS INT) AS zone,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE (l_partkey % 17) / {{exact}} END AS estimated_woba_using_speedangle,
    l_shipdate, l_extendedprice, l_discount, l_tax"""

#: A fuller set of outcomes for the metrics on swings and strikes.
OUTCOMES = "CASE CAST(batter % 6 AS INT) WHEN 0 THEN 'swinging_strike' WHEN 1 THEN 'called_strike' WHEN 2 THEN 'foul' WHEN 3 THEN 'hit_into_play' ELSE 'ball' END"

SPARK_SQL = _COLUMNS.format(day="CAST(l_shipdate AS DATE)", year="YEAR(l_shipdate)", exact="8.0D").replace("(l_partkey % 40) / 5", "(l_partkey % 40) DIV 5")
DUCKDB_SQL = _COLUMNS.format(day="CAST(l_shipdate AS DATE)", year="CAST(YEAR(l_shipdate) AS INTEGER)", exact="8.0::DOUBLE").replace("(l_partkey % 40) / 5", "(l_partkey % 40) // 5")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {SPARK_SQL} FROM {{lineitem}}", lineitem=table(spark, sf_dir, "lineitem"))


def with_outcomes(df: DataFrame) -> DataFrame:
    return df.withColumn("description", F.expr(OUTCOMES))
