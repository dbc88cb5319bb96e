"""Metrics as table functions of Spark SQL over a pitch table; they stay lazy, and their filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from moundline.schema import FASTBALLS

VIEW = "moundline_pitches"
_OWN = f"FROM {VIEW} p WHERE p.pitcher = {{f}}.player AND p.game_year = {{f}}.year"
_FAST = ", ".join(f"'{c}'" for c in FASTBALLS)
_LABEL = "CAST(CAST(balls AS INT) AS STRING) || '-' || CAST(CAST(strikes AS INT) AS STRING)"

#: Name, result and text of each function; all take a player's id and a year.
FUNCTIONS = {
    "pitch_mix_by_count": ("count STRING, pitches BIGINT, fastball_pct DOUBLE", f"SELECT {_LABEL}, COUNT(*), ROUND(100.0D * SUM(CASE WHEN pitch_type IN ({_FAST}) THEN 1 ELSE 0 END) / COUNT(*), 1) {_OWN} GROUP BY balls, strikes"),
    "pitch_arsenal": ("pitch_type STRING, n BIGINT, usage DOUBLE, mean_speed DOUBLE", f"SELECT pitch_type, COUNT(*), COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE), AVG(release_speed) {_OWN} GROUP BY pitch_type"),
    "pitch_transitions": (
        "previous STRING, next STRING, n BIGINT, value DOUBLE",
        f"SELECT previous, next, COUNT(*), COUNT(*) / CAST(SUM(COUNT(*)) OVER (PARTITION BY previous) AS DOUBLE) FROM"
        f" (SELECT pitcher, lag(pitch_type) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS previous, pitch_type AS next FROM {VIEW} p WHERE p.game_year = {{f}}.year) m"
        " WHERE previous IS NOT NULL AND m.pitcher = {f}.player GROUP BY previous, next",
    ),
}


def register(pitches: DataFrame) -> None:
    """Makes the functions known to the session, over ``pitches``: ``SELECT * FROM pitch_transitions(:player, :year)``.

    Registering again replaces the table.
    """
    spark = pitches.sparkSession
    pitches.createOrReplaceTempView(VIEW)
    for name, (columns, text) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(player BIGINT, year INT) RETURNS TABLE({columns}) RETURN {text.format(f=name)}")
