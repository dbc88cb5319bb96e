"""Baselines by difference, profiles of sketches, and metrics as SQL functions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from moundline.operators import metrics, profiles
from moundline.plans import catalogue, sql
from moundline.sources.baselines import LeagueBaselines
from moundline.sources.store import PitchStore
from tests.test_store import pitches


def rows(spark, season, n, seed=0, value=1.0):
    return pitches(spark, *[{"game_pk": 1000 * season + i // 4, "game_year": season, "pitch_number": i % 4 + 1, "pitcher": i % 5, "pitch_type": ["FF", "SL", "CU"][(i + seed) % 3], "balls": i % 4, "strikes": i % 3, "estimated_woba_using_speedangle": None if i % 7 == 0 else value * (i % 8) / 8} for i in range(n)])


def test_league_baselines(spark, tmp_path):
    store = PitchStore(spark, str(tmp_path / "s"), clock=lambda: dt.datetime(2025, 6, 1))
    league = LeagueBaselines(store)
    assert league.sums().count() == 0
    for season in (2021, 2022, 2023):
        store.save_batch(rows(spark, season, 40))
    first = league.refresh()
    assert len(first) == len(store.snapshot()[1]["files"]) and league.refresh() == []
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for i in range(3):  # of one season each time: no file of the others is read again
        store.save_batch(rows(spark, 2022, 10 + 10 * i, seed=i + 1, value=2.0))
        read = league.refresh()
        assert read and all("_season=2022" in f for f in read)
        x = F.col("estimated_woba_using_speedangle")
        whole = store.pitches.groupBy(F.col("game_year").alias("season"), F.expr("balls || '-' || strikes").alias("count"), "pitch_type").agg(F.count("*").alias("n"), F.count(x).alias("valued"), F.sum(x).alias("value"))
        assert key(league.sums()) == key(whole)
    for season in (None, 2022):
        mine = store.pitches if season is None else store.pitches.filter(F.col("game_year") == season)
        assert key(metrics.hittable_pitches(mine, 1, -9.0, league=league.by_type(season))) == key(metrics.hittable_pitches(mine, 1, -9.0))
        assert key(metrics.predictable_counts(mine, 1, 0.0, -9.0, league=league.by_count(season))) == key(metrics.predictable_counts(mine, 1, 0.0, -9.0))


def test_sums_that_are_there_twice(spark, tmp_path, monkeypatch):
    """Two sessions that add the same files, and many pieces put together."""
    from moundline.sources import baselines

    store = PitchStore(spark, str(tmp_path / "s"), clock=lambda: dt.datetime(2025, 6, 1))
    store.save_batch(rows(spark, 2021, 20))
    one, other = LeagueBaselines(store), LeagueBaselines(store)
    other._pieces = lambda: []
    one.refresh(), other.refresh()
    assert len(one._pieces()) == 2 and one.sums().agg(F.sum("n")).first()[0] == 20
    monkeypatch.setattr(baselines, "MANY", 2)
    assert one.sums().agg(F.sum("n")).first()[0] == 20 and len(one._pieces()) == 1


def test_profiles(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 5000).alias("many"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 10).cast("double").alias("some"), F.when(F.col("id") % 4 > 0, "often").otherwise(F.col("id").cast("string")).alias("text"), F.lit(None).cast("int").alias("none"))
    parts = profiles.sketches(df, by=["part"])
    assert parts.count() == 28
    got = {r.column_name: r for r in profiles.profile(profiles.merged(parts)).collect()}
    assert {c: (r.rows, round(r.null_fraction, 9)) for c, r in got.items()} == {"many": (30_000, 0), "some": (30_000, round(1 / 3, 9)), "text": (30_000, 0), "none": (30_000, 1)}
    for column, exact in (("many", 5000), ("some", 10), ("text", 7501), ("none", 0)):
        assert abs(got[column].distinct - exact) <= max(1, profiles.DISTINCT_ERROR * exact)
    for q, share in zip(got["many"].quantiles, (0.05, 0.5, 0.95), strict=True):
        assert abs(q / 5000 - share) <= profiles.RANK_ERROR + 1e-3
    assert got["text"].frequent[0]["item"] == "often" and got["text"].quantiles is None and got["none"].quantiles is None
    again = {r.column_name: r.distinct for r in profiles.profile(profiles.merged(profiles.merged(parts.withColumn("half", F.col("part") % 2), ["half"]))).collect()}
    assert all(abs(again[c] - r.distinct) <= max(1, 2 * profiles.DISTINCT_ERROR * r.distinct) for c, r in got.items())  # in another order of merging


def test_sql_functions(spark):
    df = rows(spark, 2022, 60).drop("_ordinal")
    sql.register(df)
    ask = lambda text: sorted(map(tuple, spark.sql(text, args={"p": 1, "y": 2022}).collect()))
    mine = df.filter("pitcher = 1")
    assert ask("SELECT * FROM pitch_mix_by_count(:p, :y)") == sorted(map(tuple, metrics.pitch_mix_by_count(mine).collect()))
    assert ask("SELECT * FROM pitch_transitions(:p, :y)") == sorted(map(tuple, metrics.transitions(df).filter("pitcher = 1").drop("pitcher").collect()))
    assert ask("SELECT pitch_type, n FROM pitch_arsenal(:p, :y)") == sorted(map(tuple, mine.groupBy("pitch_type").count().collect()))
    assert ask("SELECT * FROM pitch_arsenal(:p, 1900)") == []
    sql.register(df.limit(0))
    assert ask("SELECT * FROM pitch_arsenal(:p, :y)") == []
    with pytest.raises(Exception, match="pitch_arsenal"):
        spark.sql("SELECT * FROM pitch_arsenal(1)").collect()


def test_release(spark):
    """What was written outside of a store, by results that are lazy, goes when it is asked to."""
    from moundline import session

    table = session.saved(spark.range(3), "kept")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 3 and os.path.exists(path)
    other = session.temporary(spark, "folder")
    spark.range(1).write.parquet(other)
    session.release(spark)
    assert not os.path.exists(path) and not os.path.exists(other.removeprefix("file://")) and not session.LEFT


def test_exact_profiles_keep_no_values_of_a_column_in_one_task(spark):
    """An exact mode() is a map of all values of the table in a single row."""
    plan = catalogue.profile_bounds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "mode(" not in plan and "distinct" in plan and "count(distinct" not in plan
