"""The remote source as a table, over a fake transport."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from moundline.schema import FIELDS
from moundline.sources.datasource import PitchReader, register


@pytest.fixture
def source(spark):
    register(spark)
    return lambda **options: spark.read.format("moundline").options(transport="tests.fake_remote:transport", tries=2, gap=0, **options).load()


def test_filters_become_requests(source, spark, tmp_path, capsys):
    df = source()
    assert df.columns == FIELDS
    one = df.filter("pitcher = 7 and game_year in (2024, 2025) and pitch_number > '0'").select("game_pk", "pitch_number", "pitcher", "strikes")
    assert sorted(tuple(r) for r in one.collect()) == [(f"{y}{i}", str(i), 7, None) for y in (2024, 2025) for i in (1, 2)]
    assert one.rdd.getNumPartitions() == 1
    one.explain("formatted")
    plan = capsys.readouterr().out
    left = next(x for x in plan.splitlines() if x.startswith("Condition"))
    assert "pitch_number" in left and " IN " not in left and "= 7" not in left  # what is left to Spark
    assert df.filter("batter = 91 and game_year = 2025").count() == 1  # of the three batters that the fake one answers with
    assert df.filter("pitcher = 7 and game_year = 1999").count() == 0 and df.filter("pitcher = 7 and game_year = 2025 and pitcher in (8, 9)").count() == 0
    assert df.filter(F.col("pitcher").isin(5, 6) & (F.col("game_year") == 2025)).groupBy("pitcher").count().count() == 2


def test_what_is_not_asked_for(source):
    for condition in ("pitcher = 7", "game_year = 2025", "pitcher > 7 and game_year = 2025"):
        with pytest.raises(PySparkException, match="season and player"):
            source().filter(condition).collect()


def test_fallback_and_errors(source):
    rows = source(fallback="tests.fake_remote:by_dates").filter("pitcher = 13 and game_year = 2025").collect()
    assert sorted((r.game_pk, r.pitcher, r.game_year, r.pitch_type) for r in rows) == [(f"2025{i}", 13, 2025, "FF") for i in range(3)]
    with pytest.raises(PySparkException, match="HTML.*no fallback"):
        source().filter("pitcher = 14 and game_year = 2025").collect()
    with pytest.raises(PySparkException, match="down"):
        source().filter("pitcher = 13 and game_year = 2025").collect()


def test_retries(source, tmp_path):
    """Each failure is asked for again as often as tries says, and no more."""
    asked = tmp_path / "asked"
    df = source(fallback="tests.fake_remote:by_dates").filter("pitcher = 13 and game_year = 2025")
    os.environ["FAKE_REMOTE_LOG"] = str(asked)
    try:
        reader = PitchReader(FIELDS, "tests.fake_remote:transport", "tests.fake_remote:by_dates", None, 5.0, 2, 0.0)
        assert list(reader.pushFilters([EqualTo(("pitcher",), 13), EqualTo(("game_year",), 2025), EqualTo(("zone",), "1")])) == [EqualTo(("zone",), "1")]
        assert len(list(reader.read(reader.partitions()[0]))) == 3
    finally:
        del os.environ["FAKE_REMOTE_LOG"]
    assert asked.read_text().splitlines() == ["13 2025"] * 2 and df.count() == 3
