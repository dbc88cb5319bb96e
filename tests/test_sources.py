import time

import pytest

from moundline import config
from moundline.functions import names
from moundline.sources import players, remote
from moundline.sources.landing import BadSource
from pyspark.sql import functions as F


def test_config(tmp_path):
    assert config.get("data.max_retries") == 3 and config.get("data.nothing", 4) == 4 and config.get("data.max_retries.deeper", 5) == 5 and config.get("data.endpoint", 1) is None
    (tmp_path / "c.yaml").write_text("data:\n  max_retries: 9\n")
    assert config.get("data.max_retries", path=str(tmp_path / "c.yaml")) == 9 and config.get("data.cache_ttl_days", path=str(tmp_path / "c.yaml")) == 1
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.yaml"))
    with pytest.raises(KeyError):
        config.resolve_path("data.endpoint")
    assert config.resolve_path("report.output_dir").endswith("/reports")


def test_names(spark):
    assert names.strip_accents("José Núñez") == "Jose Nunez" and names.title("o'neill smith-jones") == "O'Neill Smith-Jones" and names.slug("Jo Do Re") == "jo_do_re"
    df = spark.createDataFrame([("  José  de la Cruz",), ("Ichiro",), (None,)], "n string")
    first, last = names.first_and_last(F.col("n"))
    assert [tuple(r) for r in df.select(first, last).collect()] == [("José", "de la Cruz"), ("Ichiro", None), (None, None)]
    assert [tuple(r) for r in df.select(names.strip_accents_column("n"), names.title_column("n"), names.slug_column(F.col("n"))).collect()][0] == ("  Jose  de la Cruz", "  José  De La Cruz", "__josé__de_la_cruz")


REGISTER = "key_mlbam long, name_first string, name_last string, mlb_played_first double, mlb_played_last double"


def test_players(spark):
    rows = [(1, "Tarik", "Skubal", 2020.0, 2025.0), (2, "José", "Ramírez", 2013.0, 2025.0), (3, "Luis", "Garcia", 2010.0, 2024.0), (4, "Luis", "Garcia", 2016.0, 2024.0), (5, "Will", "Smith", 2012.0, 2020.0), (6, "Will", "Smith", 2019.0, 2025.0), (None, "No", "Id", None, None), (7, "A", "B", None, None), (8, "A", "B", None, None)]
    register = spark.createDataFrame(rows, REGISTER)
    found = players.resolve_player(register, " jose  ramirez ")
    assert (found.mlbam_id, found.first_season, found.last_season, found.full_name) == (2, 2013, 2025, "José Ramírez")
    assert players.resolve_player(register, "Will Smith").mlbam_id == 6
    for name in ("Skubal", "No Id", "Not There"):
        with pytest.raises(players.PlayerNotFound):
            players.resolve_player(register, name)
    for name, text in (("Luis Garcia", "id=3.*id=4"), ("A B", r"\?-\?")):
        with pytest.raises(players.PlayerNotFound, match=text):
            players.resolve_player(register, name)
    more = [(20, "Jose", "Ramirez", 2014.0, 2025.0), (21, None, "Solo", 2001.0, 2002.0)] + [(30 + i, "Seven", "Times", 2000.0, 2010.0 + i) for i in range(7)]
    latest = {(r.name_first, r.name_last): (r.key_mlbam, r.ambiguous, r.candidates) for r in players.latest_by_name(spark.createDataFrame(rows + more, REGISTER)).collect()}
    assert latest == {
        ("tarik", "skubal"): (1, False, [1]), ("jose", "ramirez"): (2, True, [2, 20]), ("luis", "garcia"): (3, True, [3, 4]), ("will", "smith"): (6, False, [6, 5]), ("a", "b"): (7, True, [7, 8]),
        (None, "solo"): (21, False, [21]), ("seven", "times"): (36, False, [36, 35, 34, 33, 32]),
    }


def test_names_without_python(spark, capsys):
    """Every letter of the tables that the expression is made of, and the plan."""
    letters = [chr(c) for c in [*range(1, 0x3000), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800)] if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"a{x}b", x) for x in letters], "n string, x string").select("x", names.strip_accents_column("n").alias("s"))
    assert {r.x: r.s for r in df.collect()} == {x: names.strip_accents(f"a{x}b") for x in letters}
    spark.createDataFrame([("a",)], "n string").select(names.strip_accents_column("n"), names.title_column("n")).explain()
    assert "Python" not in capsys.readouterr().out


def many(spark, rows):
    return spark.range(0, rows, 1, 1).select("id", F.concat(F.lit("José de la Núñez "), F.col("id").cast("string")).alias("n"))


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_names_cost_a_few_lookups_a_letter(spark):
    """A row took 0.2 ms when a regular expression held all letters with longer forms."""
    plain = many(spark, 40_000).select(names.strip_accents_column("n"))
    seconds(plain.limit(10))
    assert seconds(plain) < 3


def test_fetch():
    params = remote.build_params(7, 2025, "batter")
    assert len(params) == 39 and params["batters_lookup[]"] == "7" and params["hfSea"] == "2025|" and params["hfGT"] == "R|PO|"
    waited, calls = [], []

    def flaky(params, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise OSError("down")
        return "a,b\n1,2\n"

    free = remote.RateLimit(0, sleep=lambda s: None)
    assert remote.fetch_player_season(7, 2025, transport=flaky, limit=free, sleep=waited.append).startswith("a,b") and waited == [2, 4] and calls == [120] * 3
    assert remote.fetch_player_season(7, 2025, transport=lambda p, t: "a,b\n", limit=free, sleep=waited.append) == "a,b\n"
    page = lambda p, t: "  <html>"
    assert remote.fetch_player_season(7, 2025, transport=page, fallback=lambda *a: str(a), limit=free, sleep=lambda s: None) == "(7, '2025-01-01', '2025-12-31', 'pitcher')"
    with pytest.raises(BadSource, match="HTML.*no fallback"):
        remote.fetch_player_season(7, 2025, transport=page, limit=free, sleep=lambda s: None)
    with pytest.raises(ValueError, match="catcher"):
        remote.fetch_player_season(7, 2025, "catcher")
    clock, slept = [100.0], []
    limit = remote.RateLimit(3, now=lambda: clock[0], sleep=slept.append)
    limit.wait()
    clock[0] += 1
    limit.wait()
    assert slept == [2.0]


def test_latest_players_cost_a_few_lookups_a_letter(spark):
    """Both names of each row are decomposed."""
    register = many(spark, 40_000).select(F.col("id").alias("key_mlbam"), F.lit("Zoë").alias("name_first"), F.concat(F.lit("Núñez-Ramírez"), (F.col("id") % 50).cast("string")).alias("name_last"), F.lit("2000.0").alias("mlb_played_last"))
    latest = players.latest_by_name(register)
    assert latest.count() == 50
    assert seconds(latest) < 4
