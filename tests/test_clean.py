import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from moundline.operators import clean, quality
from moundline.schema import FIELDS

FRAME = {
    "game_pk": (1, "long"), "game_date": ("2025-05-01", "string"), "game_type": ("R", "string"), "game_year": (2025, "int"), "at_bat_number": (1, "int"), "pitch_number": (1, "int"), "pitcher": (669373, "long"),
    "batter": (1, "long"), "pitch_type": ("FF", "string"), "description": ("ball", "string"), "balls": (0.0, "double"), "strikes": (0.0, "double"), "release_speed": (95.0, "double"),
}


@pytest.fixture
def frame(spark):
    def make(*rows, **each):
        n = max([len(rows), *(len(v) for v in each.values())], default=0)
        data = [tuple(({k: v[i] for k, v in each.items()} | (rows[i] if rows else {})).get(c, d) for c, (d, _) in FRAME.items()) for i in range(n)]
        return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, (_, t) in FRAME.items()))

    return make


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


@pytest.mark.parametrize(("given", "want"), [("FT", "SI"), ("FA", "FF"), ("KC", "CU"), ("CS", "CU"), ("CU", "CU"), ("ST", "ST"), ("SL", "SL"), ("SV", "SL"), ("FO", "FS"), ("CH", "CH"), ("FC", "FC"), ("ZZ", "ZZ"), ("", ""), (None, None)])
def test_folding(frame, given, want):
    assert column(clean.consolidate_pitch_types(frame(pitch_type=[given])), "pitch_type") == [want]


def test_display(frame):
    df = frame(pitch_type=["FT", "ST", "ZZ", None])
    assert column(clean.consolidate_pitch_types(df), "pitch_display") == ["Sinker", "Sweeper", "ZZ", None]
    assert column(df, "pitch_type") == ["FT", "ST", "ZZ", None]


def test_no_contest(frame):
    assert column(clean.drop_non_competitive(frame(pitch_type=["FF", "PO", "IN", "AB", "AS", "UN", "SL", None, ""])), "pitch_type") == ["FF", "SL"]
    kept = clean.drop_non_competitive(frame(description=["ball", "intent_ball", "pitchout", "automatic_ball", "automatic_strike", None]))
    assert column(kept, "description") == ["ball", None]


def test_game_types(frame):
    df = frame(game_type=["R", "S", "E", "F", "D", "L", "W", None])
    assert column(clean.filter_game_types(df), "game_type") == ["R", "F", "D", "L", "W"]
    assert column(clean.filter_game_types(df, ["S"]), "game_type") == ["S"] and clean.filter_game_types(df, []).count() == 0


def test_counts(frame):
    df = clean.add_count_state(frame(balls=[0.0, 3.0, 0.0, 3.0, 1.0, 2.9999], strikes=[0.0, 2.0, 2.0, 0.0, 1.0, 2.0]))
    assert column(df, "count") == ["0-0", "3-2", "0-2", "3-0", "1-1", "2-2"]
    flags = [tuple(r) for r in df.select("is_ahead", "is_behind", "is_two_strike", "is_first_pitch").collect()]
    assert flags[:5] == [(False, False, False, True), (False, True, True, False), (True, False, True, False), (False, True, False, False), (False, False, False, False)]
    left = clean.add_count_state(frame(balls=[0.0, 4.0, 1.0, -1.0, 3.4, -0.3, None, 0.0], strikes=[0.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, None]))
    assert column(left, "count") == ["0-0"]
    grid = [(b, s) for b in range(4) for s in range(3)]
    every = clean.add_count_state(frame(balls=[float(b) for b, _ in grid], strikes=[float(s) for _, s in grid]))
    assert every.count() == 12 == every.select("count").distinct().count()


def test_whole(frame):
    df = clean.prepare_for_storage(frame({"pitch_type": "FT"}, {"pitch_type": "PO", "balls": 1.0}, {"game_type": "S", "balls": 2.0}, {"pitch_type": "SL", "balls": 5.0}))
    assert df.columns == FIELDS and column(df, "pitch_type") == ["SI"] and column(df, "zone") == [None]
    assert dict(df.dtypes)["game_date"] == "timestamp_ntz" and str(column(df, "game_date")[0]) == "2025-05-01 00:00:00"
    with pytest.raises(ValueError, match="balls"):
        clean.prepare_for_storage(frame({}).drop("balls"))


def test_dates_raise_on_rows_that_stay(frame):
    df = frame({"game_date": "garbage", "game_type": "S"}, {"game_date": None}, {"game_date": "2025-06-01"})
    assert sorted(column(clean.prepare_for_storage(df), "game_date"), key=str)[0] is not None
    with pytest.raises(PySparkException, match="not a date"):
        clean.prepare_for_storage(frame({"game_date": "garbage"})).collect()


def test_empty(frame):
    none = frame({}).limit(0)
    for step in (clean.consolidate_pitch_types, clean.drop_non_competitive, clean.filter_game_types, clean.add_count_state, clean.prepare_for_storage):
        assert step(none).count() == 0
    assert {r.ok for r in quality.quality_checks(clean.prepare_for_storage(none)).collect()} == {True}


def test_checks(frame):
    ok = lambda df: {r.check: r.ok for r in quality.quality_checks(df).collect()}
    bad = {"balls": 4.0, "pitch_type": None, "game_type": "S", "release_speed": None, "pitch_number": None}
    assert not any(v for k, v in ok(frame({}, {}, bad, {"pitch_type": "FT"})).items() if k != "at_most_12_counts")
    assert all(ok(frame({}, {"pitch_number": 2}, {"pitch_number": 3, "release_speed": 50.0})).values())


def test_profiles(frame):
    df = frame(pitch_type=["FF", "FF", None, "SL"], description=[None, None, None, "ball"])
    assert [tuple(r) for r in quality.value_counts(df, "pitch_type").collect()] == [("FF", 2), ("SL", 1), (None, 1)]
    assert [tuple(r) for r in quality.null_fractions(df).collect()] == [("description", 0.75)]
    assert tuple(quality.row_counts(df, df.filter(F.col("pitch_type") == "FF")).first()) == (4, 2, 2)
