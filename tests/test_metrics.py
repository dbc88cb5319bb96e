"""Metrics on hand-made pitches."""

import pytest

from moundline.operators import metrics

SCHEMA = "pitcher long, batter long, game_pk long, at_bat_number int, pitch_number int, pitch_type string, description string, balls int, strikes int, release_speed double, stand string, zone int, estimated_woba_using_speedangle double, release_spin_rate double, pfx_x double, pfx_z double"


@pytest.fixture
def pitches(spark):
    def make(rows):
        base = {"pitcher": 1, "batter": 1, "game_pk": 1, "at_bat_number": 1, "pitch_type": "FF", "description": "ball", "balls": 0, "strikes": 0, "release_speed": 95.0, "stand": "R"}
        return spark.createDataFrame([tuple((base | {"pitch_number": i} | r).get(c.split()[0]) for c in SCHEMA.split(", ")) for i, r in enumerate(rows)], SCHEMA)

    return make


def test_transitions(pitches):
    df = pitches([{"pitch_type": t, "at_bat_number": a} for a, t in [(1, "FF"), (1, "SL"), (1, "FF"), (2, "SL"), (2, "SL"), (3, "FF")]])
    assert sorted(tuple(r) for r in metrics.transitions(df).collect()) == [(1, "FF", "SL", 1, 1.0), (1, "SL", "FF", 1, 0.5), (1, "SL", "SL", 1, 0.5)]
    assert [tuple(r) for r in metrics.sequencing_tells(df, least=2, share=0.6).collect()] == []
    assert [tuple(r)[:3] for r in metrics.sequencing_tells(df, least=1, share=0.6).collect()] == [(1, "FF", "SL")]


def test_entropy(pitches):
    even = pitches([{"pitch_type": t} for t in ["FF", "SL"] * 5])
    assert metrics.count_predictability(even).first().entropy == 1.0
    assert metrics.count_predictability(pitches([{}] * 3)).first().entropy == 0.0


def test_gates_and_league(pitches):
    df = pitches([{"pitch_type": "FF", "estimated_woba_using_speedangle": 0.6}] * 50 + [{"pitcher": 2, "pitch_type": "FF", "estimated_woba_using_speedangle": 0.2}] * 49 + [{"pitcher": 2, "pitch_type": "SL"}] * 30)
    hit = metrics.hittable_pitches(df).collect()
    assert [(r.pitcher, r.n) for r in hit] == [(1, 50)] and hit[0].delta > 0.06 and metrics.hittable_pitches(df, least=51).count() == 0
    dominated = metrics.predictable_counts(df).collect()
    assert [(r.pitcher, r.count_ if hasattr(r, "count_") else r["count"], r.pitch_type, r.n) for r in dominated] == [(1, "0-0", "FF", 50)]


def test_rare_types_and_whiffs(pitches):
    df = pitches([{"pitch_type": "FF", "description": "foul"}] * 15 + [{"pitch_type": "SL", "description": "swinging_strike"}] * 3 + [{"pitch_type": "CU"}] * 2)
    assert sorted((r.pitch_type, r.n, r.usage) for r in metrics.folded_arsenal(df).collect()) == [("FF", 15, 0.75), ("Other", 5, 0.25)]
    assert {r.pitch_type: r.whiff_rate for r in metrics.arsenal_summary(df).collect()} == {"FF": 0.0, "SL": 1.0, "CU": None}


def test_splits_decay_and_order(pitches):
    df = pitches([{"stand": "L", "pitch_type": "SL"}] * 40 + [{"stand": "R", "pitch_type": "FF"}] * 40)
    assert {(r.pitch_type, r.gap) for r in metrics.handedness_gap(df).collect()} == {("SL", 1.0), ("FF", -1.0)}
    tired = pitches([{"game_pk": g, "pitch_number": i, "release_speed": 96.0 - i} for g in range(10) for i in range(3)])
    assert [tuple(r) for r in metrics.velocity_decay(tired).collect()] == [(1, 10, 2.0)] and metrics.velocity_decay(tired, least=11).count() == 0
    faced = pitches([{"batter": b, "at_bat_number": a} for a, b in [(1, 1), (1, 1), (2, 2), (3, 1)]])
    assert sorted((r.time, r.n) for r in metrics.times_through_order(faced).collect()) == [(1, 3), (2, 1)]


def test_takeaways(pitches):
    df = pitches([{"stand": "L", "pitch_type": "SL", "zone": 1}] * 60 + [{"stand": "R", "pitch_type": "FF", "zone": 14}] * 60 + [{"pitcher": 2, "zone": 5, "at_bat_number": 9}] * 5)
    got = metrics.takeaways(df, most=3).orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3] and all(r.n > 0 and r.baseline is not None for r in got) and [r.severity for r in got] == sorted((r.severity for r in got), reverse=True)
    assert metrics.takeaways(df.limit(0)).count() == 0
