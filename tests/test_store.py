import datetime as dt
import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundline.__main__ import smoke, summary
from moundline.functions.coercion import coerce
from moundline.operators.clean import prepare_for_storage
from moundline.plans import catalogue
from moundline.schema import FETCH_LOG, FIELDS, PITCHES
from moundline.sources import landing, store
from moundline.sources.store import KeyViolation, PitchStore
from moundline.streaming.landing import RAW, ingest, stream_landing

NOW = dt.datetime(2025, 6, 1, 12)


def pitches(spark, *rows):
    base = {"game_pk": 1, "game_date": dt.date(2025, 5, 1), "game_type": "R", "game_year": 2025, "at_bat_number": 1, "pitch_number": 1, "pitcher": 7, "balls": 0, "strikes": 0, "pitch_type": "FF", "player_name": "A B"}
    return spark.createDataFrame([tuple((base | r).get(f) for f in [*FIELDS, "_ordinal"]) for r in rows], T.StructType([*PITCHES.fields, T.StructField("_ordinal", T.LongType())]))


@pytest.fixture
def made(spark, tmp_path):
    return PitchStore(spark, str(tmp_path / "s"), clock=lambda: NOW)


def kept(s):
    return sorted((r.game_pk, r.at_bat_number, r.pitch_number, r.pitch_type, r.game_year) for r in s.pitches.collect())


def test_upsert(spark, made):
    assert made.pitches.count() == 0 and made.pitches.schema == PITCHES and made.fetch_log.schema == FETCH_LOG
    assert made.save_pitches(pitches(spark, {"_ordinal": 1}, {"_ordinal": 2, "pitch_type": "SL"}, {"pitch_number": 2, "_ordinal": 3}), 7, 2025) == 2
    assert kept(made) == [(1, 1, 1, "SL", 2025), (1, 1, 2, "FF", 2025)]
    assert made.save_pitches(pitches(spark, {"pitch_type": "CU", "_ordinal": 1}, {"game_pk": 2, "game_year": 2024, "_ordinal": 2}), 7, 2025) == 2
    assert kept(made) == [(1, 1, 1, "CU", 2025), (1, 1, 2, "FF", 2025), (2, 1, 1, "FF", 2024)]
    made.save_pitches(pitches(spark, {"game_year": 2024, "pitch_type": "CH", "_ordinal": 1}), 7, 2024)  # the key moves to another season
    assert kept(made) == [(1, 1, 1, "CH", 2024), (1, 1, 2, "FF", 2025), (2, 1, 1, "FF", 2024)]
    again = PitchStore(spark, made.root, clock=lambda: NOW)
    assert kept(again) == kept(made)
    assert sorted(tuple(r)[:4] for r in made.fetch_log.collect()) == [(7, 2024, "pitcher", 1), (7, 2025, "pitcher", 2)]


def test_failed_writes_leave_the_store(spark, made):
    made.save_pitches(pitches(spark, {"_ordinal": 1}), 7, 2025)
    with pytest.raises(KeyViolation):
        made.save_pitches(pitches(spark, {"pitch_number": None, "_ordinal": 1}, {"pitch_type": "CU", "_ordinal": 2}), 7, 2025)
    with pytest.raises(ValueError, match="zone"):
        made.save_pitches(pitches(spark, {}).drop("zone"), 7, 2025)
    wide = pitches(spark, {}).withColumn("zone", F.lit(3e9))
    with pytest.raises(PySparkException):
        made.save_pitches(wide, 7, 2025)
    assert kept(made) == [(1, 1, 1, "FF", 2025)] and made.fetch_log.first().row_count == 1


def test_empty_and_fresh(spark, made):
    assert made.save_pitches(pitches(spark, {}).limit(0), 8, 2025) == 0
    assert made.fetch_log.first().row_count == 0 and made.pitches.count() == 0 and not made.is_cached(8, 2025) and not made.is_cached(9, 2025)
    made.save_pitches(pitches(spark, {}), 7, 2025)
    assert made.is_cached(7, 2025) and not made.is_cached(7, 2025, "batter")
    rows = [(1, 2025, "p", 1, NOW - dt.timedelta(days=1)), (2, 2025, "p", 1, NOW - dt.timedelta(seconds=86399)), (3, 2024, "p", 1, dt.datetime(2020, 1, 1)), (4, 2024, "p", 0, NOW), (5, 2026, "p", 1, NOW), (6, 2025, "p", None, NOW)]
    fresh = {r.mlbam_id: r.f for r in spark.createDataFrame(rows, FETCH_LOG).select("mlbam_id", store.is_fresh(NOW, 1).alias("f")).collect()}
    assert fresh == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_reading(spark, made):
    made.save_batch(pitches(spark, {"game_pk": 3, "game_date": None}, {"game_pk": 2}, {"game_pk": 1, "game_date": dt.date(2025, 6, 1)}, {"game_pk": 2, "pitch_number": 2}, {"game_pk": 9, "pitcher": 8, "player_name": "C D"}))
    assert [(r.game_pk, r.pitch_number) for r in made.load_pitcher_season(7, 2025).collect()] == [(2, 1), (2, 2), (1, 1), (3, 1)]
    assert made.load_pitcher_season(7, 2020).count() == 0
    made.save_pitches(pitches(spark, {}).limit(0), 5, 2023)
    assert sorted((r.mlbam_id, r.season, r.row_count, r.player_name) for r in made.cache_summary().collect()) == [(5, 2023, 0, None), (7, 2025, 4, "A B"), (8, 2025, 1, "C D")]
    assert made.sql("SELECT COUNT(*) AS n FROM pitches WHERE pitcher = ? AND game_year = ?", 7, 2025).first().n == 4
    assert not spark.catalog.tableExists("pitches") and not spark.catalog.tableExists("fetch_log")


def test_coercion(spark):
    raw = spark.createDataFrame([("2.5", "x", "2025-01-02", "a", 2.9999), ("3.5", "12d", "bad", None, float("nan")), (None, "1e3", None, "b", 1.5)], "zone string, pfx_x string, game_date string, type string, balls double")
    got = coerce(raw, PITCHES).collect()
    assert [r.zone for r in got] == [2, 4, None] and [r.pfx_x for r in got] == [None, None, 1000.0]
    assert [str(r.game_date) for r in got] == ["2025-01-02", "None", "None"] and [r.type for r in got] == ["a", None, "b"] and [r.balls for r in got] == [3, None, 2]
    with pytest.raises(PySparkException):
        coerce(spark.createDataFrame([("inf",)], "zone string"), PITCHES).collect()


CSV = ",".join(FIELDS) + "\n"


def line(**own):
    base = {"game_pk": 1, "game_date": "2025-05-01", "game_type": "R", "game_year": 2025, "at_bat_number": 1, "pitch_number": 1, "pitcher": 7, "balls": "0", "strikes": "0.0", "pitch_type": "FT", "description": "NA", "zone": "nan", "release_speed": "95.1"}
    return ",".join(str((base | own).get(f, "")) for f in FIELDS) + "\n"


def test_landing(spark, made, tmp_path):
    with gzip.open(tmp_path / "a_2025_raw.csv.gz", "wt") as f:
        f.write(CSV + line() + line(balls="3.4") + line(pitch_number=2, pitch_type="null") + line(pitch_type="SL"))
    raw = landing.read_landing(spark, str(tmp_path / "a_2025_raw.csv.gz"))
    landing.check_columns(raw)
    landing.check_not_html(spark, str(tmp_path / "a_2025_raw.csv.gz"))
    assert [r.description for r in raw.collect()] == [None] * 4 and [r.pitch_type for r in raw.collect()] == ["FT", "FT", None, "SL"]
    cleaned = prepare_for_storage(landing.numeric_counts(raw), keep=("_ordinal",))
    assert made.save_pitches(cleaned, 7, 2025) == 1 and kept(made) == [(1, 1, 1, "SL", 2025)]
    with pytest.raises(landing.BadSource):
        landing.check_columns(raw.drop("balls"))
    (tmp_path / "b.csv").write_text("  <html>busy</html>")
    with pytest.raises(landing.BadSource):
        landing.check_not_html(spark, str(tmp_path / "b.csv"))
    landing.export_csv(raw, str(tmp_path / "out"))
    assert landing.read_landing(spark, str(tmp_path / "out")).count() == 4
    for _ in range(2):  # over an older one too
        landing.export_csv(raw, str(tmp_path / "one_raw.csv.gz"))
    assert (tmp_path / "one_raw.csv.gz").is_file() and landing.read_landing(spark, str(tmp_path / "one_raw.csv.gz")).count() == 4
    (tmp_path / "other.csv").write_text("pitch_type,spin\nFF,2200\n")
    both = landing.read_landings(spark, [str(tmp_path / "out"), str(tmp_path / "other.csv")])
    assert sorted((r.pitch_type, r.spin, r.pitcher) for r in both.filter("pitch_type = 'FF' or spin is not null").collect()) == [("FF", "2200", None)]


def test_each_file_by_its_own_header(spark, tmp_path):
    """Other orders, other columns, a mark in front, names with signs, no rows, and rows that are too short or too long."""
    (tmp_path / "a b.csv").write_text("pitcher,pitch_type,balls\n1,FF,0\n2,SL\n\n3,CU,1,9\n,NA,2\n")
    (tmp_path / "c[1].csv").write_text("\ufeffballs,pitch_type,pitcher,spin\n0,FF,1,2200\n\"3\",\"a,b\",4,nan\n")
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("pitcher,Pitcher,,pitch_type\n5,6,7,FF\nlast\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "bare.csv").write_text("pitch_type,pitcher\n")
    found = landing.land(spark, str(tmp_path))
    names = ["pitcher", "pitch_type", "balls", "spin", "Pitcher.1", "unnamed_2"]
    assert sorted(c.lower() for c in found.rows.columns) == sorted([*(c.lower() for c in names), "_ordinal"])
    got = [tuple(r[c] for c in names) for r in found.rows.orderBy("_ordinal").collect()]
    assert got == [("1", "FF", "0", None, None, None), (None, None, "2", None, None, None), ("1", "FF", "0", "2200", None, None), ("4", "a,b", "3", None, None, None), ("5", "FF", None, None, "6", "7")]
    rejected = sorted((r.file.rsplit("/", 1)[1], r.line, r.columns, r.record) for r in found.rejected.collect())
    assert rejected == [("a%20b.csv", 3, 3, "2,SL"), ("a%20b.csv", 5, 3, "3,CU,1,9"), ("z.csv.gz", 3, 4, "last")]
    assert found.rows.count() == 5 and found.rows.select("spin").count() == 5
    some = landing.read_landing(spark, str(tmp_path), ["balls", "nothing"], rescue=True)
    assert some.columns == ["balls", "nothing", "_rescued", "_ordinal"]
    assert sorted((r.balls or "", r.nothing, sorted(r._rescued.items())) for r in some.collect())[0] == ("", None, [("Pitcher.1", "6"), ("pitch_type", "FF"), ("pitcher", "5"), ("unnamed_2", "7")])
    assert landing.quarantine(found, str(tmp_path / "q/rejected")) == 3 and spark.read.parquet(str(tmp_path / "q/rejected")).count() == 3
    (tmp_path / "page.csv").write_text("\n <html>busy</html>\n")
    report = {r.file.rsplit("/", 1)[1]: (r.html, r.missing) for r in landing.header_report(spark, str(tmp_path / "*.csv*"), ["pitcher", "balls"]).collect()}
    assert report == {"z.csv.gz": (False, ["balls"]), "bare.csv": (False, ["balls"]), "page.csv": (True, None)}
    with pytest.raises(landing.BadSource, match="page.csv is HTML"):
        landing.check_source(spark, str(tmp_path / "page.csv"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/a.csv").write_text("")
    nothing = landing.land(spark, str(tmp_path / "empty"), ["balls"], rescue=True)
    assert nothing.rows.count() == nothing.rejected.count() == 0 and nothing.rows.columns == ["balls", "_rescued", "_ordinal"]


def test_lines_of_rejected_rows_in_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{i}\n" if i % 997 else f"{i}\n" for i in range(5000)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        found = landing.land(spark, str(tmp_path))
        assert found.rows.rdd.getNumPartitions() > 4
        assert sorted((r.line, r.record) for r in found.rejected.collect()) == [(i + 2, str(i)) for i in range(0, 5000, 997)]
        assert [int(r.x) for r in found.rows.orderBy("_ordinal").collect()] == [i for i in range(5000) if i % 997]
    finally:
        spark.conf.set(key, before)


def test_old_parts_go(spark, made, tmp_path):
    for i in range(4):
        made.save_pitches(pitches(spark, {"pitch_type": ["FF", "SL", "CU", "CH"][i]}, {"game_pk": 50 + i}), 7, 2025)
    assert len(kept(made)) == 5 and made.pitches.filter("pitch_type = 'CH'").count() == 1
    version, state = made.snapshot()
    there = {str(p.relative_to(made.root)) for p in (tmp_path / "s/pitches").rglob("part-*")}
    named = {f["path"] for f in state["files"]}
    assert version == 4 and named <= there and there - named == set(state["gone"])  # the newest, and what it replaced


def opened(s, df):
    return {f.removeprefix(f"file://{s.root}/") for f in df.inputFiles()}


def test_zone_maps(spark, made):
    """Fifty seasons: a write looks into the files whose zones can hold its keys only, a lookup opens those of the season."""
    years = range(1975, 2025)
    made.save_batch(pitches(spark, *[{"game_pk": 100 * y + g, "game_year": y, "pitcher": 7 + g} for y in years for g in range(4)]))
    before = {f["path"]: f for f in made.snapshot()[1]["files"]}
    assert {f["season"] for f in before.values()} == set(years) and sum(f["rows"] for f in before.values()) == 200
    assert all(f["games"][0] // 100 == f["games"][1] // 100 == f["season"] for f in before.values())
    looked = []
    read = made._read
    made._read = lambda schema, files: looked.extend(f["path"] for f in files) or read(schema, files)
    made.save_pitches(pitches(spark, {"game_pk": 201001, "game_year": 2010, "pitcher": 8, "pitch_type": "CU"}), 8, 2010)
    made._read = read
    assert {before[p]["season"] for p in looked if p in before} == {2010}
    after = {f["path"] for f in made.snapshot()[1]["files"]}
    assert {before[p]["season"] for p in before if p not in after} == {2010} and made.pitches.count() == 200
    assert opened(made, made.load_pitcher_season(8, 2010)) == {f["path"] for f in made.files_of(2010, 8)} and len(made.files_of(2010)) <= 6
    assert [r.pitch_type for r in made.load_pitcher_season(8, 2010).collect()] == ["CU"] and made.files_of(games=(199901, 199902)) == made.files_of(1999, games=(199901, 199902))


def test_writers_at_once(spark, made):
    """Each of two writers sees the other's snapshot between its own reading and its own commit; none is lost."""
    made.save_pitches(pitches(spark, {"_ordinal": 1}), 7, 2025)
    other, commit = PitchStore(spark, made.root, clock=lambda: NOW), made._commit
    rival = [[{"pitch_type": "SL"}, {"game_pk": 5}], [{"game_pk": 6, "game_year": 2024}]]

    def beaten(version, state):
        if rival:
            other.save_pitches(pitches(spark, *rival.pop(0)), 9, 2024)
        return commit(version, state)

    made._commit = beaten
    made.save_pitches(pitches(spark, {"pitch_type": "CU"}, {"game_pk": 8}), 7, 2025)
    assert not rival and kept(made) == [(1, 1, 1, "CU", 2025), (5, 1, 1, "FF", 2025), (6, 1, 1, "FF", 2024), (8, 1, 1, "FF", 2025)]
    assert sorted((r.mlbam_id, r.season, r.row_count) for r in other.fetch_log.collect()) == [(7, 2025, 2), (9, 2024, 1)]
    made._commit = lambda version, state: False
    with pytest.raises(store.Conflict):
        made.save_pitches(pitches(spark, {"game_pk": 99}), 7, 2025)
    assert not commit(other.snapshot()[0], {}) and len(kept(other)) == 4  # a number is made once


def test_crash_between_data_and_log(spark, made):
    made.save_pitches(pitches(spark, {}), 7, 2025)
    made._logged = lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        made.save_pitches(pitches(spark, {"pitch_type": "CU"}, {"game_pk": 2}), 7, 2025)
    again = PitchStore(spark, made.root, clock=lambda: NOW)
    assert kept(again) == [(1, 1, 1, "FF", 2025)] and again.fetch_log.first().row_count == 1


def test_log_pieces(spark, made):
    """The log grows by small pieces that are put together by size; the latest entry of each key counts."""
    for i in range(20):
        made.save_pitches(pitches(spark, {}).limit(0), i % 5, 2025)
    made.save_pitches(pitches(spark, {}), 3, 2025)
    pieces = made.snapshot()[1]["log"]
    assert len(pieces) < 2 * store.MANY_PIECES and sum(f["rows"] for f in pieces) < 21
    assert sorted((r.mlbam_id, r.row_count) for r in made.fetch_log.collect()) == [(i, int(i == 3)) for i in range(5)]


def test_batches_once(spark, made):
    batch = pitches(spark, {}, {"game_pk": 2})
    assert made.save_batch(batch, batch=("stream", 0)) == 2 and made.save_batch(batch.withColumn("pitch_type", F.lit("CU")), batch=("stream", 0)) == 0
    assert {r[3] for r in kept(made)} == {"FF"}
    assert made.save_batch(batch.withColumn("pitch_type", F.lit("CU")), batch=("stream", 1)) == 2 and made.save_batch(batch, batch=("other", 0)) == 2


def test_many_files(spark, made, monkeypatch):
    monkeypatch.setattr(store, "MANY_FILES", 3)
    for i in range(4):
        made.save_pitches(pitches(spark, {"game_pk": i, "pitcher": i}), i, 2025)
    assert len(kept(made)) == 4 and len(made.snapshot()[1]["files"]) < 4


def test_views_of_the_session_stay(spark, made):
    made.save_pitches(pitches(spark, {}), 7, 2025)
    spark.range(5).createOrReplaceTempView("pitches")
    try:
        assert made.sql("SELECT COUNT(*) AS n FROM pitches").first().n == 1 and made.sql("SELECT COUNT(*) AS n FROM {fetch_log} JOIN {pitches} p ON p.pitcher = mlbam_id WHERE row_count = ?", 1).first().n == 1
        assert spark.table("pitches").count() == 5
    finally:
        spark.catalog.dropTempView("pitches")


def test_smoke(spark, made, capsys):
    made.save_pitches(pitches(spark, {"release_speed": 95.0}, {"pitch_number": 2, "release_speed": 93.0}), 7, 2025)
    assert smoke(made, 7, 2025) and "ok   legal_counts" in capsys.readouterr().out
    made.save_pitches(pitches(spark, {"pitch_number": 3, "balls": 9}), 7, 2025)
    assert not smoke(made, 7, 2025) and "FAIL legal_counts" in capsys.readouterr().out
    summary(pitches(spark, {}).drop("_ordinal"))
    assert "1 rows, 40 columns" in capsys.readouterr().out


def test_stream(spark, made, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(CSV + line() + line(pitch_number=2))
    ingest(made, stream_landing(spark, str(tmp_path / "in"), RAW), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/b.csv").write_text(CSV + line(pitch_type="SL") + line(pitcher=8, game_pk=2))
    ingest(made, stream_landing(spark, str(tmp_path / "in"), RAW), str(tmp_path / "cp")).awaitTermination()
    assert kept(made) == [(1, 1, 1, "SL", 2025), (1, 1, 2, "SI", 2025), (2, 1, 1, "SI", 2025)]
    assert sorted(r.mlbam_id for r in made.fetch_log.collect()) == [7, 8]


def test_headers_sort_no_lines(spark, tmp_path):
    """The first lines of files, blank ones left out, by hashing: sorted lines of many .gz files filled a task's memory."""
    for i, text in enumerate(("a,b\n1,2\n", "\n  \nb,c\n3,4\n", "a,b\n5,6\n", "\n")):
        (tmp_path / f"f{i}.csv").write_text(text)
    found = landing.headers(spark, str(tmp_path))
    assert sorted((r.file[-6:], r.header) for r in found.collect()) == [("f0.csv", "a,b"), ("f1.csv", "b,c"), ("f2.csv", "a,b")]
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_rejected_rows_do_not_move_to_their_splits(spark, tmp_path):
    """A row a split goes to the rejected rows; the other way all rejected rows of a split were sorted in one task."""
    (tmp_path / "a.csv").write_text("a,b\n1\n1,2\n1,2,3\n")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rejected = landing.land(spark, str(tmp_path)).rejected
        assert "SortMergeJoin" not in rejected._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.line, r.columns, r.record) for r in rejected.collect()) == [(2, 2, "1"), (4, 2, "1,2,3")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_writes_run_compiled(spark, tmp_path, monkeypatch):
    """The cleaning of all stored columns in one method is more than the JVM compiles: fused, it took four times as long."""
    key, seen, plain = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: seen.append((path, int(spark.conf.get(key)))) or plain(self, path, *a, **b))
    before = spark.conf.get(key)
    PitchStore(spark, str(tmp_path / "store")).save_batch(catalogue.prepared(spark, "/root/testdata/sf0.001"))
    assert [limit for path, limit in seen if "/pitches/" in path] == [8000] and spark.conf.get(key) == before
