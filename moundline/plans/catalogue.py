"""A query for each operator over the projected pitch table, and the SQL that holds it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundline.functions import names
from moundline.functions.coercion import coerce
from moundline.operators import clean, metrics, profiles, quality
from moundline.operators.dedup import keep_last, upsert
from moundline.plans import sql
from moundline.plans.projection import DUCKDB_SQL, ORDINAL, OUTCOMES, raw_pitches, table, with_outcomes
from moundline.schema import FETCH_LOG, FIELDS, FOLDED, LOG_KEY, NAMES, PITCH_KEY, PITCHES
from moundline.session import temporary
from moundline.sources import landing, players, store
from moundline.sources.baselines import LeagueBaselines
from moundline.sources.store import ORDINAL as ORDINAL_OF_FILES
from moundline.sources.store import PitchStore

CLOCK = dt.datetime(1998, 6, 1, 12)
KEYS = ["game_pk", "at_bat_number", "pitch_number", "pitcher"]
FIRST_NAMES, LAST_NAMES = ["josé", "JUAN", "o'neil", "Zoë"], ["Ramírez", "de la Cruz", "smith-jones", "Núñez"]


# DataFrames --------------------------------------------------------------------------------------------------------
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitive pitches with a legal count, the last of each key: what the analyses read."""
    df = raw_pitches(spark, sf_dir)
    df = df.transform(clean.drop_non_competitive).transform(clean.filter_game_types).transform(clean.consolidate_pitch_types).transform(clean.add_count_state)
    return keep_last(df, PITCH_KEY, ORDINAL)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As cleaned, with the fuller set of outcomes."""
    return with_outcomes(cleaned(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.prepare_for_storage(raw_pitches(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.prepare_for_storage(raw_pitches(spark, sf_dir), keep=tuple(x for x in ORDINAL if x not in FIELDS))
    return keep_last(coerce(rows, PITCHES), PITCH_KEY, ORDINAL).select(*FIELDS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each pitcher and season, and some without pitches."""
    raw = raw_pitches(spark, sf_dir).select(F.col("pitcher").alias("mlbam_id"), F.col("game_year").alias("season")).distinct()
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000_000).alias("mlbam_id"), F.lit(1997).alias("season"))
    df = raw.unionByName(more).withColumns({"player_type": F.lit("pitcher"), "row_count": (F.col("mlbam_id") % 5).cast("int")})
    return df.withColumn("fetched_at", F.expr("timestamp_ntz'1998-05-31 00:00:00' + make_dt_interval(0, cast(mlbam_id % 48 as int))")).select(*FETCH_LOG.fieldNames())


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pitcher"), F.col("s_name").alias("player_name"))
    return raw_pitches(spark, sf_dir).select("pitcher", "game_year").join(names, "pitcher", "left")


def coerce_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_pk"), F.col("l_linenumber").alias("pitch_number"), (F.col("l_quantity") / 2).alias("zone"),
        F.when(F.col("l_partkey") % 7 == 0, "NA").otherwise(F.col("l_quantity").cast("string")).alias("release_speed"),
        F.when(F.col("l_partkey") % 5 == 0, "no date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("game_date"), F.when(F.col("l_partkey") % 3 == 0, "nan").otherwise(F.col("l_returnflag")).alias("type"),
    )
    return coerce(df, PITCHES)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pitches again, faster: those of even pitchers under their keys, those of odd ones under new keys."""
    current = cleaned(spark, sf_dir).select(*KEYS, "release_speed")
    new = F.when(F.col("pitcher") % 2 == 1, F.col("game_pk") + 1_000_000_000).otherwise(F.col("game_pk"))
    return upsert(current, current.withColumns({"game_pk": new, "release_speed": F.col("release_speed") + 1000}), PITCH_KEY)


def log_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries fetched again a day later: every third for another season, so those are new and the old ones stay."""
    old = log(spark, sf_dir)
    new = {"season": F.when(F.col("mlbam_id") % 3 == 0, F.col("season") + 100).otherwise(F.col("season")).cast("int"), "row_count": F.col("row_count") + 1, "fetched_at": F.expr("fetched_at + INTERVAL 1 DAY")}
    return upsert(old, old.withColumns(new), LOG_KEY)


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of players, seasons as text like in the source; some without an id, names that several have."""
    of = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey")).alias("key_mlbam"), of("c_custkey", *FIRST_NAMES).alias("name_first"), F.concat(of("c_nationkey", *LAST_NAMES), (F.col("c_custkey") % 11).cast("string")).alias("name_last"),
        F.lit("1990.0").alias("mlb_played_first"), F.when(F.col("c_custkey") % 4 > 0, F.concat((F.col("c_custkey") % 31 + 1990).cast("string"), F.lit(".0"))).alias("mlb_played_last"),
    )


def player_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of a name that a search or a file name needs."""
    df = register(spark, sf_dir).select("key_mlbam", F.concat_ws(" ", F.lit(" "), "name_first", "name_last").alias("name"))
    first, last = names.first_and_last(F.col("name"))
    return df.select("key_mlbam", "name", names.strip_accents_column("name").alias("plain"), names.title_column("name").alias("title"), names.slug_column(F.trim("name")).alias("slug"), first.alias("first"), last.alias("last"))


_LANDED = ["game_pk", "at_bat_number", "pitch_number", "pitcher", "game_date", "game_type", "pitch_type", "description", "stand", "p_throws"]


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected pitches as gzip CSV files with missing tokens in three columns, read back as a source's files are."""
    path = temporary(spark, "landed")
    df = raw_pitches(spark, sf_dir).select(*_LANDED)
    df = df.withColumns({"description": F.coalesce("description", F.lit("NA")), "game_type": F.coalesce("game_type", F.lit("null")), "pitch_type": F.coalesce("pitch_type", F.lit("nan"))})
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return landing.read_landing(spark, path).drop(ORDINAL_OF_FILES)


def _landed_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files with three headers (another order, other columns) and of files whose rows are too short or too long."""
    path = temporary(spark, "landed")
    df = raw_pitches(spark, sf_dir)
    kind = F.col("game_pk") % 5
    for i, (names, codec) in enumerate(((_LANDED, "gzip"), (_LANDED[::-1], "none"), (["zone", "pitch_type", "game_pk", "pitch_number"], "none"))):
        df.filter(kind == i).select(*names).write.options(header=True, compression=codec).csv(f"{path}/kind={i}")
    # Rows of one field (another separator, so that commas need no quotes) under a header of three columns.
    short, long = F.concat_ws(",", "game_pk", "pitcher"), F.concat_ws(",", "game_pk", "pitcher", "batter", "inning")
    broken = df.filter(kind > 2).select(F.when(kind == 3, short).otherwise(long).alias("game_pk,pitcher,batter"))
    broken.write.options(header=True, sep="\x01").csv(f"{path}/kind=3")
    return f"{path}/kind=*"


def landed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several headers, each read by its own; columns that were not asked for are kept as one text."""
    rows = landing.land(spark, _landed_folder(spark, sf_dir), _LANDED, rescue=True).rows.drop(ORDINAL_OF_FILES)
    return rows.withColumn("rescued", F.element_at("_rescued", "zone")).drop("_rescued")


def landed_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose width is not that of their header; each has a line of its own in its file."""
    path = _landed_folder(spark, sf_dir)
    # The files listed, without their content: a number is a narrower key than a path, and each task holds the keys of its rows.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("number"))
    rejected = landing.land(spark, path).rejected.join(F.broadcast(files), "file")
    return rejected.groupBy("record", "columns").agg(F.count_distinct("number", "line").alias("lines"))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("mlbam_id", "season", "player_type", store.is_fresh(CLOCK, 1).alias("fresh"))


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship in Spark SQL with a bound parameter."""
    return spark.sql(
        "SELECT CAST(balls AS INT) || '-' || CAST(strikes AS INT) AS count, COUNT(*) AS pitches,"
        " ROUND(100.0D * SUM(CASE WHEN pitch_type IN ('FF', 'SI', 'FC') THEN 1 ELSE 0 END) / COUNT(*), 1) AS fastball_pct"
        " FROM {pitches} WHERE game_year = :year GROUP BY balls, strikes", args={"year": 1995}, pitches=cleaned(spark, sf_dir),
    )


def by_function(text: str, year: int = 1995):
    """A table function of SQL with bound parameters over the cleaned pitches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql.register(tracked(spark, sf_dir))
        return spark.sql(text, args={"player": 6, "year": year})

    return query


def _exact(df: DataFrame, column: str, medians: DataFrame) -> DataFrame:
    """column_name, and exactly: distinct values, shares up to and below the median in ``medians``, the most frequent value. Values are counted first, so tasks pass on counts, never a set or a map of values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    value, q, share = F.col(column).cast("double"), F.col("q")[column], lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    number = column != "pitch_type"
    to, below = (share(value <= q), share(value < q)) if number else [F.lit(None).cast("double")] * 2
    mode = F.lit(None).cast("string") if number else F.max_by(column, F.struct("n", column))
    out = counts.crossJoin(F.broadcast(medians)).agg(F.count("*").alias("exact"), to.alias("to"), below.alias("below"), mode.alias("mode"))
    return out.select(F.lit(column).alias("column_name"), "exact", "to", "below", "mode")


def profile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each season, merged: whether what they say of the whole table is within their error of exact values."""
    df, columns = raw_pitches(spark, sf_dir), ["game_pk", "batter", "release_spin_rate", "pitch_type", "strikes"]
    found = profiles.profile(profiles.merged(profiles.sketches(df, columns, ["game_year"])), top=1, shares=(0.5,))
    medians = found.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.get("quantiles", F.lit(0))))).alias("q"))  # one row
    exact = reduce(DataFrame.unionByName, [_exact(df, c, medians) for c in columns])
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), profiles.DISTINCT_ERROR * F.col("exact"))
    half = (F.col("below") <= 0.5 + profiles.RANK_ERROR) & (F.col("to") >= 0.5 - profiles.RANK_ERROR)
    often = F.when(F.col("column_name") == "pitch_type", F.get("frequent", F.lit(0))["item"] == F.col("mode"))
    return found.join(exact, "column_name").select("column_name", "rows", "null_fraction", near.alias("distinct_near"), half.alias("median_near"), often.alias("most_frequent"))


def kept_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League sums of a store after two writes, the second over part of the first, each added by difference."""
    stored = PitchStore(spark, temporary(spark, "store"))
    df, league = prepared(spark, sf_dir).withColumn(ORDINAL_OF_FILES, F.struct("game_date", "release_speed", "pitcher", "batter")), LeagueBaselines(stored)
    stored.save_batch(df)
    league.refresh()
    stored.save_batch(df.filter("game_year = 1995 and pitcher % 3 = 0").withColumn("estimated_woba_using_speedangle", F.col("estimated_woba_using_speedangle") + 1))
    return league.sums()


# SQL ---------------------------------------------------------------------------------------------------------------
def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {column} END"


_LABEL = "CAST(CAST(balls AS INT) AS VARCHAR) || '-' || CAST(CAST(strikes AS INT) AS VARCHAR)"
_OK = "pitch_type IS NOT NULL AND pitch_type <> '' AND pitch_type NOT IN ('PO', 'IN', 'AB', 'AS', 'UN') AND NOT COALESCE(description IN ('intent_ball', 'pitchout', 'automatic_ball', 'automatic_strike'), FALSE)"
_GAME = "game_type IN ('R', 'F', 'D', 'L', 'W')"
_COUNT = "balls BETWEEN 0 AND 3 AND strikes BETWEEN 0 AND 2"
_WITH = f"""WITH raw AS (SELECT {DUCKDB_SQL} FROM lineitem),
folded AS (SELECT * REPLACE ({_case("pitch_type", FOLDED)} AS pitch_type) FROM raw),
legal AS (SELECT * FROM folded WHERE {_OK} AND {_GAME} AND {_COUNT}),
p AS (SELECT * FROM legal QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY l_shipdate DESC, l_extendedprice DESC, pitcher DESC, batter DESC, l_discount DESC, l_tax DESC) = 1),
t AS (SELECT * REPLACE ({OUTCOMES} AS description), {_LABEL} AS label FROM p)
"""
_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
_HAVE = "game_pk game_date game_type game_year at_bat_number pitch_number inning pitcher batter p_throws stand pitch_type release_speed release_spin_rate pfx_x pfx_z zone balls strikes description estimated_woba_using_speedangle".split()


def _columns(own: dict[str, str]) -> str:
    return ", ".join(own.get(f.name, f.name if f.name in _HAVE else f"CAST(NULL AS {_SQL_TYPES[f.dataType.simpleString()]})") + f" AS {f.name}" for f in PITCHES)


_STORED = _columns({"balls": "CAST(round_even(balls, 0) AS INTEGER)", "strikes": "CAST(round_even(strikes, 0) AS INTEGER)"})
_GAMES = "SELECT * REPLACE (game_pk % 50 AS game_pk, batter % 9 AS batter, game_pk * 40 + at_bat_number AS at_bat_number)"
_LOG = """log AS (
  SELECT mlbam_id, season, 'pitcher' AS player_type, CAST(mlbam_id % 5 AS INTEGER) AS row_count, TIMESTAMP '1998-05-31 00:00:00' + to_hours(CAST(mlbam_id % 48 AS BIGINT)) AS fetched_at
  FROM (SELECT DISTINCT pitcher AS mlbam_id, game_year AS season FROM raw UNION ALL SELECT s_suppkey + 100000000, 1997 FROM supplier))"""


_PICK = lambda key, names: "CASE " + f"{key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n.replace(chr(39), chr(39) * 2)}'" for i, n in enumerate(names)) + " END"
_REGISTER = f"WITH r AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS key_mlbam, {_PICK('c_custkey', FIRST_NAMES)} AS name_first, {_PICK('c_nationkey', LAST_NAMES)} || CAST(c_custkey % 11 AS VARCHAR) AS name_last, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 31 + 1990 AS VARCHAR) || '.0' END AS mlb_played_last FROM customer)"

_TRANSITIONS = "s AS (SELECT pitcher, pitch_type AS next, lag(pitch_type) OVER w AS previous, lag(description) OVER w AS outcome FROM t WINDOW w AS (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number))"
_QUADRANT = "CASE WHEN zone IN (1, 11) THEN 'up-left' WHEN zone IN (3, 12) THEN 'up-right' WHEN zone IN (7, 13) THEN 'down-left' WHEN zone IN (9, 14) THEN 'down-right' ELSE 'middle' END"
_FAST = "pitch_type IN ('FF', 'SI', 'FC')"
_SWING = "description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul', 'hit_into_play')"
_MISS = "description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip')"
_STRIKE = "description IN ('swinging_strike', 'swinging_strike_blocked', 'foul_tip', 'foul', 'hit_into_play', 'called_strike')"

_FLAGS = {
    "predictable_counts": (
        "x AS (SELECT pitcher, label, pitch_type, COUNT(*) AS k FROM t GROUP BY ALL), y AS (SELECT pitcher, label, SUM(k) AS n FROM x GROUP BY ALL), "
        "g AS (SELECT label, pitch_type, COUNT(*) AS k FROM t GROUP BY ALL), h AS (SELECT label, SUM(k) AS n FROM g GROUP BY ALL)",
        "SELECT pitcher, x.label AS count, pitch_type, CAST(y.n AS BIGINT) AS n, x.k / y.n::DOUBLE AS value, g.k / h.n::DOUBLE AS league, x.k / y.n::DOUBLE - g.k / h.n::DOUBLE AS delta"
        " FROM x JOIN y USING (pitcher, label) JOIN g USING (label, pitch_type) JOIN h USING (label) WHERE y.n >= {n} AND x.k / y.n::DOUBLE >= {share} AND x.k / y.n::DOUBLE - g.k / h.n::DOUBLE >= {delta}",
    ),
}

#: Lower ones than in the settings, so that the projected pitches raise flags of every kind.
GATES = {"predictable_count": 5, "first_pitch": 2, "handedness_gap": 10, "hittable_pitch": 5, "location_leak": 4, "sequencing_tell": 3, "fatigue_outings": 2}
THRESHOLDS = {
    "predictable_count_share": 0.3, "predictable_count_delta_vs_league": 0.02, "first_pitch_share": 0.5, "first_pitch_strike_rate_low": 0.6, "handedness_usage_gap": 0.1, "hittable_pitch_xwoba_delta": 0.05,
    "location_leak_share": 0.3, "sequencing_tell_prob": 0.5, "fatigue_velo_drop_mph": 0.1,
}

QUERIES = {
    "raw_projection": raw_pitches,
    "consolidate_pitch_types": lambda s, d: clean.consolidate_pitch_types(raw_pitches(s, d)).select(*KEYS, "pitch_type", "pitch_display"),
    "drop_non_competitive": lambda s, d: clean.drop_non_competitive(raw_pitches(s, d)).select(*KEYS, "pitch_type", "description"),
    "filter_game_types": lambda s, d: clean.filter_game_types(raw_pitches(s, d)).select(*KEYS, "game_type"),
    "filter_game_types_override": lambda s, d: clean.filter_game_types(raw_pitches(s, d), ["S"]).select(*KEYS, "game_type"),
    "add_count_state": lambda s, d: clean.add_count_state(raw_pitches(s, d)).select(*KEYS, "count", "is_ahead", "is_behind", "is_two_strike", "is_first_pitch"),
    "prepare_for_storage": prepared,
    "coerce_schema_types": coerce_types,
    "dedup_keep_last": lambda s, d: keep_last(raw_pitches(s, d), PITCH_KEY, ORDINAL).select(*PITCH_KEY, "pitcher", "batter", "release_speed"),
    "upsert_pitches": upserted,
    "upsert_fetch_log": log_upserted,
    "landed_csv": landed,
    "landed_headers": landed_headers,
    "landed_rejected": landed_rejected,
    "player_names": player_names,
    "players_latest": lambda s, d: players.latest_by_name(register(s, d)).withColumn("candidates", F.array_join("candidates", ",")),
    "stored_pitches": stored,
    "load_pitcher_season": lambda s, d: store.pitcher_season(stored(s, d), 6, 1995),
    "cache_summary": lambda s, d: store.summary(log(s, d), named(s, d)),
    "is_cached": fresh,
    "quality_checks": lambda s, d: quality.quality_checks(stored(s, d)),
    "quality_checks_raw": lambda s, d: quality.quality_checks(raw_pitches(s, d)),
    "value_counts": lambda s, d: quality.value_counts(raw_pitches(s, d), "pitch_type"),
    "value_counts_game_type": lambda s, d: quality.value_counts(raw_pitches(s, d), "game_type"),
    "null_fraction": lambda s, d: quality.null_fractions(stored(s, d)),
    "velocity_range": lambda s, d: quality.speed_range(cleaned(s, d)),
    "row_counts": lambda s, d: quality.row_counts(raw_pitches(s, d), cleaned(s, d)),
    "distinct_counts": lambda s, d: cleaned(s, d).agg(F.count_distinct("count").alias("counts")),
    "pitch_mix_by_count": lambda s, d: metrics.pitch_mix_by_count(cleaned(s, d)),
    "pitch_mix_sql": sql_surface,
    "pitch_mix_function": by_function("SELECT * FROM pitch_mix_by_count(:player, :year)"),
    "arsenal_function": by_function("SELECT * FROM pitch_arsenal(:player, :year)"),
    "transitions_function": by_function("SELECT * FROM pitch_transitions(:player, :year)", 1997),
    "profile_bounds": profile_bounds,
    "league_baselines": kept_baselines,
    "arsenal_share": lambda s, d: metrics.arsenal_share(cleaned(s, d)),
    "arsenal_share_with_nulls": lambda s, d: metrics.arsenal_share(raw_pitches(s, d)),
    "arsenal_summary": lambda s, d: metrics.arsenal_summary(tracked(s, d)),
    "folded_arsenal": lambda s, d: metrics.folded_arsenal(tracked(s, d)),
    "count_predictability": lambda s, d: metrics.count_predictability(tracked(s, d)),
    "predictable_counts": lambda s, d: metrics.predictable_counts(tracked(s, d), least=5, share=0.3, delta=0.02),
    "first_pitch": lambda s, d: metrics.first_pitch(tracked(s, d), least=2),
    "putaway_mix": lambda s, d: metrics.putaway_mix(tracked(s, d)),
    "handedness_gap": lambda s, d: metrics.handedness_gap(tracked(s, d), least=10, gap=0.1),
    "hittable_pitches": lambda s, d: metrics.hittable_pitches(tracked(s, d), least=5, delta=0.05),
    "location_leaks": lambda s, d: metrics.location_leaks(tracked(s, d), least=4, share=0.3),
    "transitions": lambda s, d: metrics.transitions(tracked(s, d)),
    "transitions_by_outcome": lambda s, d: metrics.transitions(tracked(s, d), by_outcome=True),
    "sequencing_tells": lambda s, d: metrics.sequencing_tells(tracked(s, d), least=1, share=0.5),
    "velocity_decay": lambda s, d: metrics.velocity_decay(with_games(tracked(s, d)), least=2, drop=0.1),
    "times_through_order": lambda s, d: metrics.times_through_order(with_games(tracked(s, d))),
    "takeaways": lambda s, d: metrics.takeaways(with_games(tracked(s, d)), gates=GATES, thresholds=THRESHOLDS),
}


def with_games(df: DataFrame) -> DataFrame:
    """Larger games and fewer batters, so that outings are long; plate appearances keep an order of their own."""
    return df.withColumns({"game_pk": F.col("game_pk") % 50, "batter": F.col("batter") % 9, "at_bat_number": F.col("game_pk") * 40 + F.col("at_bat_number")})


ORACLES = {
    "raw_projection": f"{_WITH} SELECT * FROM raw",
    "consolidate_pitch_types": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, pitch_type, {_case('pitch_type', NAMES)} AS pitch_display FROM folded",
    "drop_non_competitive": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, pitch_type, description FROM raw WHERE {_OK}",
    "filter_game_types": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, game_type FROM raw WHERE {_GAME}",
    "filter_game_types_override": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, game_type FROM raw WHERE game_type IN ('S')",
    "add_count_state": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, {_LABEL} AS count, strikes > balls AS is_ahead, balls > strikes AS is_behind, strikes = 2 AS is_two_strike, balls = 0 AND strikes = 0 AS is_first_pitch FROM raw WHERE {_COUNT}",
    "prepare_for_storage": f"{_WITH} SELECT {_columns({'game_date': 'CAST(game_date AS TIMESTAMP)'})} FROM legal",
    "coerce_schema_types": "SELECT l_orderkey AS game_pk, CAST(l_linenumber AS INTEGER) AS pitch_number, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS zone, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS release_speed, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS game_date, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_returnflag END AS type FROM lineitem",
    "dedup_keep_last": f"{_WITH} SELECT game_pk, at_bat_number, pitch_number, pitcher, batter, release_speed FROM raw QUALIFY row_number() OVER (PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY l_shipdate DESC, l_extendedprice DESC, pitcher DESC, batter DESC, l_discount DESC, l_tax DESC) = 1",
    "upsert_pitches": f"{_WITH}, st AS (SELECT CASE WHEN pitcher % 2 = 1 THEN game_pk + 1000000000 ELSE game_pk END AS game_pk, at_bat_number, pitch_number, pitcher, release_speed + 1000 AS release_speed FROM p) SELECT game_pk, at_bat_number, pitch_number, pitcher, release_speed FROM p WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.game_pk = p.game_pk AND st.at_bat_number = p.at_bat_number AND st.pitch_number = p.pitch_number) UNION ALL SELECT * FROM st",
    "upsert_fetch_log": f"{_WITH}, {_LOG}, st AS (SELECT mlbam_id, CAST(CASE WHEN mlbam_id % 3 = 0 THEN season + 100 ELSE season END AS INTEGER) AS season, player_type, row_count + 1 AS row_count, fetched_at + INTERVAL 1 DAY AS fetched_at FROM log) SELECT * FROM log WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.mlbam_id = log.mlbam_id AND st.season = log.season AND st.player_type = log.player_type) UNION ALL SELECT * FROM st",
    "landed_csv": f"{_WITH} SELECT CAST(game_pk AS VARCHAR) AS game_pk, CAST(at_bat_number AS VARCHAR) AS at_bat_number, CAST(pitch_number AS VARCHAR) AS pitch_number, CAST(pitcher AS VARCHAR) AS pitcher, CAST(game_date AS VARCHAR) AS game_date, game_type, NULLIF(pitch_type, '') AS pitch_type, description, stand, p_throws FROM raw",
    "landed_headers": f"{_WITH} SELECT CAST(game_pk AS VARCHAR) AS game_pk, CASE WHEN game_pk % 5 < 2 THEN CAST(at_bat_number AS VARCHAR) END AS at_bat_number, CAST(pitch_number AS VARCHAR) AS pitch_number, CASE WHEN game_pk % 5 < 2 THEN CAST(pitcher AS VARCHAR) END AS pitcher, CASE WHEN game_pk % 5 < 2 THEN CAST(game_date AS VARCHAR) END AS game_date, CASE WHEN game_pk % 5 < 2 THEN game_type END AS game_type, NULLIF(pitch_type, '') AS pitch_type, CASE WHEN game_pk % 5 < 2 THEN description END AS description, CASE WHEN game_pk % 5 < 2 THEN stand END AS stand, CASE WHEN game_pk % 5 < 2 THEN p_throws END AS p_throws, CASE WHEN game_pk % 5 = 2 THEN CAST(zone AS VARCHAR) END AS rescued FROM raw WHERE game_pk % 5 < 3",
    "landed_rejected": f"{_WITH} SELECT record, 3 AS columns, COUNT(*) AS lines FROM (SELECT CASE WHEN game_pk % 5 = 3 THEN concat_ws(',', game_pk, pitcher) ELSE concat_ws(',', game_pk, pitcher, batter, inning) END AS record FROM raw WHERE game_pk % 5 > 2) GROUP BY record",
    "player_names": f"{_REGISTER}, n AS (SELECT key_mlbam, '  ' || name_first || ' ' || name_last AS name FROM r) SELECT key_mlbam, name, strip_accents(name) AS plain, array_to_string([CASE WHEN i = 1 OR NOT regexp_matches(name[i - 1], '\\p{{L}}') THEN upper(name[i]) ELSE lower(name[i]) END FOR i IN range(1, length(name) + 1)], '') AS title, replace(lower(trim(name)), ' ', '_') AS slug, split_part(trim(name), ' ', 1) AS first, substr(trim(name), length(split_part(trim(name), ' ', 1)) + 2) AS last FROM n",
    "players_latest": f"{_REGISTER}, k AS (SELECT lower(strip_accents(name_first)) AS name_first, lower(strip_accents(name_last)) AS name_last, key_mlbam AS id, CAST(CAST(mlb_played_last AS DOUBLE) AS INTEGER) AS last FROM r WHERE key_mlbam IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY name_first, name_last ORDER BY last DESC NULLS LAST, id) AS place FROM k) SELECT name_first, name_last, MAX(id) FILTER (place = 1) AS key_mlbam, COUNT(*) > 1 AND COALESCE(MAX(last) FILTER (place = 1) = MAX(last) FILTER (place = 2), MAX(last) FILTER (place = 1) IS NULL) AS ambiguous, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 5) AS candidates FROM t GROUP BY name_first, name_last",
    "stored_pitches": f"{_WITH} SELECT {_STORED} FROM p",
    "load_pitcher_season": f"{_WITH} SELECT {_STORED} FROM p WHERE pitcher = 6 AND game_year = 1995",
    "cache_summary": f"{_WITH}, {_LOG} SELECT l.mlbam_id, l.season, l.player_type, l.row_count, l.fetched_at, MAX(s.s_name) AS player_name FROM log l LEFT JOIN raw r ON r.pitcher = l.mlbam_id AND r.game_year = l.season LEFT JOIN supplier s ON s.s_suppkey = r.pitcher GROUP BY ALL",
    "is_cached": f"{_WITH}, {_LOG} SELECT mlbam_id, season, player_type, CASE WHEN row_count = 0 THEN FALSE WHEN season < 1998 THEN TRUE ELSE date_diff('second', fetched_at, TIMESTAMP '1998-06-01 12:00:00') < 86400 END AS fresh FROM log",
    "value_counts": f"{_WITH} SELECT pitch_type AS value, COUNT(*) AS n FROM raw GROUP BY ALL",
    "value_counts_game_type": f"{_WITH} SELECT game_type AS value, COUNT(*) AS n FROM raw GROUP BY ALL",
    "velocity_range": f"{_WITH} SELECT MIN(release_speed) AS min_speed, MAX(release_speed) AS max_speed FROM p",
    "row_counts": f"{_WITH} SELECT (SELECT COUNT(*) FROM raw) AS raw, (SELECT COUNT(*) FROM p) AS cleaned, (SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM p) AS removed",
    "distinct_counts": f"{_WITH} SELECT COUNT(DISTINCT label) AS counts FROM t",
    "pitch_mix_by_count": f"{_WITH} SELECT label AS count, COUNT(*) AS pitches, ROUND(100.0::DOUBLE * SUM(CASE WHEN {_FAST} THEN 1 ELSE 0 END) / COUNT(*), 1) AS fastball_pct FROM t GROUP BY label",
    "pitch_mix_sql": f"{_WITH} SELECT label AS count, COUNT(*) AS pitches, ROUND(100.0::DOUBLE * SUM(CASE WHEN {_FAST} THEN 1 ELSE 0 END) / COUNT(*), 1) AS fastball_pct FROM t WHERE game_year = 1995 GROUP BY label",
    "arsenal_share": f"{_WITH} SELECT pitch_type, COUNT(*) AS n, 100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM p) AS pct FROM p GROUP BY pitch_type ORDER BY n DESC, pitch_type LIMIT 6",
    "arsenal_share_with_nulls": f"{_WITH} SELECT pitch_type, COUNT(*) AS n, 100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM raw) AS pct FROM raw WHERE pitch_type IS NOT NULL GROUP BY pitch_type ORDER BY n DESC, pitch_type LIMIT 6",
    "arsenal_summary": f"{_WITH} SELECT pitcher, pitch_type, COUNT(*) AS n, AVG(release_speed) AS mean_speed, AVG(release_spin_rate) AS mean_spin, AVG(pfx_x) AS mean_pfx_x, AVG(pfx_z) AS mean_pfx_z, CAST(COUNT(*) FILTER ({_SWING}) AS BIGINT) AS swings, AVG(CASE WHEN {_SWING} THEN CAST({_MISS} AS INT)::DOUBLE END) AS whiff_rate, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY pitcher))::DOUBLE AS usage FROM t GROUP BY pitcher, pitch_type",
    "folded_arsenal": f"{_WITH}, f AS (SELECT pitcher, CASE WHEN COUNT(*) OVER (PARTITION BY pitcher, pitch_type) < 15 THEN 'Other' ELSE pitch_type END AS pitch_type FROM t) SELECT pitcher, pitch_type, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY pitcher))::DOUBLE AS usage FROM f GROUP BY pitcher, pitch_type",
    "count_predictability": f"{_WITH}, x AS (SELECT pitcher, label, pitch_type, COUNT(*) AS k FROM t GROUP BY ALL), y AS (SELECT *, SUM(k) OVER (PARTITION BY pitcher, label)::DOUBLE AS n FROM x), a AS (SELECT pitcher, COUNT(DISTINCT pitch_type) AS k FROM t GROUP BY ALL) SELECT y.pitcher, y.label AS count, CAST(SUM(y.k) AS BIGINT) AS n, COUNT(*) AS types, ROUND(CASE WHEN MAX(a.k) > 1 THEN -SUM(y.k / y.n * LN(y.k / y.n)) / LN(MAX(a.k)) ELSE 0.0 END, 6) AS entropy FROM y JOIN a USING (pitcher) GROUP BY y.pitcher, y.label",
    "predictable_counts": f"{_WITH}, " + " ".join(_FLAGS["predictable_counts"]).format(n=5, share=0.3, delta=0.02),
    "first_pitch": f"{_WITH}, x AS (SELECT pitcher, pitch_type, COUNT(*) AS k, COUNT(*) FILTER ({_STRIKE}) AS s FROM t WHERE balls = 0 AND strikes = 0 GROUP BY ALL), y AS (SELECT *, SUM(k) OVER (PARTITION BY pitcher) AS n, SUM(s) OVER (PARTITION BY pitcher) AS ss, row_number() OVER (PARTITION BY pitcher ORDER BY k DESC, pitch_type) AS r FROM x) SELECT pitcher, CAST(n AS BIGINT) AS n, pitch_type AS top_type, k / n::DOUBLE AS top_share, ss / n::DOUBLE AS strike_rate FROM y WHERE r = 1 AND n >= 2",
    "putaway_mix": f"{_WITH} SELECT pitcher, pitch_type, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY pitcher))::DOUBLE AS value FROM t WHERE strikes = 2 GROUP BY pitcher, pitch_type",
    "handedness_gap": f"{_WITH}, x AS (SELECT pitcher, pitch_type, COUNT(*) FILTER (stand = 'L') AS l, COUNT(*) FILTER (stand = 'R') AS r FROM t GROUP BY ALL), y AS (SELECT *, SUM(l) OVER (PARTITION BY pitcher) AS nl, SUM(r) OVER (PARTITION BY pitcher) AS nr FROM x), z AS (SELECT pitcher, pitch_type, CAST(LEAST(nl, nr) AS BIGINT) AS n, l / nl::DOUBLE AS usage_l, r / nr::DOUBLE AS usage_r FROM y WHERE LEAST(nl, nr) >= 10) SELECT *, usage_l - usage_r AS gap FROM z WHERE ABS(usage_l - usage_r) >= 0.1",
    "hittable_pitches": f"{_WITH}, x AS (SELECT pitcher, pitch_type, COUNT(estimated_woba_using_speedangle) AS n, AVG(estimated_woba_using_speedangle) AS value FROM t GROUP BY ALL), g AS (SELECT pitch_type, AVG(estimated_woba_using_speedangle) AS league FROM t GROUP BY ALL) SELECT pitcher, pitch_type, n, value, league, value - league AS delta FROM x JOIN g USING (pitch_type) WHERE n >= 5 AND value - league >= 0.05",
    "location_leaks": f"{_WITH}, x AS (SELECT pitcher, pitch_type, {_QUADRANT} AS quadrant, COUNT(*) AS k FROM t WHERE zone IS NOT NULL GROUP BY ALL), y AS (SELECT *, SUM(k) OVER (PARTITION BY pitcher, pitch_type) AS n FROM x) SELECT pitcher, pitch_type, quadrant, CAST(n AS BIGINT) AS n, k / n::DOUBLE AS value FROM y WHERE quadrant <> 'middle' AND n >= 4 AND k / n::DOUBLE >= 0.3",
    "transitions": f"{_WITH}, {_TRANSITIONS} SELECT pitcher, previous, next, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY pitcher, previous))::DOUBLE AS value FROM s WHERE previous IS NOT NULL GROUP BY pitcher, previous, next",
    "transitions_by_outcome": f"{_WITH}, {_TRANSITIONS} SELECT pitcher, previous, outcome, next, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY pitcher, previous, outcome))::DOUBLE AS value FROM s WHERE previous IS NOT NULL GROUP BY pitcher, previous, outcome, next",
    "sequencing_tells": f"{_WITH}, {_TRANSITIONS}, x AS (SELECT pitcher, previous, next, COUNT(*) AS k FROM s WHERE previous IS NOT NULL GROUP BY ALL), y AS (SELECT *, SUM(k) OVER (PARTITION BY pitcher, previous) AS n FROM x) SELECT pitcher, previous, next, CAST(n AS BIGINT) AS n, k / n::DOUBLE AS value FROM y WHERE n >= 1 AND k / n::DOUBLE >= 0.5",
    "velocity_decay": f"{_WITH}, o AS ({_GAMES} FROM t), x AS (SELECT pitcher, game_pk AS g, release_speed AS v, ntile(3) OVER (PARTITION BY pitcher, game_pk ORDER BY at_bat_number, pitch_number) AS third FROM o WHERE release_speed IS NOT NULL), y AS (SELECT pitcher, g, AVG(v) FILTER (third = 1) - AVG(v) FILTER (third = 3) AS d FROM x GROUP BY ALL) SELECT pitcher, COUNT(d) AS n, ROUND(AVG(d), 6) AS value FROM y GROUP BY pitcher HAVING COUNT(d) >= 2 AND ROUND(AVG(d), 6) >= 0.1",
    "times_through_order": f"{_WITH}, o AS ({_GAMES} FROM t), x AS (SELECT pitcher, release_speed, CAST(dense_rank() OVER (PARTITION BY game_pk, pitcher, batter ORDER BY at_bat_number) AS INTEGER) AS time FROM o) SELECT pitcher, time, COUNT(*) AS n, AVG(release_speed) AS mean_speed FROM x GROUP BY pitcher, time",
}


def _checks(rows: str) -> str:
    tests = {
        "legal_counts": _COUNT, "no_null_types": "pitch_type IS NOT NULL", "no_folded_codes": "NOT COALESCE(pitch_type IN ('FT', 'FA', 'CS', 'KC', 'SV', 'FO'), FALSE)", "no_exhibitions": "NOT COALESCE(game_type IN ('S', 'E', 'A'), FALSE)",
        "plausible_speed": "release_speed BETWEEN 50 AND 110", "key_not_null": "game_pk IS NOT NULL AND at_bat_number IS NOT NULL AND pitch_number IS NOT NULL",
    }
    one = [f"SELECT '{k}' AS \"check\", COALESCE(bool_and(COALESCE({c}, FALSE)), TRUE) AS ok FROM {rows}" for k, c in tests.items()]
    one.append(f"SELECT 'at_most_12_counts', COUNT(DISTINCT {_LABEL}) <= 12 FROM {rows}")
    one.append(f"SELECT 'key_unique', COALESCE(bool_and(n = 1), TRUE) FROM (SELECT COUNT(*) AS n FROM {rows} GROUP BY game_pk, at_bat_number, pitch_number)")
    return f"{_WITH} " + " UNION ALL ".join(one)


_MINE = "t WHERE pitcher = 6 AND game_year = 1995"
_KEPT = "(PARTITION BY game_pk, at_bat_number, pitch_number ORDER BY game_date DESC, release_speed DESC, pitcher DESC, batter DESC)"
ORACLES |= {
    "pitch_mix_function": f"{_WITH} SELECT label AS count, COUNT(*) AS pitches, ROUND(100.0::DOUBLE * SUM(CASE WHEN {_FAST} THEN 1 ELSE 0 END) / COUNT(*), 1) AS fastball_pct FROM {_MINE} GROUP BY label",
    "arsenal_function": f"{_WITH} SELECT pitch_type, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER ())::DOUBLE AS usage, AVG(release_speed) AS mean_speed FROM {_MINE} GROUP BY pitch_type",
    "transitions_function": f"{_WITH}, m AS (SELECT pitcher, lag(pitch_type) OVER (PARTITION BY game_pk, at_bat_number ORDER BY pitch_number) AS previous, pitch_type AS next FROM t WHERE game_year = 1997) SELECT previous, next, COUNT(*) AS n, COUNT(*) / (SUM(COUNT(*)) OVER (PARTITION BY previous))::DOUBLE AS value FROM m WHERE previous IS NOT NULL AND pitcher = 6 GROUP BY previous, next",
    "profile_bounds": f"{_WITH} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS rows, AVG(({c} IS NULL)::INT)::DOUBLE AS null_fraction, TRUE AS distinct_near, {'NULL::BOOLEAN' if c == 'pitch_type' else 'TRUE'} AS median_near, {'TRUE' if c == 'pitch_type' else 'NULL::BOOLEAN'} AS most_frequent FROM raw" for c in ("game_pk", "batter", "release_spin_rate", "pitch_type", "strikes")),
    "league_baselines": f"{_WITH}, a AS (SELECT * FROM legal QUALIFY row_number() OVER {_KEPT} = 1), b AS (SELECT * REPLACE (estimated_woba_using_speedangle + 1 AS estimated_woba_using_speedangle) FROM legal WHERE game_year = 1995 AND pitcher % 3 = 0 QUALIFY row_number() OVER {_KEPT} = 1), s AS (SELECT * FROM a ANTI JOIN b USING (game_pk, at_bat_number, pitch_number) UNION ALL SELECT * FROM b) SELECT game_year AS season, {_LABEL} AS count, pitch_type, COUNT(*) AS n, COUNT(estimated_woba_using_speedangle) AS valued, SUM(estimated_woba_using_speedangle) AS value FROM s GROUP BY ALL",
}
ORACLES |= {"quality_checks": _checks("p"), "quality_checks_raw": _checks("raw")}
_NULLS = " UNION ALL ".join(f"SELECT '{f.name}' AS column_name, AVG(CAST({f.name} IS NULL AS INT)::DOUBLE) AS null_fraction FROM st" for f in PITCHES)
ORACLES["null_fraction"] = f"{_WITH}, st AS (SELECT {_STORED} FROM p) SELECT * FROM ({_NULLS}) WHERE null_fraction > 0.5 ORDER BY null_fraction DESC, column_name LIMIT 8"


def _takeaways() -> str:
    games = _WITH.rstrip() + f",\nt AS ({_GAMES} FROM t0)\n"
    games = games.replace("t AS (SELECT * REPLACE (CASE", "t0 AS (SELECT * REPLACE (CASE", 1)
    of = lambda name: ORACLES[name].removeprefix(_WITH)  # noqa: E731  the rest of a query over t
    flags = {
        "predictable_count": (of("predictable_counts"), "count || ' ' || pitch_type", "n", "value", "league"),
        "handedness_gap": (of("handedness_gap"), "pitch_type", "n", "ABS(gap)", "0.1"),
        "hittable_pitch": (of("hittable_pitches"), "pitch_type", "n", "value", "league"),
        "velocity_decay": (of("velocity_decay").replace(_GAMES, "SELECT *"), "''", "n", "value", "0.1"),
        "sequencing_tell": (of("sequencing_tells").replace("n >= 1", "n >= 3"), "previous || ' ' || next", "n", "value", "0.5"),
        "location_leak": (of("location_leaks"), "pitch_type || ' ' || quadrant", "n", "value", "0.3"),
        "first_pitch": (of("first_pitch") + " AND k / n::DOUBLE >= 0.5", "top_type", "n", "top_share", "0.5"),
        "few_first_strikes": (of("first_pitch") + " AND ss / n::DOUBLE < 0.6", "''", "n", "strike_rate", "0.6"),
    }
    parts = []
    for name, (sql, detail, n, value, baseline) in flags.items():
        sql = sql.strip().removeprefix(",").strip()
        sql = sql if sql.startswith("SELECT") else f"WITH {sql}"
        parts.append(f"SELECT pitcher, '{name}' AS flag, {detail} AS detail, CAST({n} AS BIGINT) AS n, {value} AS value, {baseline}::DOUBLE AS baseline FROM ({sql})")
    return (
        f"{games}, found AS ({' UNION ALL '.join(parts)}), rated AS (SELECT *, ROUND(ABS(value - baseline) / baseline, 6) AS severity FROM found)"
        " SELECT *, CAST(row_number() OVER (PARTITION BY pitcher ORDER BY severity DESC, flag, detail) AS INTEGER) AS place FROM rated QUALIFY place <= 5"
    )


ORACLES["takeaways"] = _takeaways()
