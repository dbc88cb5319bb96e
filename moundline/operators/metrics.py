"""Tendencies of pitchers. Every finding has its n; gates and thresholds come from the settings.

Inputs are cleaned pitches. League rates are taken over all pitches, one row for each code or count (a few hundred
at most, as the codes are a fixed set), so joining them is a broadcast by their nature; Spark sees so itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moundline import config
from moundline.operators.clean import count_label
from moundline.schema import FASTBALLS, MISSES, STRIKES, SWINGS
from moundline.session import saved


def _share(of: list[str], total: list[str]) -> Column:
    return F.col("n") / F.sum("n").over(Window.partitionBy(*total))


def _rate(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def _gate(name: str, given: int | None) -> int:
    return config.get(f"flags.min_n.{name}") if given is None else given


def _limit(name: str, given: float | None) -> float:
    return config.get(f"flags.thresholds.{name}") if given is None else given


# Pitch mix ---------------------------------------------------------------------------------------------------------
def pitch_mix_by_count(df: DataFrame) -> DataFrame:
    """count, pitches, fastball_pct for each count, in order."""
    fast = F.sum(F.when(F.col("pitch_type").isin(FASTBALLS), 1).otherwise(0))
    mix = df.groupBy(F.col("balls").cast("int").alias("b"), F.col("strikes").cast("int").alias("s")).agg(F.count("*").alias("pitches"), F.round(F.lit(100.0) * fast / F.count("*"), 1).alias("fastball_pct"))
    return mix.orderBy(F.col("b").asc_nulls_last(), F.col("s").asc_nulls_last()).select(F.concat(F.col("b").cast("string"), F.lit("-"), F.col("s").cast("string")).alias("count"), "pitches", "fastball_pct")


def arsenal_share(df: DataFrame, most: int = 6) -> DataFrame:
    """pitch_type, n, pct of all rows (those without a type in the total only): the largest first."""
    per = df.groupBy("pitch_type").agg(F.count("*").alias("n"))
    pct = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())
    return per.withColumn("pct", pct).filter("pitch_type is not null").orderBy(F.desc("n"), "pitch_type").limit(most)


def fold_rare(df: DataFrame, least: int | None = None) -> DataFrame:
    """Types that a pitcher threw less than ``least`` times become Other. The counts are aggregated and joined back, so a busy pitcher is no hot window."""
    least = config.get("report.min_pitches_to_display") if least is None else least
    per = df.groupBy(F.col("pitcher").alias("__p"), F.col("pitch_type").alias("__t")).agg(F.count("*").alias("__n")).filter(F.col("__n") < least)
    out = df.join(per, F.col("pitcher").eqNullSafe(F.col("__p")) & F.col("pitch_type").eqNullSafe(F.col("__t")), "left")
    return out.withColumn("pitch_type", F.when(F.col("__n").isNotNull(), F.lit("Other")).otherwise(F.col("pitch_type"))).drop("__p", "__t", "__n")


def folded_arsenal(df: DataFrame, least: int | None = None) -> DataFrame:
    """pitcher, pitch_type, n, usage, rare types as Other: counts are folded, pitches are read once."""
    least = config.get("report.min_pitches_to_display") if least is None else least
    per = df.groupBy("pitcher", "pitch_type").agg(F.count("*").alias("n")).withColumn("pitch_type", F.when(F.col("n") < least, "Other").otherwise(F.col("pitch_type")))
    per = per.groupBy("pitcher", "pitch_type").agg(F.sum("n").alias("n"))
    return per.withColumn("usage", _share(["pitch_type"], ["pitcher"]))


def arsenal_summary(df: DataFrame) -> DataFrame:
    """pitcher, pitch_type, n, usage, mean_speed, mean_spin, mean_pfx_x, mean_pfx_z (movement), swings, whiff_rate (misses of swings; null without one)."""
    swung, missed = F.col("description").isin(SWINGS), F.col("description").isin(MISSES)
    per = df.groupBy("pitcher", "pitch_type").agg(
        F.count("*").alias("n"), F.avg("release_speed").alias("mean_speed"), F.avg("release_spin_rate").alias("mean_spin"),
        F.avg("pfx_x").alias("mean_pfx_x"), F.avg("pfx_z").alias("mean_pfx_z"), F.count_if(swung).alias("swings"), F.avg(F.when(swung, missed.cast("double"))).alias("whiff_rate")
    )
    return per.withColumn("usage", _share(["pitch_type"], ["pitcher"]))


# Counts ------------------------------------------------------------------------------------------------------------
def count_predictability(df: DataFrame) -> DataFrame:
    """pitcher, count, n, types, entropy: of the types thrown in the count over that of all types of the pitcher evenly mixed.

    Our choice where none is given: the base is the number of types in the pitcher's arsenal; with one type it is 0.
    """
    per = df.withColumn("count", count_label()).groupBy("pitcher", "count", "pitch_type").agg(F.count("*").alias("n"))
    arsenal = per.groupBy("pitcher").agg(F.count_distinct("pitch_type").alias("k"))
    per = per.withColumn("p", _share(["pitch_type"], ["pitcher", "count"]))
    out = per.groupBy("pitcher", "count").agg(F.sum("n").alias("n"), F.count("*").alias("types"), (-F.sum(F.col("p") * F.log("p"))).alias("e")).join(arsenal, "pitcher")
    return out.select("pitcher", "count", "n", "types", F.round(F.when(F.col("k") > 1, F.col("e") / F.log("k")).otherwise(0.0), 6).alias("entropy"))


def predictable_counts(df: DataFrame, least: int | None = None, share: float | None = None, delta: float | None = None, league: DataFrame | None = None) -> DataFrame:
    """pitcher, count, pitch_type, n, value, league, delta: a type dominates a count, well above the league's rate (that of ``df``, or LeagueBaselines.by_count)."""
    df = df.withColumn("count", count_label())
    if league is None:
        league = df.groupBy("count", "pitch_type").agg(F.count("*").alias("n")).withColumn("league", _share(["pitch_type"], ["count"])).drop("n")
    per = df.groupBy("pitcher", "count", "pitch_type").agg(F.count("*").alias("n"))
    per = per.withColumns({"value": _share(["pitch_type"], ["pitcher", "count"]), "n": F.sum("n").over(Window.partitionBy("pitcher", "count"))})
    out = per.join(league, ["count", "pitch_type"], "left").withColumn("delta", F.col("value") - F.col("league"))
    wanted = (F.col("n") >= _gate("predictable_count", least)) & (F.col("value") >= _limit("predictable_count_share", share)) & (F.col("delta") >= _limit("predictable_count_delta_vs_league", delta))
    return out.filter(wanted).select("pitcher", "count", "pitch_type", "n", "value", "league", "delta")


def first_pitch(df: DataFrame, least: int | None = None) -> DataFrame:
    """pitcher, n, top_type, top_share, strike_rate on 0-0 (ties to the smaller code)."""
    first = df.filter((F.col("balls") == 0) & (F.col("strikes") == 0))
    per = first.groupBy("pitcher", "pitch_type").agg(F.count("*").alias("n"), F.count_if(F.col("description").isin(STRIKES)).alias("k"))
    top = F.min(F.struct((-F.col("n")).alias("n"), "pitch_type"))
    out = per.groupBy("pitcher").agg(F.sum("n").alias("n"), top.alias("top"), F.sum("k").alias("k")).filter(F.col("n") >= _gate("first_pitch", least))
    return out.select("pitcher", "n", F.col("top.pitch_type").alias("top_type"), (-F.col("top.n") / F.col("n")).alias("top_share"), (F.col("k") / F.col("n")).alias("strike_rate"))


def putaway_mix(df: DataFrame) -> DataFrame:
    """pitcher, pitch_type, n, value: the mix with two strikes."""
    per = df.filter(F.col("strikes") == 2).groupBy("pitcher", "pitch_type").agg(F.count("*").alias("n"))
    return per.withColumn("value", _share(["pitch_type"], ["pitcher"]))


# Splits and league -------------------------------------------------------------------------------------------------
def handedness_gap(df: DataFrame, least: int | None = None, gap: float | None = None) -> DataFrame:
    """pitcher, pitch_type, n, usage_l, usage_r, gap: use against left and right batters apart by the threshold; n is the smaller side's pitches."""
    per = df.groupBy("pitcher", "pitch_type").pivot("stand", ["L", "R"]).agg(F.count(F.lit(1))).na.fill(0, ["L", "R"])
    w = Window.partitionBy("pitcher")
    per = per.withColumns({"nl": F.sum("L").over(w), "nr": F.sum("R").over(w)}).withColumn("n", F.least("nl", "nr"))
    per = per.filter(F.col("n") >= _gate("handedness_gap", least)).withColumns({"usage_l": F.col("L") / F.col("nl"), "usage_r": F.col("R") / F.col("nr")})
    return per.withColumn("gap", F.col("usage_l") - F.col("usage_r")).filter(F.abs("gap") >= _limit("handedness_usage_gap", gap)).select("pitcher", "pitch_type", "n", "usage_l", "usage_r", "gap")


def hittable_pitches(df: DataFrame, least: int | None = None, delta: float | None = None, league: DataFrame | None = None) -> DataFrame:
    """pitcher, pitch_type, n, value, league, delta: expected wOBA of a type above the league's of that type (in ``df``, or LeagueBaselines.by_type); n counts pitches with a value."""
    x = F.col("estimated_woba_using_speedangle")
    if league is None:
        league = df.groupBy("pitch_type").agg(F.avg(x).alias("league"))
    per = df.groupBy("pitcher", "pitch_type").agg(F.count(x).alias("n"), F.avg(x).alias("value")).filter(F.col("n") >= _gate("hittable_pitch", least))
    out = per.join(league, "pitch_type", "left").withColumn("delta", F.col("value") - F.col("league"))
    return out.filter(F.col("delta") >= _limit("hittable_pitch_xwoba_delta", delta)).select("pitcher", "pitch_type", "n", "value", "league", "delta")


def quadrant(zone: Column) -> Column:
    """Our choice where none is given: zones 1-9 are rows of three from the top left, 11-14 the corners outside; the middle row and column have no quadrant."""
    place = {1: "up-left", 3: "up-right", 7: "down-left", 9: "down-right", 11: "up-left", 12: "up-right", 13: "down-left", 14: "down-right"}
    return F.coalesce(*[F.when(zone == z, q) for z, q in place.items()], F.lit("middle"))


def location_leaks(df: DataFrame, least: int | None = None, share: float | None = None) -> DataFrame:
    """pitcher, pitch_type, quadrant, n, value: much of a type goes to one quadrant; n counts the type's located pitches."""
    per = df.filter("zone is not null").groupBy("pitcher", "pitch_type", quadrant(F.col("zone")).alias("quadrant")).agg(F.count("*").alias("n"))
    per = per.withColumns({"value": _share(["quadrant"], ["pitcher", "pitch_type"]), "n": F.sum("n").over(Window.partitionBy("pitcher", "pitch_type"))})
    return per.filter((F.col("quadrant") != "middle") & (F.col("n") >= _gate("location_leak", least)) & (F.col("value") >= _limit("location_leak_share", share)))


# Sequences ---------------------------------------------------------------------------------------------------------
def _appearance() -> Window:
    """Within a plate appearance, which is a dozen pitches: never a hot window. Pitches that clean dropped are bridged."""
    return Window.partitionBy("game_pk", "at_bat_number").orderBy("pitch_number")


def transitions(df: DataFrame, by_outcome: bool = False) -> DataFrame:
    """pitcher, previous, [outcome,] next, n, value: P(next | previous type [and what became of it]) within a plate appearance."""
    w = _appearance()
    df = df.select("pitcher", F.col("pitch_type").alias("next"), F.lag("pitch_type").over(w).alias("previous"), F.lag("description").over(w).alias("outcome")).filter("previous is not null")
    given = ["pitcher", "previous", *["outcome"] * by_outcome]
    per = df.groupBy(*given, "next").agg(F.count("*").alias("n"))
    return per.withColumn("value", _share(["next"], given))


def sequencing_tells(df: DataFrame, least: int | None = None, share: float | None = None) -> DataFrame:
    """pitcher, previous, next, n, value: transitions at or above the threshold; n counts all that follow ``previous``."""
    t = transitions(df).withColumn("n", F.sum("n").over(Window.partitionBy("pitcher", "previous")))
    return t.filter((F.col("n") >= _gate("sequencing_tell", least)) & (F.col("value") >= _limit("sequencing_tell_prob", share)))


def outings(df: DataFrame) -> DataFrame:
    """pitcher, game_pk, pitches, drop: mean speed of the first third of an outing less that of the last third.

    Our choice where none is given: thirds by order of pitches (ntile 3); outings with fewer than three pitches have none.
    """
    df = df.filter("release_speed is not null").withColumn("third", F.ntile(3).over(Window.partitionBy("pitcher", "game_pk").orderBy("at_bat_number", "pitch_number")))
    mean = lambda t: F.avg(F.when(F.col("third") == t, F.col("release_speed")))
    return df.groupBy("pitcher", "game_pk").agg(F.count("*").alias("pitches"), (mean(1) - mean(3)).alias("drop"))


def velocity_decay(df: DataFrame, least: int | None = None, drop: float | None = None) -> DataFrame:
    """pitcher, n (outings), value (mean drop of speed within an outing), from the threshold on."""
    per = outings(df).filter("drop is not null").groupBy("pitcher").agg(F.count("*").alias("n"), F.round(F.avg("drop"), 6).alias("value"))
    return per.filter((F.col("n") >= _gate("fatigue_outings", least)) & (F.col("value") >= _limit("fatigue_velo_drop_mph", drop)))


def times_through_order(df: DataFrame) -> DataFrame:
    """pitcher, time, n, mean_speed: by how often the pitcher has met the batter in that game."""
    met = F.dense_rank().over(Window.partitionBy("game_pk", "pitcher", "batter").orderBy("at_bat_number"))
    return df.withColumn("time", met).groupBy("pitcher", "time").agg(F.count("*").alias("n"), F.avg("release_speed").alias("mean_speed"))


# Takeaways ---------------------------------------------------------------------------------------------------------
def takeaways(df: DataFrame, most: int | None = None, gates: dict[str, int] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """pitcher, place, flag, detail, n, value, baseline, severity: the strongest flags of each pitcher.

    Our choice where none is given: severity is the distance from the baseline (the league's rate, else the threshold)
    over the baseline; ties go by flag and detail. Only flags get here, so a pitcher's window is short. ``gates`` and
    ``thresholds`` go before the settings of the same names.
    """
    most = config.get("report.max_takeaways") if most is None else most
    # Eight flags read these columns, so what they come from is planned and computed once.
    df = saved(df.select("pitcher", "batter", "game_pk", "at_bat_number", "pitch_number", "balls", "strikes", "pitch_type", "description", "stand", "zone", "release_speed", "estimated_woba_using_speedangle"), "takeaways")
    n, at = (gates or {}).get, lambda name: _limit(name, (thresholds or {}).get(name))

    def flag(name: str, rows: DataFrame, detail: list[str], value: str, baseline: Column) -> DataFrame:
        return rows.select("pitcher", F.lit(name).alias("flag"), F.concat_ws(" ", *detail).alias("detail"), F.col("n").cast("long").alias("n"), F.col(value).alias("value"), baseline.cast("double").alias("baseline"))

    limit = lambda name: F.lit(at(name))
    first = first_pitch(df, n("first_pitch"))
    counts = predictable_counts(df, n("predictable_count"), at("predictable_count_share"), at("predictable_count_delta_vs_league"))
    flags = [
        flag("predictable_count", counts, ["count", "pitch_type"], "value", F.col("league")),
        flag("handedness_gap", handedness_gap(df, n("handedness_gap"), at("handedness_usage_gap")).withColumn("size", F.abs("gap")), ["pitch_type"], "size", limit("handedness_usage_gap")),
        flag("hittable_pitch", hittable_pitches(df, n("hittable_pitch"), at("hittable_pitch_xwoba_delta")), ["pitch_type"], "value", F.col("league")),
        flag("velocity_decay", velocity_decay(df, n("fatigue_outings"), at("fatigue_velo_drop_mph")), [], "value", limit("fatigue_velo_drop_mph")),
        flag("sequencing_tell", sequencing_tells(df, n("sequencing_tell"), at("sequencing_tell_prob")), ["previous", "next"], "value", limit("sequencing_tell_prob")),
        flag("location_leak", location_leaks(df, n("location_leak"), at("location_leak_share")), ["pitch_type", "quadrant"], "value", limit("location_leak_share")),
        flag("first_pitch", first.filter(F.col("top_share") >= limit("first_pitch_share")), ["top_type"], "top_share", limit("first_pitch_share")),
        flag("few_first_strikes", first.filter(F.col("strike_rate") < limit("first_pitch_strike_rate_low")), [], "strike_rate", limit("first_pitch_strike_rate_low")),
    ]
    found = reduce(DataFrame.unionByName, flags).withColumn("severity", F.round(F.abs(F.col("value") - F.col("baseline")) / F.col("baseline"), 6))
    place = F.row_number().over(Window.partitionBy("pitcher").orderBy(F.desc("severity"), "flag", "detail"))
    return found.withColumn("place", place).filter(F.col("place") <= most)
