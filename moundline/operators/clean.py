"""Cleaning as DataFrame transforms; chain them with ``df.transform``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundline import config
from moundline.schema import FOLDED, NAMES, NO_CONTEST_CODES, NO_CONTEST_DESCRIPTIONS, PITCHES, REQUIRED


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """The table's value, or the value itself where there is none; null stays null."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), c)


def consolidate_pitch_types(df: DataFrame) -> DataFrame:
    """Folds deprecated codes, and adds pitch_display, the name or else the code."""
    df = df.withColumn("pitch_type", looked_up(F.col("pitch_type"), FOLDED))
    return df.withColumn("pitch_display", looked_up(F.col("pitch_type"), NAMES))


def drop_non_competitive(df: DataFrame) -> DataFrame:
    """Drops pitches without a type and those that are no contest by type or description. A null description stays."""
    by_description = F.coalesce(F.col("description").isin(NO_CONTEST_DESCRIPTIONS), F.lit(False))
    # One condition for null (not in a list: null), empty and codes, as Spark puts the whole expression of the type in place of each mention.
    return df.filter(~F.col("pitch_type").isin("", *NO_CONTEST_CODES) & ~by_description)


def filter_game_types(df: DataFrame, game_types: list[str] | None = None) -> DataFrame:
    """Keeps the given game types, those of the settings if None; null goes, and an empty list keeps nothing."""
    return df.filter(F.col("game_type").isin(config.get("data.game_types") if game_types is None else game_types))


def count_label(balls: str = "balls", strikes: str = "strikes") -> Column:
    """balls-strikes, cut off to integers; null if either is."""
    return F.concat(F.col(balls).cast("int").cast("string"), F.lit("-"), F.col(strikes).cast("int").cast("string"))


def add_count_state(df: DataFrame) -> DataFrame:
    """Drops counts that cannot be (judged before any rounding) and adds count and its four flags."""
    balls, strikes = F.col("balls"), F.col("strikes")
    df = df.filter(balls.between(0, 3) & strikes.between(0, 2))
    return df.withColumns({"count": count_label(), "is_ahead": strikes > balls, "is_behind": balls > strikes, "is_two_strike": strikes == 2, "is_first_pitch": (balls == 0) & (strikes == 0)})


def parsed_date(c: Column) -> Column:
    """A timestamp without zone; text that is no date raises, null passes. Evaluated on the rows that are left only."""
    parsed = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c))
    checked = F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c)))
    return F.coalesce(checked.cast("timestamp"), parsed).cast("timestamp_ntz")


def prepare_for_storage(df: DataFrame, game_types: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole cleaning: exactly the columns of the stored table, in order, missing ones null; then those in ``keep``, such as the order of arrival.

    Balls and strikes are not rounded here; the store does so.
    """
    lost = [c for c in REQUIRED if c not in df.columns]
    if lost:
        raise ValueError(f"columns missing: {lost}")
    # Codes are folded after rows are dropped, which no folded code changes: else each test of the filter holds the lookup too.
    df = df.transform(drop_non_competitive).transform(filter_game_types, game_types).transform(consolidate_pitch_types).transform(add_count_state)
    date = parsed_date(F.col("game_date")) if dict(df.dtypes)["game_date"] == "string" else F.col("game_date").cast("timestamp_ntz")
    df = df.withColumn("game_date", date)
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PITCHES], *keep)
