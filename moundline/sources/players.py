"""Players by name: a register as a DataFrame, one answer or a clear error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moundline.functions.names import strip_accents, strip_accents_column, title


class PlayerNotFound(Exception):
    """No player, or more than one, goes by the name."""


@dataclass(frozen=True)
class Player:
    mlbam_id: int
    first_name: str
    last_name: str
    first_season: int | None = None
    last_season: int | None = None

    @property
    def full_name(self) -> str:
        return title(f"{self.first_name} {self.last_name}")


def resolve_player(register: DataFrame, name: str) -> Player:
    """The player whose first and last name these are, without regard to accents and case.

    Of several the one who played last wins; if that is not known or two did, the error lists five at most.
    ``register``: key_mlbam, name_first, name_last, mlb_played_first, mlb_played_last; rows without key_mlbam are left out.
    """
    words = strip_accents(name.strip()).lower().split()
    if len(words) < 2:
        raise PlayerNotFound(f"a first and a last name are needed, not {name!r}")
    plain = lambda c: F.lower(strip_accents_column(c))
    asked = lambda text: plain(F.lit(text))  # noqa: E731  the name by the same rule as the register
    found = register.filter(F.col("key_mlbam").isNotNull() & (plain(F.col("name_first")) == asked(words[0])) & (plain(F.col("name_last")) == asked(" ".join(words[1:]))))
    seasons = [F.col(c).cast("double").cast("int").alias(c) for c in ("mlb_played_first", "mlb_played_last")]
    rows = found.select(F.col("key_mlbam").cast("long").alias("key_mlbam"), "name_first", "name_last", *seasons).orderBy(F.col("mlb_played_last").desc_nulls_last(), "key_mlbam").limit(5).collect()
    if not rows:
        raise PlayerNotFound(f"no player is called {name!r}")
    if len(rows) > 1 and (rows[0].mlb_played_last is None or rows[0].mlb_played_last == rows[1].mlb_played_last):
        years = lambda y: "?" if y is None else str(y)
        options = ", ".join(f"{r.name_first} {r.name_last} ({years(r.mlb_played_first)}-{years(r.mlb_played_last)}, id={r.key_mlbam})" for r in rows)
        raise PlayerNotFound(f"{name!r} may be any of: {options}")
    return Player(*rows[0])


def latest_by_name(register: DataFrame, most: int = 5) -> DataFrame:
    """name_first, name_last (without accents, in lower case), key_mlbam, ambiguous, candidates: what resolve_player gives for all names at once.

    Of players of one name the one who played last is key_mlbam (with the smallest id, if several did, or none is
    known to); the name is ambiguous where resolve_player refuses it. candidates: ``most`` of the ids at most, the last
    to play first. A null name is a name of its own. One shuffle by name; each task sends ``most`` players a name.
    """
    plain = lambda c: F.lower(strip_accents_column(c)).alias(c)
    keyed = register.filter("key_mlbam is not null").select(plain("name_first"), plain("name_last"), F.col("key_mlbam").cast("long").alias("id"), F.col("mlb_played_last").cast("double").cast("int").alias("last"))
    name = Window.partitionBy("name_first", "name_last").orderBy(F.col("last").desc_nulls_last(), "id")
    # Spark keeps `most` rows a name (WindowGroupLimit) before it shuffles.
    top = keyed.withColumn("place", F.row_number().over(name)).filter(F.col("place") <= most)
    out = top.groupBy("name_first", "name_last").agg(F.sort_array(F.collect_list(F.struct("place", "id", "last"))).alias("c"))
    tied = (F.size("c") > 1) & (F.col("c")[0]["last"].isNull() | F.coalesce(F.col("c")[0]["last"] == F.get("c", F.lit(1))["last"], F.lit(False)))
    return out.select("name_first", "name_last", F.col("c")[0]["id"].alias("key_mlbam"), tied.alias("ambiguous"), F.col("c.id").alias("candidates"))
