"""League baselines kept up by difference: partial sums of each file of a store, merged when read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundline.operators.clean import count_label
from moundline.schema import PITCHES
from moundline.sources.store import PitchStore

#: Pieces of partial sums from which on they are put together.
MANY = 16
PARTIAL = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("count", T.StringType()), T.StructField("pitch_type", T.StringType())]
    + [T.StructField("n", T.LongType()), T.StructField("valued", T.LongType()), T.StructField("value", T.DoubleType())]
)


class LeagueBaselines:
    """Beside a store, for each of its files: pitches, and number and sum of expected wOBA, by season, count and type.

    A file never changes, so its sums hold as long as a snapshot names it. refresh() reads the files that are new
    since the last time and nothing else; files that went out of use are left out when reading. Sums of one file may
    be there twice, when two sessions were at it or one broke off: they are the same rows then, and count once.
    """

    def __init__(self, store: PitchStore):
        self.store, self.spark, self.root = store, store.spark, f"{store.root}/baselines"

    def _pieces(self) -> list[str]:
        fs, at, _ = self.store._fs(self.root)
        return sorted(str(f.getPath()) for f in fs.listStatus(at) if self.store._fs(f"{f.getPath()}/_SUCCESS")[0].exists(self.store._fs(f"{f.getPath()}/_SUCCESS")[1])) if fs.exists(at) else []

    def _partials(self, pieces: list[str]) -> DataFrame:
        return self.spark.read.schema(PARTIAL).parquet(*pieces) if pieces else self.spark.createDataFrame([], PARTIAL)

    def refresh(self) -> list[str]:
        """Adds the sums of files that have none yet; their paths."""
        current, pieces = [f["path"] for f in self.store.snapshot()[1]["files"]], self._pieces()
        known = {r.file for r in self._partials(pieces).select("file").distinct().collect()}
        new = [p for p in current if p not in known]
        if new:
            x = F.col("estimated_woba_using_speedangle")
            rows = self.spark.read.schema(PITCHES).parquet(*[f"{self.store.root}/{p}" for p in new])
            file = F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -4, 4), "/")  # as the snapshot names it
            sums = rows.groupBy(file.alias("file"), F.col("game_year").alias("season"), count_label().alias("count"), "pitch_type").agg(F.count("*").alias("n"), F.count(x).alias("valued"), F.sum(x).alias("value"))
            sums.select(*PARTIAL.fieldNames()).coalesce(1).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        if len(pieces) >= MANY:  # the old ones go once the new one is there
            self._current(current, pieces).coalesce(1).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
            for piece in pieces:
                fs, at, _ = self.store._fs(piece)
                fs.delete(at, True)
        return new

    def _current(self, files: list[str], pieces: list[str]) -> DataFrame:
        named = self.spark.createDataFrame([(p,) for p in files], "file string")
        return self._partials(pieces).join(named, "file", "left_semi").dropDuplicates(["file", "season", "count", "pitch_type"]).select(*PARTIAL.fieldNames())

    def sums(self, season: int | None = None) -> DataFrame:
        """season, count, pitch_type, n, valued, value of the store as it is now."""
        self.refresh()
        rows = self._current([f["path"] for f in self.store.files_of(season)], self._pieces())
        return rows.groupBy("season", "count", "pitch_type").agg(F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.sum("value").alias("value"))

    def by_count(self, season: int | None = None) -> DataFrame:
        """count, pitch_type, league: the share of a type in a count, for metrics.predictable_counts."""
        per = self.sums(season).groupBy("count", "pitch_type").agg(F.sum("n").alias("n"))
        return per.join(per.groupBy("count").agg(F.sum("n").alias("all")), "count").select("count", "pitch_type", (F.col("n") / F.col("all")).alias("league"))

    def by_type(self, season: int | None = None) -> DataFrame:
        """pitch_type, league: mean expected wOBA of a type, for metrics.hittable_pitches."""
        per = self.sums(season).groupBy("pitch_type").agg(F.sum("valued").alias("k"), F.sum("value").alias("x"))
        return per.select("pitch_type", F.when(F.col("k") > 0, F.col("x") / F.col("k")).alias("league"))
