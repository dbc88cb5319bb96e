"""The pitch store: typed Parquet files with zone maps, keyed upserts, an appended fetch log, and a numbered log of snapshots for both."""

from __future__ import annotations

import datetime as dt
import json
import logging
import re
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundline import config
from moundline.functions.coercion import coerce
from moundline.operators.dedup import keep_last
from moundline.schema import CHRONOLOGICAL, FETCH_LOG, LOG_KEY, PITCH_KEY, PITCHES
from moundline.session import compiled

log = logging.getLogger(__name__)

#: The column that says in which order rows arrived; sources stamp it, the store drops it.
ORDINAL = "_ordinal"


#: Files of a season from which on they are put together again, rows of a file that this makes, pieces of the fetch log of one size that are.
MANY_FILES, FILE_ROWS, MANY_PIECES = 32, 2_000_000, 8
#: Times that a write starts anew because others were faster; snapshots that are kept.
ATTEMPTS, KEPT = 20, 10


class KeyViolation(ValueError):
    """A key column is null or a key occurs twice."""


class Conflict(RuntimeError):
    """Other writers were faster too often."""


def is_fresh(now: dt.datetime, ttl_days: float) -> Column:
    """Over rows of the fetch log: without rows never, past seasons always, else if younger than the time to live."""
    age = F.timestamp_diff("SECOND", F.col("fetched_at"), F.lit(now).cast("timestamp_ntz"))
    current = F.when(F.col("season") < now.year, True).otherwise(age < ttl_days * 86_400)
    return F.coalesce(F.when(F.col("row_count") == 0, False).otherwise(current), F.lit(False))


def summary(fetch_log: DataFrame, pitches: DataFrame) -> DataFrame:
    """The log with the largest player_name of each entry's pitches, the latest fetch first.

    Pitches are reduced to one row a pitcher and season before the join, so no log row fans out.
    """
    names = pitches.groupBy(F.col("pitcher").alias("mlbam_id"), F.col("game_year").alias("season")).agg(F.max("player_name").alias("player_name"))
    return fetch_log.join(names, ["mlbam_id", "season"], "left").select(*FETCH_LOG.fieldNames(), "player_name").orderBy(F.desc("fetched_at"))


def chronological(pitches: DataFrame) -> DataFrame:
    return pitches.orderBy(*[F.col(c).asc_nulls_last() for c in CHRONOLOGICAL])


def pitcher_season(pitches: DataFrame, mlbam_id: int, season: int) -> DataFrame:
    return chronological(pitches.filter((F.col("pitcher") == mlbam_id) & (F.col("game_year") == season)))


class PitchStore:
    """Opens a store under ``path`` (any file system that Spark reads), making an empty one if there is none.

    A snapshot names the files of both tables: of the pitches with their zones (season, rows, range of games, range of
    pitchers), of the fetch log with their rows, and the last batch of each stream. Snapshots are numbered and never
    change; a write makes files beside the others and then the next snapshot, which fails if another writer has made
    that number first. Then it starts anew from the newer one, reusing what is still right. So readers see all of a write or nothing, pitches and log
    together, and no writer undoes another's.

    Only files that can hold a written key by their zone are looked into, for keys alone, and only those that do are
    rewritten. Files that went out of use are deleted by the write after the next one, as someone may still read them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, clock: Callable[[], dt.datetime] = dt.datetime.now):
        self.spark, self.root, self.clock = spark, (path or config.resolve_path("data.store_path")).rstrip("/"), clock
        if not self._versions():
            self._commit(0, {"files": [], "log": [], "batches": {}, "gone": []})

    # Files -------------------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at, hadoop.Path

    def _delete(self, path: str) -> None:
        fs, at, _ = self._fs(f"{self.root}/{path}")
        fs.delete(at, True)

    def _versions(self) -> list[int]:
        fs, at, _ = self._fs(f"{self.root}/snapshots")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def snapshot(self) -> tuple[int, dict]:
        """The number of the newest snapshot, and what it says."""
        version = self._versions()[-1]
        text = self.spark.read.text(f"{self.root}/snapshots/{version:012}.json", wholetext=True).first().value
        return version, json.loads(text)

    def _commit(self, version: int, state: dict) -> bool:
        """Makes snapshot ``version``; false if there is one already. What is seen under its name is whole."""
        fs, tmp, Path = self._fs(f"{self.root}/snapshots/{uuid.uuid4().hex}.tmp")
        final = Path(f"{self.root}/snapshots/{version:012}.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.getScheme() == "file":  # a local rename would replace; a link does not
            files, local = self.spark._jvm.java.nio.file.Files, lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                files.createLink(local(final), local(tmp))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
                return False
            finally:
                fs.delete(tmp, False)
            return True
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, final, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def _read(self, schema: T.StructType, files: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f['path']}" for f in files]) if files else self.spark.createDataFrame([], schema)

    # Reading -----------------------------------------------------------------------------------------------------
    @property
    def pitches(self) -> DataFrame:
        return self._read(PITCHES, self.snapshot()[1]["files"])

    @property
    def fetch_log(self) -> DataFrame:
        """The latest entry of each key; entries are numbered by their snapshots."""
        return self._latest(self.snapshot()[1]["log"]).select(*FETCH_LOG.fieldNames())

    def _latest(self, pieces: list[dict]) -> DataFrame:
        rest = [f for f in _NUMBERED.fieldNames() if f not in LOG_KEY]
        latest = self._read(_NUMBERED, pieces).groupBy(*LOG_KEY).agg(F.max_by(F.struct(*rest), F.struct("number", "fetched_at")).alias("e"))
        return latest.select(*LOG_KEY, "e.*").select(*_NUMBERED.fieldNames())

    def files_of(self, season: int | None = None, pitcher: int | None = None, games: tuple[int, int] | None = None) -> list[dict]:
        """Files whose zones allow rows of that season, pitcher or range of games."""
        return _within(self.snapshot()[1]["files"], season, pitcher, games)

    def load_pitcher_season(self, mlbam_id: int, season: int) -> DataFrame:
        """A pitcher's season in order of play; only files whose zones allow both are opened."""
        return pitcher_season(self._read(PITCHES, self.files_of(season, mlbam_id)), mlbam_id, season)

    def cache_summary(self) -> DataFrame:
        return summary(self.fetch_log, self.pitches)

    def is_cached(self, mlbam_id: int, season: int, player_type: str = "pitcher") -> bool:
        mine = self.fetch_log.filter((F.col("mlbam_id") == mlbam_id) & (F.col("season") == season) & (F.col("player_type") == player_type))
        return bool(mine.select(is_fresh(self.clock(), config.get("data.cache_ttl_days")).alias("fresh")).filter("fresh").limit(1).collect())

    def sql(self, text: str, *args) -> DataFrame:
        """Any Spark SQL over {pitches} and {fetch_log}, or without the braces, with ``?`` for parameters. Views that the session has stay as they are."""
        names = {"pitches": self.pitches, "fetch_log": self.fetch_log}
        bare = re.sub(r"(?<![\w.`{])(pitches|fetch_log)(?![\w`}])", r"{\1}", text) if "{pitches}" not in text and "{fetch_log}" not in text else text
        return self.spark.sql(bare, args=list(args) or None, **{n: df for n, df in names.items() if "{" + n + "}" in bare})

    # Writing -----------------------------------------------------------------------------------------------------
    def save_pitches(self, df: DataFrame, mlbam_id: int, season: int, player_type: str = "pitcher") -> int:
        """Puts cleaned pitches in, replacing those of the same key, and logs the fetch, both at once; the number of rows kept.

        Of rows with one key the last by ``_ordinal`` stays (without that column, by all columns). Stored pitches that
        the frame lacks stay. An empty frame is logged with 0 rows and touches nothing. Missing columns, null keys and
        integers out of range are errors that leave the store as it was.
        """
        if df.isEmpty():
            self._write([], [(mlbam_id, season, player_type, 0)])
            return 0
        staged = self._stage(df)
        kept = sum(f["rows"] for f in staged)
        self._write(staged, [(mlbam_id, season, player_type, kept)])
        return kept

    def save_batch(self, df: DataFrame, player_type: str = "pitcher", batch: tuple[str, int] | None = None) -> int:
        """As save_pitches for many players and seasons in one write; the log gets an entry for each of them.

        ``batch`` is the name of a stream and the number of its batch: one that the store has had is skipped.
        """
        if batch and self.snapshot()[1]["batches"].get(batch[0], -1) >= batch[1]:
            return 0
        staged = self._stage(df) if not df.isEmpty() else []
        entries = self._read(PITCHES, staged).groupBy(F.col("pitcher").alias("mlbam_id"), F.col("game_year").alias("season")).agg(F.count("*").cast("int").alias("row_count"))
        self._write(staged, entries.filter("mlbam_id is not null and season is not null").withColumn("player_type", F.lit(player_type)), batch)
        return sum(f["rows"] for f in staged)

    def _stage(self, df: DataFrame) -> list[dict]:
        """Writes the rows to be, checked, as files that no snapshot names yet."""
        lost = [c for c in PITCHES.fieldNames() if c not in df.columns]
        if lost:
            raise ValueError(f"not a cleaned pitch table, as it has no {', '.join(lost)}")
        order = [ORDINAL] if ORDINAL in df.columns else PITCHES.fieldNames()
        typed = coerce(df.select(*PITCHES.fieldNames(), *[c for c in order if c == ORDINAL]), PITCHES)
        seen = Observation()  # counted on the way, so the source is read once
        keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in PITCH_KEY])
        counts = F.count(F.lit(1)).alias("n"), F.count_if(keyless).alias("bad")
        staged = self._files(keep_last(typed.observe(seen, *counts), PITCH_KEY, order).select(*PITCHES.fieldNames()))
        if seen.get["bad"]:
            self._forget(staged)
            raise KeyViolation(f"{seen.get['bad']} rows without a key")
        kept = sum(f["rows"] for f in staged)
        if kept < seen.get["n"]:
            log.warning("dropped %s rows of repeated keys", seen.get["n"] - kept)
        return staged

    def _files(self, rows: DataFrame) -> list[dict]:
        """Writes rows by season, in ranges of pitchers; the files with their zones."""
        made = f"pitches/{uuid.uuid4().hex}"
        season = F.coalesce(F.col("game_year").cast("string"), F.lit("none"))
        ranged = rows.withColumn("_season", season).repartitionByRange("_season", "pitcher", "game_pk").sortWithinPartitions("_season", "pitcher", *CHRONOLOGICAL)
        with compiled(self.spark):
            ranged.write.partitionBy("_season").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/{made}")
        fs, at, _ = self._fs(f"{self.root}/{made}")
        if not any(f.isDirectory() for f in fs.listStatus(at)):
            return []
        stored = self.spark.read.schema(PITCHES).option("recursiveFileLookup", True).parquet(f"{self.root}/{made}")
        zone = [F.count("*"), F.min("game_year"), F.min("game_pk"), F.max("game_pk"), F.min("pitcher"), F.max("pitcher")]
        zones = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(*zone).collect()
        return sorted(({"path": f"{made}/{f.rsplit('/', 2)[-2]}/{f.rsplit('/', 1)[-1]}", "season": y, "rows": n, "games": [a, b], "pitchers": [c, d]} for f, n, y, a, b, c, d in zones), key=lambda f: f["path"])

    def _forget(self, files: list[dict]) -> None:
        for made in {"/".join(f["path"].split("/")[:2]) for f in files}:
            self._delete(made)

    def _merge(self, state: dict, staged: list[dict]) -> tuple[list[dict], list[dict]]:
        """The files of a snapshot that hold staged keys, and those that have their other rows."""
        new = self._read(PITCHES, staged).select(*PITCH_KEY)
        near = [f for f in state["files"] if any(s["games"][0] <= f["games"][1] and f["games"][0] <= s["games"][1] for s in staged)]
        if not near:
            return [], []
        file = F.col("_metadata.file_path")
        hit = self._read(PITCHES, near).select(*PITCH_KEY, file.alias("file")).join(new, PITCH_KEY, "left_semi").select("file").distinct().collect()
        ends = {"/".join(r.file.rsplit("/", 3)[1:]) for r in hit}
        held = [f for f in near if f["path"].split("/", 1)[1] in ends]
        return held, self._files(self._read(PITCHES, held).join(new, PITCH_KEY, "left_anti")) if held else []

    def _write(self, staged: list[dict], entries: list[tuple] | DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Commits staged files and log entries as the next snapshot, on top of whatever the newest one is."""
        held, others, looked_at = [], [], None
        for _ in range(ATTEMPTS):
            version, state = self.snapshot()
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                self._forget(staged + others)
                return
            try:
                if staged and looked_at != state["files"]:
                    self._forget(others)
                    held, others = self._merge(state, staged)
                    looked_at = state["files"]
                pieces, dropped = self._logged(state["log"], entries, version + 1)
            except Exception:
                if self._versions()[-1] > version + 1:  # files of an older snapshot may be gone meanwhile
                    looked_at, others = None, []
                    continue
                raise
            files = [f for f in state["files"] if f not in held] + others + staged
            gone = [f["path"] for f in held + dropped]
            batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._commit(version + 1, {"files": files, "log": pieces, "batches": batches, "gone": gone}):
                for path in state["gone"]:
                    self._delete(path)
                for old in self._versions()[:-KEPT]:
                    self._delete(f"snapshots/{old:012}.json")
                break
            self._forget([p for p in pieces if p not in state["log"]])
        else:
            self._forget(staged + others)
            raise Conflict(f"not written after {ATTEMPTS} attempts")
        self._compact({f["season"] for f in staged})

    def _logged(self, pieces: list[dict], entries: list[tuple] | DataFrame, number: int) -> tuple[list[dict], list[dict]]:
        """The pieces of the log with one of new entries, those of about one size put together where they are many; and those that went out of use."""
        if isinstance(entries, list):
            entries = self.spark.createDataFrame(entries, _ENTRY) if entries else None
        if entries is None:
            return pieces, []
        new = self._piece(entries.withColumns({"fetched_at": F.lit(self.clock()).cast("timestamp_ntz"), "number": F.lit(number).cast("long")}).select(*_NUMBERED.fieldNames()), 1)
        for piece in new:
            if not piece["rows"]:  # as of a batch without rows
                self._delete(piece["path"])
        pieces, dropped = pieces + [f for f in new if f["rows"]], []
        size = lambda f: f["rows"].bit_length() // 3
        while pieces:
            alike = [f for f in pieces if size(f) == size(pieces[-1])]
            if len(alike) < MANY_PIECES:
                break
            pieces = [f for f in pieces if f not in alike] + self._piece(self._latest(alike), 1 + sum(f["rows"] for f in alike) // FILE_ROWS)
            dropped += alike
        return pieces, dropped

    def _piece(self, rows: DataFrame, parts: int) -> list[dict]:
        path = f"fetch_log/{uuid.uuid4().hex}"
        seen = Observation()
        rows.coalesce(parts).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
        return [{"path": path, "rows": seen.get["n"]}]

    def _compact(self, seasons: set) -> None:
        """Puts the files of seasons that have many together again; gives way to any other write."""
        version, state = self.snapshot()
        many = {y for y in seasons if sum(f["season"] == y and f["rows"] < FILE_ROWS // 2 for f in state["files"]) >= MANY_FILES}
        if not many:
            return
        old = [f for f in state["files"] if f["season"] in many]
        new = self._files(self._read(PITCHES, old))
        # What the write before replaced stays until the next one, as after any write.
        if not self._commit(version + 1, state | {"files": [f for f in state["files"] if f not in old] + new, "gone": state["gone"] + [f["path"] for f in old]}):
            self._forget(new)


#: Entries of the fetch log with the number of the snapshot that they came with, and without number and time.
_NUMBERED = T.StructType([*FETCH_LOG.fields, T.StructField("number", T.LongType())])
_ENTRY = T.StructType([f for f in FETCH_LOG.fields if f.name != "fetched_at"])


def _within(files: list[dict], season: int | None = None, pitcher: int | None = None, games: tuple[int, int] | None = None) -> list[dict]:
    def fits(f: dict) -> bool:
        return (
            (season is None or f["season"] == season)
            and (pitcher is None or (f["pitchers"][0] is not None and f["pitchers"][0] <= pitcher <= f["pitchers"][1]))
            and (games is None or (games[0] <= f["games"][1] and f["games"][0] <= games[1]))
        )

    return [f for f in files if fits(f)]
