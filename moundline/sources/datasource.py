"""The remote source as a table: spark.read.format("moundline") after register(spark), with pitcher, batter and season pushed into the requests."""

from __future__ import annotations

import csv
import importlib
import io
import time
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from moundline import config
from moundline.functions.coercion import NA_TOKENS
from moundline.schema import FIELDS
from moundline.sources.landing import BadSource, header_names
from moundline.sources.remote import RateLimit, fetch_player_season, http

#: Columns that requests are made of, besides which all are text, as in landed files.
ASKED = {"pitcher": T.LongType(), "batter": T.LongType(), "game_year": T.IntegerType()}
SCHEMA = T.StructType([T.StructField(c, ASKED.get(c, T.StringType())) for c in FIELDS])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PitchSource)


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PitchSource(DataSource):
    """One season of a player for each combination of the filters ``game_year = ...`` (or in) and ``pitcher = ...`` or ``batter = ...`` (or in).

    Options, those of the settings where they are not given: endpoint, timeout, tries, gap (seconds between requests);
    transport and fallback ("module:function") in place of the default request and, if all tries fail, of the date-range source.
    """

    @classmethod
    def name(cls) -> str:
        return "moundline"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        own = self.options
        transport = own.get("transport")
        return PitchReader(
            schema.fieldNames(), transport, own.get("fallback"), own.get("endpoint") or config.get("data.endpoint"), float(own.get("timeout") or config.get("data.request_timeout_seconds", 120)),
            int(own.get("tries") or config.get("data.max_retries", 3)), float(own.get("gap") or config.get("data.seconds_between_requests", 3)),
        )


class PitchReader(DataSourceReader):
    """Reads all seasons in one task, whatever their number, as one rate limit holds for all requests."""

    def __init__(self, columns: list[str], transport: str | None, fallback: str | None, endpoint: str | None, timeout: float, tries: int, gap: float):
        self.columns, self.transport, self.fallback, self.endpoint, self.timeout, self.tries, self.gap = columns, transport, fallback, endpoint, timeout, tries, gap
        self.wanted: dict[str, list[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name that Spark calls
        """Takes the filters that make requests, and hands the others back to Spark; of two on one column what both allow."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ASKED:
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = sorted(v for v in set(values) if v is not None and (name not in self.wanted or v in self.wanted[name]))

    def partitions(self) -> list[InputPartition]:
        if "game_year" not in self.wanted or not self.wanted.keys() & {"pitcher", "batter"}:
            raise BadSource("the source is asked by season and player: filter by game_year and by pitcher or batter, with = or in")
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        transport = _named(self.transport) if self.transport else partial(http, endpoint=self.endpoint)
        fallback = _named(self.fallback) if self.fallback else None
        limit = RateLimit(self.gap)
        kind = "pitcher" if "pitcher" in self.wanted else "batter"
        for player in self.wanted[kind]:
            for season in self.wanted["game_year"]:
                text = fetch_player_season(player, season, kind, transport, fallback, limit, time.sleep, self.tries, self.timeout)
                yield from self._rows(text)

    def _rows(self, text: str) -> Iterator[tuple]:
        """Rows by the header of the answer, that the filters allow: a source by dates may give more than was asked for."""
        header, _, rest = text.lstrip("\r\n").partition("\n")
        names = header_names(header.rstrip("\r"))
        at = [names.index(c) if c in names else None for c in self.columns]
        lost = [c for c in self.wanted if c not in names]
        if lost and rest.strip():
            raise BadSource(f"columns missing: {lost}")
        for fields in csv.reader(io.StringIO(rest)):
            if not fields:
                continue
            if len(fields) != len(names):
                raise BadSource(f"a row of {len(fields)} fields under a header of {len(names)}")
            values = dict(zip(names, fields, strict=True))
            if all(_whole(values[c]) in allowed for c, allowed in self.wanted.items()):
                yield tuple(None if i is None or fields[i].strip() in NA_TOKENS else _whole(fields[i]) if c in ASKED else fields[i] for c, i in zip(self.columns, at, strict=True))


def _whole(text: str) -> int | None:
    try:
        return int(float(text))
    except ValueError:
        return None
