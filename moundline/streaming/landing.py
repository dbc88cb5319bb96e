"""An extension: the landing folder as a stream whose micro-batches are cleaned and put into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from moundline.functions.coercion import nullified
from moundline.operators.clean import prepare_for_storage
from moundline.schema import FIELDS
from moundline.sources.landing import numeric_counts
from moundline.sources.store import ORDINAL, PitchStore

RAW = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])


def stream_landing(spark: SparkSession, path: str, columns: T.StructType = RAW) -> DataFrame:
    """New CSV files of a folder, untyped, missing tokens as NULL. A file whose header is not ``columns`` in this order is an error; land() takes such ones."""
    df = spark.readStream.schema(columns).options(header=True, enforceSchema=False).csv(path)
    return df.withColumns({c: nullified(c, T.StringType()) for c in df.columns})


def ingest(store: PitchStore, raw: DataFrame, checkpoint: str, player_type: str = "pitcher") -> StreamingQuery:
    """Upserts each micro-batch once: its number goes into the store's snapshot, so one that runs again is skipped. The fetch log gets an entry for each season in it."""

    def put(batch: DataFrame, number: int) -> None:
        rows = numeric_counts(batch.withColumn(ORDINAL, F.monotonically_increasing_id()))
        store.save_batch(prepare_for_storage(rows, keep=(ORDINAL,)), player_type, (checkpoint, number))

    return raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
