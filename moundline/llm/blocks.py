"""Work on the pairs of a group in blocks of bounded size, and streams of sorted groups in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundline.llm.common import tasks_for, written


def in_blocks(rows: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """``rows`` of groups of two or more, each once for every block it takes part in: ca, cb and side are added.

    A group of n rows is dealt into ceil(n / size) chunks by the hash of ``member``; each two chunks ca <= cb meet in one
    block, rows of ca on side 0 and those of cb on side 1 (side 0 alone where they are the same chunk). So a block has
    about 2 * size rows however large its group is, and every pair of a group meets in exactly one block.
    """
    # Written, so that the join stands between two exchanges and Spark splits a hot group.
    sizes = written(rows.groupBy(*group).agg(F.count("*").alias("__n")).filter("__n > 1"), "group-sizes")
    chunks = F.ceil(F.col("__n") / size).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit("chunk")), F.col("__chunks")).cast("int")
    dealt = rows.join(sizes, group).withColumn("__chunks", chunks).withColumn("__own", own)
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    return dealt.withColumns({"ca": F.least("__own", "__other"), "cb": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")}).drop("__n", "__chunks", "__own", "__other")


def in_chunks(rows: DataFrame, sizes: DataFrame, group: list[str], member: str, size: int) -> DataFrame:
    """The blocks of in_blocks() in which a chunk meets itself: each row once. ``sizes`` has the groups and __n, which rows get too; chunks are dealt anew in each."""
    dealt = rows.join(sizes, group).withColumn("ca", F.pmod(F.xxhash64(member, *group), F.ceil(F.col("__n") / size).cast("int")).cast("int"))
    return dealt.withColumns({"cb": F.col("ca"), "side": F.lit(0)})


def across_labels(rows: DataFrame, group: list[str], member: str, label: str, size: int) -> DataFrame:
    """``rows`` in blocks, as by in_blocks(), in which every two rows of a group with different labels meet.

    Rows of a group's most frequent label have chunks of their own, which don't meet each other. So a group of n rows, r of
    them with other labels, makes about 2 * n * r / size + n rows, and none if it has one label.
    """
    counts = rows.groupBy(*group, label).agg(F.count("*").alias("__c")).groupBy(*group).agg(F.max(F.struct("__c", label)).alias("__top"), F.sum("__c").alias("__n"))
    # Written, as in in_blocks().
    counts = written(counts.filter("__n > __top.__c"), "label-counts")
    most = F.ceil(F.col("__top.__c") / size).cast("int")
    others = F.ceil((F.col("__n") - F.col("__top.__c")) / size).cast("int")
    dealt = rows.join(counts, group).withColumns({"__most": most, "__others": others, "__main": F.col(label) == F.col(f"__top.{label}"), "__h": F.xxhash64(member, *group)})
    own = F.when(F.col("__main"), F.pmod("__h", "__most")).otherwise(F.col("__most") + F.pmod("__h", "__others")).cast("int")
    first = F.when(F.col("__main"), F.col("__most")).otherwise(0)
    dealt = dealt.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(first, F.col("__most") + F.col("__others") - 1)))
    dealt = dealt.withColumns({"ca": F.least("__own", "__other"), "cb": F.greatest("__own", "__other"), "side": (F.col("__own") > F.col("__other")).cast("int")})
    return dealt.drop("__top", "__n", "__most", "__others", "__main", "__h", "__own", "__other", label)


def by_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deals rows by ``keys`` and sorts them, so that each group lies together in one task."""
    return rows.repartition(tasks_for(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a task sorted by ``keys``; one group at a time is held, not the task's rows."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        whole, at = pa.Table.from_batches([batch]), 0
        for stop in np.flatnonzero(change):
            if stop > at:
                held.append(whole.slice(at, stop - at))
            yield pa.concat_tables(held)
            held, at = [], int(stop)
        held.append(whole.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def arrays(batches: Iterator[pa.RecordBatch], keys: list[str], lists: tuple[str, ...] = ()) -> Iterator[dict[str, np.ndarray]]:
    """As groups(), for columns of numbers and ``lists`` of equal lengths, as numpy arrays; cheap for very many small groups."""
    held: list[dict] = []
    last = None
    merge = lambda parts: parts[0] if len(parts) == 1 else {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: matrix(c, None) if name in lists else c.to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True)}
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        change[0] = last is not None and tuple(cols[k][0] for k in keys) != last
        at = 0
        for stop in np.flatnonzero(change):
            if stop > at:
                held.append({k: c[at:stop] for k, c in cols.items()})
            yield merge(held)
            held, at = [], int(stop)
        held.append({k: c[at:] for k, c in cols.items()})
        last = tuple(cols[k][-1] for k in keys)
    if held:
        yield merge(held)


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    flat = np.asarray(one.flatten()).reshape(len(one), -1)
    return flat if dtype is None else flat.astype(dtype, copy=False)


def roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the least row that it reaches."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, label[None, :], n).min(1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least
