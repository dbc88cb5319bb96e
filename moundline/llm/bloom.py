"""Blocked Bloom filters as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is eight words of 64 bits; a key sets one bit in each.
WORDS = 8
#: A Bloom table of this many blocks has 72 bytes a block, 75 MB at most, and may be broadcast; a larger one is joined.
BROADCAST_BLOCKS = 1 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: block and its eight words. Built with partial bit_or, so no task sees all keys."""
    one = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(key), j))
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(one(j)).alias(f"w{j}") for j in range(WORDS)])


def may_be_in(rows: DataFrame, key: str, keys: DataFrame, bits_per_key: int = 12) -> DataFrame:
    """``rows`` less most of those whose ``key`` is not in the column ``key`` of ``keys`` (written rows), before anything moves; none of the others is lost.

    The filter has BROADCAST_BLOCKS at most, so with more keys than fit into it well it lets more rows pass.
    """
    blocks = 1 << max(0, (keys.count() * bits_per_key // (64 * WORDS)).bit_length())
    blocks = min(blocks, BROADCAST_BLOCKS)
    bloom = bloom_table(keys, key, blocks)
    bloom = bloom.select(*[F.col(c).alias(f"__{c}") for c in bloom.columns])
    asked = rows.withColumn("__block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "__block")
    held = [F.call_function("shiftright", F.col(f"__w{j}"), _bit(F.col(key), j)).bitwiseAND(F.lit(1)) == 1 for j in range(WORDS)]
    return asked.filter(reduce(Column.__and__, held)).select(*rows.columns)
