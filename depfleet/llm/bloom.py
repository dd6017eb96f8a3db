"""A blocked Bloom filter in DataFrame functions.

A key belongs to one block of 512 bits, eight words of 64, and sets one bit in each word, so a probe reads one row.
The filter is a small table with a row per block.  Its size is bounded by ``max_blocks``: beyond that more keys
pass, never fewer, and an exact join after it decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
MAX_BLOCKS = 1 << 15  # 64 bytes each: 2 MB at most
KEYS_PER_BLOCK = 32   # 16 bits a key


def block_count(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-keys // KEYS_PER_BLOCK)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bits_of(key: Column) -> list[Column]:
    """One bit a word, each from six bits of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(second, 6 * w).bitwiseAND(F.lit(63))).cast("int"))
            for w in range(WORDS)]


def build(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """The filter's table: ``__block`` and eight words, at most ``blocks`` rows."""
    words = [F.bit_or(b).alias(f"__w{w}") for w, b in enumerate(bits_of(key))]
    return keys.where(key.isNotNull()).groupBy(block_of(key, blocks).alias("__block")).agg(*words)


def may_hold(rows: DataFrame, key: Column, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter.  The broadcast is the filter, bounded by ``blocks``."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    hit = reduce(Column.__and__, [F.col(f"__w{w}").bitwiseAND(b) == b for w, b in enumerate(bits_of(key))])
    probed = rows.withColumn("__block", block_of(key, blocks))
    return probed.join(F.broadcast(filter_table), "__block").where(hit).select(*cols)


def marked(rows: DataFrame, key: Column, filter_table: DataFrame, blocks: int, name: str) -> DataFrame:
    """(row, ``name``): every row as a struct, and whether its key may be in the filter; a null key never is."""
    hit = reduce(Column.__and__, [F.col(f"__w{w}").bitwiseAND(b) == b for w, b in enumerate(bits_of(F.col("__key")))])
    probed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("__key"))
    joined = probed.withColumn("__block", block_of(F.col("__key"), blocks)).join(F.broadcast(filter_table), "__block", "left")
    return joined.select("row", (F.coalesce(hit, F.lit(False)) & F.col("__key").isNotNull()).alias(name))
