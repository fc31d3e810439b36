"""Blocked Bloom filters as small tables: one row a block, four 64-bit words, one bit set in each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many blocks of 32 bytes (8 MiB): the bound of what is broadcast. Beyond it more false positives pass, which an exact join removes.
MAX_BLOCKS = 1 << 18
BITS_A_KEY = 12
WORDS = 4


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 20), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(word)), 58).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def blocks_for(keys: int, most: int = MAX_BLOCKS) -> int:
    return min(most, 1 << max(0, (keys * BITS_A_KEY // 256)).bit_length())


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(__block, __w0..__w3), at most ``blocks`` rows; made by a map-side combined aggregation."""
    k = F.col(key)
    return keys.where(k.isNotNull()).select(_block(k, blocks).alias("__block"), *(_bit(k, i).alias(f"__b{i}") for i in range(WORDS))).groupBy("__block").agg(*(F.bit_or(f"__b{i}").alias(f"__w{i}") for i in range(WORDS)))


def probed(df: DataFrame, key: str, filter_: DataFrame, blocks: int, flag: str = "__possible") -> DataFrame:
    """df with a flag: false means certainly absent. The filter's size is bounded by ``blocks``, so it is broadcast."""
    k = F.col(key)
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(_bit(k, i)) != 0)
    joined = df.withColumn("__block", _block(k, blocks)).join(F.broadcast(filter_), "__block", "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False)) & k.isNotNull()).drop("__block", *(f"__w{i}" for i in range(WORDS)))


def parted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among keys, and the others: only these need a shuffle to be joined with keys."""
    blocks = blocks_for(keys.count())
    seen = probed(df, key, build(keys, key, blocks), blocks)
    return seen.where("not __possible").drop("__possible"), seen.where("__possible").drop("__possible")
