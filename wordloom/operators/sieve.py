"""A Bloom filter as a table: which keys cannot be in the other side of a join.

The filter is cut into words of 64 bits. A key sets four bits of one word, so a key is tested by one
lookup in ``(block, bits)``: an equi-join with a table that is broadcast, as its size is bounded by
``MAX_BLOCKS`` whatever it was built from. It is built by ``bit_or``, which is folded in each task
before the shuffle. With 16 bits a key some 1 to 2 % of absent keys pass; beyond
``MAX_BLOCKS`` * 4 keys more do, which costs time and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS_PER_BLOCK = 4
MAX_BLOCKS = 1 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """Four bits of a word, by a hash of its own."""
    own = F.xxhash64(key, F.lit(1))
    bits = F.lit(0).cast("bigint")
    for k in range(4):
        at = F.shiftrightunsigned(own, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return bits


def build_sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(block, bits)`` of the keys that are not null, and the number of blocks."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    blocks = max(1, min(MAX_BLOCKS, -(-n // KEYS_PER_BLOCK)))
    own = keys.where(F.col(key).isNotNull())
    return own.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("bits")), blocks


def sift(rows: DataFrame, sieve: tuple[DataFrame, int], key: Column, into: str) -> DataFrame:
    """Add ``into``: false for rows whose key is surely not among those of the sieve, or null.

    The null test is inside the choice: as a condition of its own the optimizer would move it into the rows' own
    plan, which then differs for hits and the rest, so that a shuffle in it ran once for either.
    """
    table, blocks = sieve
    side = F.broadcast(table.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    found = rows.join(side, _block(key, blocks) == F.col("_block"), "left")
    own = _bits(key)
    hit = F.coalesce(F.when(key.isNotNull(), F.col("_bits").bitwiseAND(own) == own), F.lit(False))
    return found.withColumn(into, hit).drop("_block", "_bits")
