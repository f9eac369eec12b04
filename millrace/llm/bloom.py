"""Blocked Bloom filter in DataFrame functions.

A key sets eight bits within one block of 256, so a probe touches one block. A
filter has a fixed greatest size: a longer list makes it pass more keys in
vain, never fewer, and the exact join that follows removes those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 2 ** MAX_LOG2_BLOCKS blocks of 32 bytes: 2 MB.
MAX_LOG2_BLOCKS = 16
BITS_PER_KEY = 16
_WORDS = 4


def log2_blocks(n_keys: int) -> int:
    """Blocks, as a power of two, that give each key BITS_PER_KEY bits, up to the bound."""
    return min(MAX_LOG2_BLOCKS, max(0, (max(n_keys, 1) * BITS_PER_KEY - 1) // 256).bit_length())


def _block(key: Column, log2: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - log2).cast("int") if log2 else F.lit(0)


def _mask(key: Column, word: int) -> Column:
    bits = F.xxhash64(key, F.lit(1))
    one = [F.expr("1L").alias("one") for _ in range(2)]
    at = [F.shiftrightunsigned(bits, 6 * (2 * word + j)).bitwiseAND(F.lit(63)).cast("int") for j in range(2)]
    return F.call_function("shiftleft", one[0], at[0]).bitwiseOR(F.call_function("shiftleft", one[1], at[1]))


def build(keys: DataFrame, key: str, log2: int) -> Column:
    """A scalar column that holds the filter's words as one array of longs.

    The blocks are or-ed together before the shuffle; what meets in one task is
    a row for each block, 2 ** log2 at most.
    """
    spark = keys.sparkSession
    words = [f"w{j}" for j in range(_WORDS)]
    filled = keys.select(_block(F.col(key), log2).alias("block"), *[_mask(F.col(key), j).alias(w) for j, w in enumerate(words)])
    empty = spark.range(2**log2).select(F.col("id").cast("int").alias("block"), *[F.lit(0).cast("long").alias(w) for w in words])
    blocks = filled.unionByName(empty).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words])
    rows = F.sort_array(F.collect_list(F.struct("block", F.array(*words).alias("words"))))
    return blocks.agg(F.flatten(F.transform(rows, lambda r: r["words"])).alias("words")).scalar()


def may_hold(filter_words: Column, key: Column, log2: int) -> Column:
    """Whether the key may be in the filter: true for each key that was put in."""
    at = _block(key, log2) * _WORDS
    tests = []
    for j in range(_WORDS):
        mask = _mask(key, j)
        tests.append(F.get(filter_words, at + j).bitwiseAND(mask) == mask)
    return tests[0] & tests[1] & tests[2] & tests[3]
