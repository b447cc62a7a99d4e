"""Bloom filters as DataFrame expressions.

A filter is one row with an array of 64-bit words, built by a bitwise-or
aggregation; it comes into a query as a scalar subquery. Its size is bounded
by the caller: with more keys than it was made for it lets more rows through,
but never drops one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricewise.llm.common import written

#: Largest filter that is sent to the executors (8 MB).
MAX_BITS = 1 << 26
HASHES = 5


def positions(key: Column, bits: int, hashes: int, seed: int = 0) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + j)), F.lit(bits)) for j in range(hashes)]


def bit_set(keys: DataFrame, bits: int, hashes: int, seed: int = 0) -> DataFrame:
    """One row with the words of a filter of column ``key``; ``bits`` divides by 64."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    some = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("b"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(some, "w", "left")
    pairs = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("a"))
    return pairs.select(F.transform("a", lambda x: x["b"]).alias("words"))


def passes(words: Column, key: Column, bits: int, hashes: int, seed: int = 0) -> Column:
    """Whether the filter may hold ``key``."""
    found = F.lit(True)
    for p in positions(key, bits, hashes, seed):
        found = found & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return found


def may_hold(df: DataFrame, column: str, keys: DataFrame, flag: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with the boolean ``flag``: false only if ``column`` is not among the
    values of the one column of ``keys`` (a written table)."""
    keys = keys.toDF("key")
    bits = min(max_bits, max(64, -(-keys.count() * 10 // 64) * 64))
    words = written(bit_set(keys, bits, HASHES), "bloom", 1)
    return (df.withColumn("__words", words.scalar())
            .withColumn(flag, F.coalesce(passes(F.col("__words"), F.col(f"`{column}`"), bits, HASHES), F.lit(False))).drop("__words"))
