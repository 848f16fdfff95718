"""Bloom filters from built-in functions: which keys another table may hold, told before anything is shuffled.

The bits of a filter are one array of whole numbers in a table of one row, which is broadcast; its size is a parameter, so it
never grows with the data. A filter too small for its keys lets more through, and loses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.sources.scratch import settled

#: Bits of a filter by default (2 ** LOG_BITS; 4 MB), and how many of them a key sets.
LOG_BITS, HASHES = 25, 3


def places(*key: Column | str, log_bits: int = LOG_BITS) -> list[Column]:
    """The bits of a key: two halves of one hash, and their sums."""
    h = F.xxhash64(*key)
    low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32)
    return [F.pmod(low + F.lit(i) * high, F.lit(1 << log_bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, *key: str, log_bits: int = LOG_BITS, name: str = "bits") -> DataFrame:
    """One row with the array ``name``: the bits of all ``keys``, 64 in each number.

    Keys set bits where they lie, as partial sums; what meets in one task is the numbers, of which there are as many whatever the keys.
    """
    told = keys.select(F.explode(F.array(*places(*key, log_bits=log_bits))).alias("at"))
    numbers = told.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("n"))
    every = keys.sparkSession.range(1 << (log_bits - 6)).join(numbers, F.col("id") == F.col("place"), "left")
    placed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))))
    return every.agg(placed.alias("placed")).select(F.transform("placed", lambda x: x["n"]).alias(name))


def may_hold(bits: Column, *key: Column | str, log_bits: int = LOG_BITS) -> Column:
    """Whether the filter ``bits`` may hold a key; never false for one that it holds."""
    out = F.lit(True)
    for at in places(*key, log_bits=log_bits):
        out = out & (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def held_rows(rows: DataFrame, keys: DataFrame, *key: str, log_bits: int = LOG_BITS) -> DataFrame:
    """``rows`` less most of those whose ``key`` is none of ``keys``; all others stay. ``keys`` is read once, ``rows`` stay where they are."""
    bits = settled(bloom(keys, *key, log_bits=log_bits, name="_bits"), "bloom")
    return rows.join(F.broadcast(bits), may_hold(F.col("_bits"), *[rows[c] for c in key], log_bits=log_bits)).drop("_bits")
