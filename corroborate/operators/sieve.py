"""A bit set of wanted keys, small at every size, that scans probe before anything moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.session import cut_lineage

# 2^18 words of 64 bits: what is broadcast stays below 262,144 rows of two longs.
WORDS = 1 << 18


def bit_set(keys: DataFrame, key: Column) -> DataFrame:
    """Rows (word, bits) of the set bits of all non-null keys, at most ``WORDS`` rows.

    Keys of any type meet by their text, so an int finds the same bigint.
    """
    hashed = keys.filter(key.isNotNull()).select(_hash(key).alias("_h"))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("_h"))))
    return cut_lineage(hashed.groupBy(_word(F.col("_h")).alias("_word")).agg(bits.alias("_bits")))


def sift(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among the wanted ones; a few others pass, no wanted one is lost.

    The set is bounded, so it is broadcast and ``df`` does not move. Null keys go.
    """
    probed = df.filter(key.isNotNull()).withColumn("_h", _hash(key)).withColumn("_word", _word(F.col("_h")))
    found = probed.join(F.broadcast(wanted), "_word")
    bit = F.call_function("shiftright", F.col("_bits"), _bit(F.col("_h"))).bitwiseAND(F.lit(1).cast("bigint"))
    return found.filter(bit == 1).select(*df.columns)


def keep_wanted(df: DataFrame, key: Column, keys: DataFrame, wanted: Column) -> DataFrame:
    """``df`` without the rows whose key no row of ``keys`` can have."""
    return sift(df, key, bit_set(keys, wanted))


def _hash(key: Column) -> Column:
    return F.xxhash64(key.cast("string"))


def _word(h: Column) -> Column:
    return F.call_function("shiftright", h, F.lit(6)).bitwiseAND(F.lit(WORDS - 1).cast("bigint"))


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
