"""Bit tables of a bounded size that tell which keys can't matter, so that rows of other keys needn't be shuffled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table has 2**MOST_BITS bits at most (8 MB). A full table lets more rows through, and changes no result.
MOST_BITS, LEAST_BITS, SEGMENT_BITS = 26, 19, 15


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, keys) * 16))))


def bit_table(keys: DataFrame, bits: int) -> bytes:
    """2**bits bits, one set for each key (a 64-bit hash), lowest bit of a byte first: tasks fill segments, the driver gets
    2**bits / 8 bytes at most."""
    place = F.shiftrightunsigned("key", 64 - bits)
    no, bit = F.shiftright(place, SEGMENT_BITS).cast("int"), place.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    size = (1 << SEGMENT_BITS) // 8
    out = bytearray((1 << bits) // 8)
    for at, blob in keys.select(no.alias("no"), bit.alias("bit")).groupBy("no").agg(F.bitmap_construct_agg("bit")).collect():
        out[at * size : (at + 1) * size] = bytes(blob)
    return bytes(out)


def may_be_in(spark: SparkSession, table: bytes, bits: int, key: Column) -> Column:
    """Whether a key (a 64-bit hash) may be among those the table was made of: false only if it isn't."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        place = keys.to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - bits)
        held = np.frombuffer(shared.value, dtype=np.uint8)
        return pd.Series((held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1)

    return known(key)
