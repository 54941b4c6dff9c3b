"""Filling of fixed-capacity containers, by harmonic packing.

A length belongs to the class k whose lengths are above capacity / (k + 1) and at most capacity / k, so that any k of them
fit one container. Containers of class k take k items of it; which ones doesn't matter, so workers fill containers
independently of each other. What a container has left then goes to items of higher classes, largest fit first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048

#: Items of a worker's share, on average. A share fills its last container only in part, one in some thousands.
SHARE_ITEMS = 40_000


def harmonic_fill(sizes: Iterable[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of positions in `sizes` (each from 1 to capacity)."""
    at_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, size in enumerate(sizes):
        at_size[size].append(i)
    free = 0  # bit s: some item of size s waits
    for size, waiting in enumerate(at_size):
        if waiting:
            free |= 1 << size

    def take(size: int) -> int:
        nonlocal free
        item = at_size[size].pop()
        if not at_size[size]:
            free &= ~(1 << size)
        return item

    out: list[list[int]] = []
    while free:
        largest = free.bit_length() - 1
        k = capacity // largest
        low = capacity // (k + 1)
        bin_, room = [], capacity
        for _ in range(k):  # the fixed count of its class
            size = (free & ((1 << (min(room, capacity // k) + 1)) - 1)).bit_length() - 1
            if size <= low:
                break
            bin_.append(take(size))
            room -= size
        while room and (size := (free & ((1 << (room + 1)) - 1)).bit_length() - 1) > 0:
            bin_.append(take(size))
            room -= size
        out.append(bin_)
    return out


def pack(sized: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, share_items: int = SHARE_ITEMS, items_known: int | None = None) -> DataFrame:
    """container_id, key, part_no, first, n_tokens: every item with its container. Items larger than the capacity are cut
    into parts of the capacity and a rest; others stay whole. Items of size 0, null or below take no room and are left out.
    Each worker's share is a hash of the key: it holds about share_items items of all classes, however common a class is. items_known saves counting the items, where
    their sizes are dear; it sets the number of shares and nothing else."""
    rows = sized.select(key, F.col(size).cast("bigint").alias("__size")).where("__size > 0")
    cut = rows.withColumn("part_no", F.explode(F.sequence(F.lit(0), ((F.col("__size") - 1) / capacity).cast("int"))))
    items = cut.select(key, "part_no", (F.col("part_no") * F.lit(capacity)).cast("bigint").alias("first"), F.least(F.lit(capacity), F.col("__size") - F.col("part_no") * capacity).cast("bigint").alias("n_tokens"))
    shares = max(1, math.ceil((sized.count() if items_known is None else items_known) / share_items))
    items = items.withColumn("share", F.pmod(F.xxhash64(key, "part_no"), F.lit(shares)))
    schema = T.StructType([T.StructField("container_id", T.LongType()), *items.drop("share").schema])

    def fill(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "part_no"], ignore_index=True)
        ids = [0] * len(pdf)
        for no, bin_ in enumerate(harmonic_fill(pdf["n_tokens"].tolist(), capacity)):
            for i in bin_:
                ids[i] = (int(group[0]) << 32) | no
        return pdf.assign(container_id=ids)[schema.names]

    return items.groupBy("share").applyInPandas(fill, schema)
