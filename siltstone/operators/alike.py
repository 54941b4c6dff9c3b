"""Titles that are alike by their trigrams, block against block: a matrix product bounds what two titles share, and only pairs
within the bound are counted out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.plans.lineage import cut

#: Columns of the product, half of them for one trigram each; trigrams counted by bits; titles of a block at least and at most.
WIDE, BITS = 256, 4096
LEAST_SIDE, MOST_SIDE = 1024, 16_384
ROWS, COLUMNS, CANDIDATES = 1024, 2048, 65_536
#: Neighbours in an order of titles that are compared at first, where one like is enough.
NEAR = 1024
#: A trigram is three characters of 21 bits.
SHIFTS = np.array([42, 21, 0])


def _coded(batches):
    for batch in batches:
        grams = batch.column(1)
        flat = grams.flatten()
        sizes = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        letters = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
        codes = (letters << SHIFTS).sum(1).astype("<i8").tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes))) * 8
        held = pa.array([codes[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), held, *batch.columns[2:]], names=batch.schema.names)


def title_sets(titles: DataFrame) -> DataFrame:
    """n, t, codes and other columns of the distinct titles (column t) that have trigrams: a number each, and the trigrams."""
    rest = [c for c in titles.columns if c != "t"]
    grams = titles.select("t", X.trigrams(F.col("t")).alias("codes"), *rest).where("size(codes) > 0")
    coded = grams.mapInArrow(_coded, ", ".join(f"`{c}` {'binary' if c == 'codes' else kind}" for c, kind in grams.dtypes))
    return cut(coded.withColumn("n", F.monotonically_increasing_id()))


def _side(words: pa.ChunkedArray | pa.Array) -> _Side:
    """Titles given as their words with a blank between any two."""
    padded = ["  " + w.replace(" ", "   ") + " " for w in words.to_pylist()]
    letters = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(w) for w in padded])[:-2]
    first, second, third = letters[:-2], letters[1:-1], letters[2:]
    inside = (second != 32) | (third != 32)  # where both are blank, a word ends and the next begins
    row, code = row[inside], ((first << SHIFTS[0]) + (second << SHIFTS[1]) + third)[inside]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[fresh], minlength=len(padded))))) * 8
    held = pa.Array.from_buffers(pa.binary(), len(padded), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(code[fresh].astype("<i8"))])
    return _Side(pa.table({"n": np.arange(len(padded)), "codes": held}))


class _Side:
    """Titles of one block: numbers, sizes, and the places of their trigrams in a vocabulary."""

    def __init__(self, table: pa.Table):
        held = table.column("codes").combine_chunks()
        held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
        at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) // 8
        self.n = table.column("n").to_numpy()
        self.codes = np.frombuffer(held.buffers()[2], "<i8")[at[0] : at[-1]] if len(self.n) else np.empty(0, np.int64)
        self.size = np.diff(at)
        self.row = np.repeat(np.arange(len(self.n)), self.size)

    def placed(self, place: np.ndarray) -> None:
        """place: of each trigram its rank among those of both sides, by frequency; -1 where one side doesn't have it."""
        self.row, self.place = self.row[place >= 0], place[place >= 0]
        own = WIDE // 2
        column = np.where(self.place < own, self.place, own + self.place % own)
        self.wide = np.sqrt(np.bincount(self.row * WIDE + column, minlength=len(self.n) * WIDE).astype(np.float32)).reshape(-1, WIDE)
        often = self.place < BITS
        words = min(BITS, int(self.place.max(initial=0)) + 1) + 63 >> 6
        self.bits = np.zeros(len(self.n) * words, np.uint64)
        np.bitwise_or.at(self.bits, self.row[often] * words + (self.place[often] >> 6), np.uint64(1) << (self.place[often] & 63).astype(np.uint64))
        self.bits = self.bits.reshape(-1, words)
        seldom = np.lexsort((self.place[~often], self.row[~often]))
        self.seldom_row, self.seldom = self.row[~often][seldom], self.place[~often][seldom]
        self.seldom_at = np.searchsorted(self.seldom_row, np.arange(len(self.n) + 1))


def _shared(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many trigrams titles i of a and j of b share."""
    words = min(a.bits.shape[1], b.bits.shape[1])
    got = np.bitwise_count(a.bits[i, :words] & b.bits[j, :words]).sum(1, dtype=np.int64)
    if len(a.seldom) and len(b.seldom):
        many = a.seldom_at[i + 1] - a.seldom_at[i]
        pair = np.repeat(np.arange(len(i)), many)
        place = a.seldom[np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a.seldom_at[i], many)]
        most = int(max(a.seldom.max(), b.seldom.max())) + 1
        keys, asked = b.seldom_row * most + b.seldom, j[pair] * most + place
        found = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        got += np.bincount(pair[found], minlength=len(i))
    return got


def _bound(a: _Side, b: _Side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places the trigrams of both sides. Gives the right side of the product, and what a title of either side asks of it: two
    titles can only be alike where the product is more than the sum of theirs."""
    codes, at = np.unique(np.concatenate([a.codes, b.codes]), return_inverse=True)
    in_a, in_b = (np.bincount(x, minlength=len(codes)) for x in (at[: len(a.codes)], at[len(a.codes) :]))
    order = np.argsort(-in_a * in_b, kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    place[(in_a == 0) | (in_b == 0)] = -1
    a.placed(place[at[: len(a.codes)]])
    if b is not a:
        b.placed(place[at[len(a.codes) :]])
    # Two sets are alike above t if they share more than t / (1 + t) of their sizes' sum. What is shared in a column is the
    # smaller count at most, and the root of the product is never less.
    part = np.float32(threshold / (1 + threshold))
    least = lambda x: part * x.size.astype(np.float32)
    slack = 0.01 + 1e-4 * max(a.size.max(initial=0), b.size.max(initial=0))
    return np.ascontiguousarray(b.wide.T), least(a) - np.float32(slack), least(b)


def _alike(a: _Side, b: _Side, threshold: float, same: bool):
    """Numbers and similarity of the pairs above the threshold, a part of them at a time."""
    wide_b, least_a, least_b = _bound(a, b, threshold)
    for lo in range(0, len(a.n), ROWS):
        for left in range(lo // COLUMNS * COLUMNS if same else 0, len(b.n), COLUMNS):
            most = a.wide[lo : lo + ROWS] @ wide_b[:, left : left + COLUMNS]
            most -= least_a[lo : lo + ROWS, None]
            i, j = np.divmod(np.flatnonzero(most > least_b[None, left : left + COLUMNS]), most.shape[1])
            i, j = i + lo, j + left
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), CANDIDATES):
                x, y = i[k : k + CANDIDATES], j[k : k + CANDIDATES]
                similarity = _similarity(a, b, x, y)
                good = similarity > threshold
                yield a.n[x[good]], b.n[y[good]], similarity[good]


def _similarity(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    both = _shared(a, b, i, j)
    return both / (a.size[i] + b.size[j] - both)


def _met(a: _Side, b: _Side, own_a: np.ndarray, own_b: np.ndarray, threshold: float) -> np.ndarray:
    """Of each title of a that has one owner: whether a title of b is like it that another owner has. Owners are numbers, -1
    where a title has several. A title that has found its like is compared no more."""
    wide_b, least_a, least_b = _bound(a, b, threshold)
    met, asking = np.zeros(len(a.n), bool), np.flatnonzero(own_a >= 0)
    for lo in range(0, len(asking), ROWS):
        rest = asking[lo : lo + ROWS]
        for left in range(0, len(b.n), COLUMNS):
            most = a.wide[rest] @ wide_b[:, left : left + COLUMNS]
            most -= least_a[rest, None]
            i, j = np.divmod(np.flatnonzero(most > least_b[None, left : left + COLUMNS]), most.shape[1])
            i, j = rest[i], j + left
            other = own_a[i] != own_b[j]
            i, j = i[other], j[other]
            for k in range(0, len(i), CANDIDATES):
                x, y = i[k : k + CANDIDATES], j[k : k + CANDIDATES]
                met[x[_similarity(a, b, x, y) > threshold]] = True
            rest = rest[~met[rest]]
            if not len(rest):
                break
    return met


def _blocks(left: int, right: int, parallel: int) -> tuple[int, int]:
    """Blocks of each side: cells enough to keep all cores busy, none too large for a task."""
    side = min(max(math.sqrt(left * right / (4 * parallel)), LEAST_SIDE), MOST_SIDE)
    return max(1, math.ceil(left / side)), max(1, math.ceil(right / side))


def alike_pairs(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """a, b, similarity: numbers of all titles of left and right (n, codes) whose trigrams have a Jaccard similarity above the
    threshold; without right, of all two titles of left, each pair once. Every block of one side meets every block of the other
    in a cell; a cell is a task of bounded size, so work is the product of both sides and memory isn't."""
    spark, same = left.sparkSession, right is None
    number = left.count()
    rows, columns = _blocks(number, number if same else right.count(), spark.sparkContext.defaultParallelism)
    block = lambda many: F.pmod(F.xxhash64("n"), F.lit(many)).cast("int")
    if same:
        # The cell of two blocks is named by the smaller one first; a title of the first block is on its left side.
        others = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.struct((F.least(k, block(rows)) * rows + F.greatest(k, block(rows))).alias("cell"), (block(rows) <= k).alias("first")))
        placed = left.select("n", "codes", F.explode(others).alias("x")).select("x.cell", "x.first", "n", "codes")
    else:
        across = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: block(rows) * columns + k)
        down = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: k * columns + block(columns))
        placed = left.select(F.explode(across).alias("cell"), F.lit(True).alias("first"), "n", "codes").unionByName(right.select(F.explode(down).alias("cell"), F.lit(False).alias("first"), "n", "codes"))

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first")
        a = _Side(table.filter(first))
        one = same and table.column("cell")[0].as_py() % (rows + 1) == 0  # a block with itself
        b = a if one else _Side(table.filter(pc.invert(first)))
        got = list(_alike(a, b, threshold, one)) if len(a.n) and len(b.n) else []
        x, y, s = (np.concatenate(c) for c in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return placed.repartition(rows * columns, "cell").groupBy("cell").applyInArrow(run, "a bigint, b bigint, similarity double")


def alike_elsewhere(titles: DataFrame, threshold: float) -> DataFrame:
    """t of the distinct titles (t, owner; without an owner where there are several) that have one owner and whose trigrams have
    a Jaccard similarity above the threshold with those of a title that another owner has. One like is enough, so that pairs
    aren't listed: most titles find it among their neighbours in the order of their words, or of their letters from the end.
    What is left then meets all titles, block against block; where hardly any title has its like that is the product again."""
    parallel = titles.sparkSession.sparkContext.defaultParallelism
    held = titles.select("t", F.col("owner").cast("string").alias("owner"), F.array_join(X.letter_words(F.col("t")), " ").alias("words"), F.lit(False).alias("met")).where("words <> ''")
    held = cut(held)
    number = held.count()

    def numbers(*owners: pa.ChunkedArray) -> list[np.ndarray]:
        every = pa.chunked_array([c for o in owners for c in o.chunks]).combine_chunks()
        every = pa.concat_arrays(every.chunks) if isinstance(every, pa.ChunkedArray) else every
        found = every.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.split(found, np.cumsum([len(o) for o in owners])[:-1])

    def near(batches):
        for batch in batches:
            for lo in range(0, len(batch), NEAR):
                part = pa.table(batch.slice(lo, NEAR))
                (own,) = numbers(part.column("owner"))
                side, known = _side(part.column("words")), part.column("met").to_numpy()
                met = known | _met(side, side, np.where(known, -1, own), own, threshold)
                yield from part.set_column(3, "met", pa.array(met)).to_batches()

    for key in (F.col("words"), F.reverse("words")):
        placed = held.repartitionByRange(max(parallel, math.ceil(number / MOST_SIDE)), key, "t").sortWithinPartitions(key, "t")
        held = cut(placed.mapInArrow(near, held.schema))
    open_ = held.where("owner is not null and not met")
    left = open_.count()
    found = held.where("met").select("t")
    if not left:
        return found
    # Few are left, as a rule: cells enough to keep all cores busy, and no more than their size asks for, as each is a task.
    rows = math.ceil(left / MOST_SIDE)
    columns = max(math.ceil(number / MOST_SIDE), min(math.ceil(number / LEAST_SIDE), math.ceil(4 * parallel / rows)))
    block = lambda many: F.pmod(F.xxhash64("t"), F.lit(many)).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: block(rows) * columns + k)
    down = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: k * columns + block(columns))
    cells = open_.select(F.explode(across).alias("cell"), F.lit(True).alias("first"), "t", "owner", "words").unionByName(held.select(F.explode(down).alias("cell"), F.lit(False).alias("first"), F.lit(None).cast("string").alias("t"), "owner", "words"))

    def run(table: pa.Table) -> pa.Table:
        a, b = table.filter(table.column("first")), table.filter(pc.invert(table.column("first")))
        if not len(a) or not len(b):
            return pa.table({"t": pa.array([], pa.string())})
        met = _met(_side(a.column("words")), _side(b.column("words")), *numbers(a.column("owner"), b.column("owner")), threshold)
        return a.filter(pa.array(met)).select(["t"])

    return found.unionByName(cells.repartition(rows * columns, "cell").groupBy("cell").applyInArrow(run, "t string").distinct())
