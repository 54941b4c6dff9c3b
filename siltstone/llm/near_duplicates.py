"""Near-duplicate records by an exact set-similarity join.

A record is the set of its distinct runs of three words. Runs are put in one global order, rare ones first; two sets that
reach the threshold share a run within short prefixes of that order, so only prefixes are joined. Length, positional and
suffix filters drop most pairs inside the join: the suffix filter bounds the Hamming distance of two sets from below by
that of their parity words. Each pair that is left is verified once, on the words themselves.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bits import bit_table, bits_for, may_be_in
from siltstone.llm.cooccurrence import basket_pairs
from siltstone.plans.lineage import cut

WORDS, SIMILARITY = 3, Fraction(3, 5)

#: Runs are counted in a table of this many places at most (one byte each when broadcast: 4 MB, whatever the data), each the
#: sum of the runs that fall on it. Any order gives the same result; a table too small for the corpus only orders less well.
MOST_PLACES = 22
SEGMENT = 16

#: Postings of one run that one task may hold; the pairs of a more frequent run are spread over cells of its blocks.
BLOCK_POSTINGS = 8192

#: Bytes of a posting, and of the postings of a partition, on average; the number of partitions follows from the number of runs.
POSTING_BYTES, PARTITION_BYTES = 56, 16 << 20

#: Members of a class, or of a side of a link, that meet in one cell when pairs of ids are asked for.
CELL_MEMBERS = 1024

_word = re.compile(r"[^\W_]+")
PARITY = 3
_WORDS = [f"b{i}" for i in range(1, PARITY + 1)]

#: What a set is known by: the sum of its runs' hashes, and its first parity word.
_KEYS = ["sum", "b1"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def _ordered(doc: np.ndarray, minor: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The order by doc, minor (below 256) and runs: by one packed key where that decides it, else by all three."""
    packed = (doc.astype(np.uint64) << np.uint64(44)) | (minor.astype(np.uint64) << np.uint64(36)) | (runs >> np.uint64(28))
    order = np.argsort(packed)
    p, r = packed[order], runs[order]
    if len(doc) and (doc[-1] >= 1 << 20 or np.any((p[1:] == p[:-1]) & (r[1:] != r[:-1]))):
        return np.lexsort((runs, minor, doc))
    return order


class _Runs:
    """The distinct runs of a batch of texts: hashes sorted within each text, and where each text's begin."""

    def __init__(self, width: int):
        self.width, self.memo = width, _WordHashes()

    def of(self, kinds: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, sizes = [], []
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        hashed = self.memo.__getitem__
        for text in texts:
            found = _word.findall((text or "").lower())
            flat.extend(map(hashed, found))
            sizes.append(len(found))
        seeds = [hashed(kind) for kind in kinds]
        words, sizes = np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        n = max(0, len(words) - self.width + 1)
        runs = np.array(seeds, dtype=np.uint64)[doc[:n]]
        for k in range(self.width):
            runs = _mixed(runs + words[k : n + k] * np.uint64(2 * k + 3))
        same = doc[:n] == doc[self.width - 1 : n + self.width - 1]
        runs, doc = runs[same], doc[:n][same]
        order = _ordered(doc, np.zeros(1, dtype=np.uint64), runs)
        runs, doc = runs[order], doc[order]
        first = np.ones(len(runs), dtype=bool)
        first[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
        runs, doc = runs[first], doc[first]
        return runs, doc, np.searchsorted(doc, np.arange(len(sizes) + 1))


def _parity(runs: np.ndarray, starts: np.ndarray, words: int = PARITY) -> np.ndarray:
    """The first of PARITY words for each text: bit i tells whether an odd number of its runs fall on i."""
    bit = _mixed(runs + np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * PARITY)
    out = np.zeros((words, len(starts) - 1), dtype=np.uint64)
    some = starts[1:] > starts[:-1]
    for w in range(words):
        values = np.where(bit // np.uint64(64) == w, np.uint64(1) << (bit % np.uint64(64)), np.uint64(0))
        if len(values):
            out[w, some] = np.bitwise_xor.reduceat(values, starts[:-1][some])
    return out.view(np.int64)


def _sums(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(runs ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    return (total[starts[1:]] - total[starts[:-1]]).view(np.int64)


def _places(documents: int) -> int:
    return min(MOST_PLACES, max(SEGMENT, math.ceil(math.log2(max(1, documents) * 8))))


def survey(texts: DataFrame, width: int, places: int) -> DataFrame:
    """One pass over the texts. Rows with an id: kind, id, sum, b1, n, the key and the size of each record's set. Rows with
    a blob: segment, salt, blob, how many runs of a task's texts fall on the places of the segment, compressed."""
    segment = 1 << min(SEGMENT, places)
    schema = pa.schema([("kind", pa.string()), ("id", pa.string()), ("sum", pa.int64()), ("b1", pa.int64()), ("n", pa.int64()), ("segment", pa.int32()), ("salt", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs_of, counted, seen = _Runs(width), np.zeros(1 << places, dtype=np.uint32), False
        for batch in batches:
            runs, _, starts = runs_of.of(batch.column(0).to_pylist(), batch.column(2).to_pylist())
            counted += np.bincount((runs >> np.uint64(64 - places)).astype(np.int64), minlength=1 << places).astype(np.uint32)
            keys = [pa.array(k, pa.int64()) for k in (_sums(runs, starts), _parity(runs, starts, 1)[0], np.diff(starts))]
            none = [pa.nulls(len(starts) - 1, f.type) for f in schema][5:]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *keys, *none], schema=schema)
            seen = True
        if seen:
            blobs = [zlib.compress(part.tobytes(), 1) for part in counted.reshape(-1, segment)]
            n, salt = len(blobs), TaskContext.get().partitionId() % 64
            none = [pa.nulls(n, f.type) for f in schema][:5]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return texts.select("kind", "id", "text").mapInArrow(run, "kind string, id string, sum bigint, b1 bigint, n bigint, segment int, salt int, blob binary")


def run_levels(parts: DataFrame, places: int) -> bytes:
    """For each of 2**places places, 8 * log2(1 + runs of all texts that fall on it), as a byte. Tasks' counts (segment,
    salt, blob) are added up segment by segment; the driver gets 2**places bytes."""
    segment = 1 << min(SEGMENT, places)

    def total(blobs: pd.Series) -> np.ndarray:
        return sum((np.frombuffer(zlib.decompress(b), dtype=np.uint32).astype(np.uint64) for b in blobs), np.zeros(segment, dtype=np.uint64))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        summed = np.minimum(total(pdf["blob"]), 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"segment": pdf["segment"][:1], "blob": [zlib.compress(summed.tobytes(), 1)]})

    schema = "segment int, blob binary"
    sums = parts.groupBy("segment", "salt").applyInPandas(add, schema).groupBy("segment").applyInPandas(add, schema)
    table = np.zeros(1 << places, dtype=np.uint32)
    for no, blob in sums.collect():
        table[no * segment : (no + 1) * segment] = np.frombuffer(zlib.decompress(bytes(blob)), dtype=np.uint32)
    return np.minimum(np.floor(8 * np.log2(1.0 + table)), 255).astype(np.uint8).tobytes()


def _prefix(n: np.ndarray, similarity: Fraction) -> np.ndarray:
    p, q = similarity.numerator, similarity.denominator
    return n - -(-p * n // q) + 1


def postings(texts: DataFrame, levels, places: int, width: int, similarity: Fraction, doubtful: bool, dropped: Accumulator | None = None) -> DataFrame:
    """token, meta, sum, b1..b3: the prefix of each record's runs. meta holds the size of the set and the place in it. A run is
    doubtful if so many fall on its place that it may be frequent itself: only postings of such runs are given, or only the
    others, and then dropped counts those left out. Equal sets of a batch are emitted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of, table = _Runs(width), np.frombuffer(levels.value, dtype=np.uint8)
        may_be_frequent = np.exp2((np.arange(256) + 1) / 8.0) > BLOCK_POSTINGS
        for batch in batches:
            runs, doc, starts = runs_of.of(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if not len(runs):
                continue
            parity, sizes, sums = _parity(runs, starts), np.diff(starts), _sums(runs, starts)
            _, once = np.unique(np.vstack([sums, parity[0]]), axis=1, return_index=True)
            keep = np.zeros(len(sizes), dtype=bool)
            keep[once] = True
            level = table[(runs >> np.uint64(64 - places)).astype(np.int64)]
            order = _ordered(doc, level, runs)
            runs, level = runs[order], level[order]
            pos = np.arange(len(runs)) - starts[doc]
            use = keep[doc] & (pos < _prefix(sizes, similarity)[doc])
            asked = may_be_frequent[level] == doubtful
            if dropped is not None and not np.all(asked[use]):
                dropped.add(int(np.sum(~asked & use)))
            use &= asked
            runs, level, pos, doc = runs[use], level[use], pos[use], doc[use]
            cols = [runs.view(np.int64), (sizes[doc] << 32) | pos, *(c[doc] for c in (sums, *parity))]
            for at in range(0, len(runs), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536], pa.int64()) for c in cols], names=["token", "meta", "sum", *_WORDS])

    return texts.select("kind", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("token", "meta", "sum", *_WORDS)))


def _before(a: list[Column], b: list[Column]) -> Column:
    """Whether the tuple a comes before b."""
    out = a[-1] < b[-1]
    for x, y in reversed(list(zip(a[:-1], b[:-1]))):
        out = (x < y) | ((x == y) & out)
    return out


def _joined(rows: DataFrame, keys: list[str], own_side: Column, similarity: Fraction) -> DataFrame:
    """sum_a, b1_a, sum, b1: the keys of pairs of different sets that share a run and pass all filters."""
    p, q = similarity.numerator, similarity.denominator
    columns = ["meta", "sum", *_WORDS]
    named = rows.withColumn("side", own_side).select(*keys, *columns, "side")
    a = named.select(*keys, *(F.col(c).alias(f"{c}_a") for c in [*columns, "side"]))
    n = {s: F.shiftright(f"meta{s}", 32) for s in ("", "_a")}
    pos = {s: F.col(f"meta{s}").bitwiseAND(F.lit((1 << 32) - 1)) for s in ("", "_a")}
    sides = F.col("side") + F.col("side_a")
    need = F.expr(f"({p} * (shiftright(meta, 32) + shiftright(meta_a, 32)) + {p + q - 1}) div {p + q}")
    in_prefix = F.least(n["_a"] - need - pos["_a"], n[""] - need - pos[""]) >= 0
    positional = F.least(pos["_a"], pos[""]) + 1 + F.least(n["_a"] - 1 - pos["_a"], n[""] - 1 - pos[""]) >= need
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(w))) for w in _WORDS), F.lit(0))
    keep = (
        _before([n["_a"], F.col("sum_a"), F.col("b1_a")], [n[""], F.col("sum"), F.col("b1")])
        & ((sides == 0) | (sides == 3)) & (n["_a"] * q >= n[""] * p) & (apart <= n["_a"] + n[""] - 2 * need) & in_prefix & positional
    )
    return a.join(named, keys).where(keep).select("sum_a", "b1_a", "sum", "b1")


def _pairs_of(columns: list[np.ndarray], similarity: Fraction) -> Iterator[list[np.ndarray]]:
    """Keys (sum_a, b1_a, sum, b1) of pairs of different sets that share a token and pass all filters, some at a time; columns
    are those of postings. Postings of a token stand in the order of size and key, each once: a posting is compared with the one
    after it, with the one after that, and so on, until sizes differ too much, all postings at once."""
    p, q = similarity.numerator, similarity.denominator
    order = np.argsort(columns[0])
    same = columns[0][order][1:] == columns[0][order][:-1]
    order = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
    token, meta, sums, *words = (c[order] for c in columns)
    size = meta >> 32
    order = np.lexsort((words[0], sums, size, token))
    token, size, pos, sums, words = token[order], size[order], meta[order] & 0xFFFFFFFF, sums[order], [w[order] for w in words]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1]) | (sums[1:] != sums[:-1]) | (words[0][1:] != words[0][:-1])
    token, size, pos, sums, words = token[new], size[new], pos[new], sums[new], [w[new] for w in words]
    i, step = np.arange(len(token)), 0
    while len(i):
        step += 1
        i = i[i + step < len(token)]
        j = i + step
        near = (token[i] == token[j]) & (size[i] * q >= size[j] * p)
        i, j = i[near], j[near]
        need = (p * (size[i] + size[j]) + p + q - 1) // (p + q)
        left_a, left_b = size[i] - pos[i], size[j] - pos[j]
        fits = (np.minimum(left_a, left_b) >= need) & (np.minimum(pos[i], pos[j]) + np.minimum(left_a, left_b) >= need)
        a, b = i[fits], j[fits]
        apart = sum((np.bitwise_count((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in words), np.zeros(len(a), dtype=np.int64))
        close = apart <= size[a] + size[b] - 2 * need[fits]
        a, b = a[close], b[close]
        if len(a):
            yield [sums[a], words[0][a], sums[b], words[0][b]]


def candidates(posts: DataFrame, similarity: Fraction, partitions: int) -> DataFrame:
    """sum_a, b1_a, sum, b1 of postings none of whose runs is frequent. Postings are shuffled once, by token; a partition holds
    PARTITION_BYTES of them on average, and no token more than BLOCK_POSTINGS."""
    names = ["sum_a", "b1_a", "sum", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            whole = pa.Table.from_batches(held)
            columns = [c.to_numpy() for c in whole.columns]
            for keys in _pairs_of(columns, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in keys], names=names)

    return posts.repartition(partitions, "token").mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).distinct()


def candidates_of_frequent(posts: DataFrame, similarity: Fraction) -> DataFrame:
    """The same of any postings: runs are counted by their postings first. A run of n of them has ceil(n / BLOCK_POSTINGS)
    blocks, and each pair of blocks is a cell of its own."""
    posts = cut(posts)
    counts = posts.groupBy("token").agg(F.ceil(F.count("*") / BLOCK_POSTINGS).cast("int").alias("blocks"))
    cells = posts.join(counts, "token").withColumn("own", F.pmod(F.xxhash64("b1", "sum"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    cells = cells.select(*posts.columns, "lo", "hi", "own").distinct()
    side = F.when(F.col("lo") == F.col("hi"), 0).when(F.col("own") == F.col("lo"), 1).otherwise(2)
    return _joined(cells, ["token", "lo", "hi"], side, similarity).distinct()


def verified(pairs: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The rows of pairs (key columns, text_a, text_b) whose sets of runs reach the similarity, without the texts."""
    keys = [c for c in pairs.columns if c not in ("text_a", "text_b")]
    schema = pairs.select(*keys).schema
    p, q = similarity.numerator, similarity.denominator

    def runs(text: str) -> set:
        words = _word.findall((text or "").lower())
        return set(zip(*(words[k:] for k in range(width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                a, b = runs(x), runs(y)
                both = len(a & b)
                ok.append(both > 0 and both * q >= p * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[: len(keys)]), names=keys).filter(pa.array(ok, pa.bool_()))

    return pairs.select(*keys, "text_a", "text_b").mapInArrow(run, schema)


def similar_classes(texts: DataFrame, width: int = WORDS, similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts (kind, id, text). members: kind, id, class_id: records with equal sets of runs are of one
    class, named by its smallest id. links: kind, class_a < class_b, for the classes that reach the similarity. Records
    are compared within their kind. Rows without id are ignored; rows of one id count once and must have one text. A null
    text, and one of fewer than `width` words, has no runs, is a class of its own and is linked to nothing."""
    places = _places(texts.count())
    rows = texts.where(F.col("id").isNotNull())
    surveyed = cut(survey(rows, width, places))
    levels = texts.sparkSession.sparkContext.broadcast(run_levels(surveyed.where("blob is not null").select("segment", "salt", "blob"), places))
    keyed = surveyed.where("id is not null").select("kind", "id", *_KEYS, "n").distinct()
    heads = keyed.where("n > 0").groupBy("kind", *_KEYS).agg(F.min("id").alias("class_id"))
    runs = surveyed.agg(F.sum("n")).first()[0] or 0
    shuffled = int(runs * float(1 - similarity)) * POSTING_BYTES
    default = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doubtful = texts.sparkSession.sparkContext.accumulator(0)
    sure = postings(rows, levels, places, width, similarity, False, doubtful)
    pairs = cut(candidates(sure, similarity, max(default, math.ceil(shuffled / PARTITION_BYTES))))
    if doubtful.value:
        pairs = pairs.unionByName(candidates_of_frequent(postings(rows, levels, places, width, similarity, True), similarity)).distinct()
    a = heads.select(F.col("kind").alias("kind_a"), F.col("class_id").alias("class_a"), *(F.col(k).alias(f"{k}_a") for k in _KEYS))
    named = pairs.join(a, [f"{k}_a" for k in _KEYS]).join(heads, _KEYS).where("kind = kind_a").select("kind", F.least("class_a", "class_id").alias("class_a"), F.greatest("class_a", "class_id").alias("class_b"))
    named = cut(named)
    # Only texts of some pair are shuffled.
    asked = named.select(F.explode(F.array(F.xxhash64("kind", "class_a"), F.xxhash64("kind", "class_b"))).alias("key")).distinct()
    bits = bits_for(named.count() * 2)
    rows = rows.where(may_be_in(rows.sparkSession, bit_table(asked, bits), bits, F.xxhash64("kind", "id")))
    whole = rows.select("kind", "id", "text").repartition("kind", "id").groupBy("kind", "id").agg(F.first("text").alias("text"))
    with_a = named.join(whole.select("kind", F.col("id").alias("class_a"), F.col("text").alias("text_a")), ["kind", "class_a"])
    with_b = with_a.join(whole.select("kind", F.col("id").alias("class_b"), F.col("text").alias("text_b")), ["kind", "class_b"])
    links = verified(with_b.select("kind", "class_a", "class_b", "text_a", "text_b"), width, similarity)
    lone = keyed.where("n = 0").select("kind", "id", F.col("id").alias("class_id"))
    members = keyed.where("n > 0").join(heads, ["kind", *_KEYS]).select("kind", "id", "class_id").unionByName(lone)
    return members, cut(links)


def similar_pairs(texts: DataFrame, width: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """kind, id_a < id_b: all pairs of different ids that reach the similarity. There are k (k - 1) / 2 of them for k equal
    records; who can do with a row for each record takes similar_classes. Members of large classes meet in cells of blocks."""
    members, links = similar_classes(texts, width, similarity)
    classed = cut(members.where(F.col("class_id").isNotNull()))
    key = ["kind", "class_id"]
    crowded = cut(classed.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1"))
    inner = classed.join(crowded.select(*key), key, "left_semi").select(*key, F.col("id").alias("item"))
    within = basket_pairs(inner, CELL_MEMBERS, key).select("kind", F.col("item_a").alias("id_a"), F.col("item_b").alias("id_b"))
    large = crowded.where(F.col("k") > CELL_MEMBERS).select(*key, F.ceil(F.col("k") / CELL_MEMBERS).cast("int").alias("blocks"))
    one = F.coalesce("blocks", F.lit(1))
    placed = classed.join(large, key, "left").select(*key, "id", F.pmod(F.xxhash64("id"), one).cast("int").alias("block"))
    cells = links
    for side in ("a", "b"):
        sized = large.select("kind", F.col("class_id").alias(f"class_{side}"), "blocks")
        cells = cells.join(sized, ["kind", f"class_{side}"], "left").withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), one - 1))).drop("blocks")
    for side in ("a", "b"):
        own = placed.select("kind", F.col("class_id").alias(f"class_{side}"), F.col("block").alias(f"block_{side}"), F.col("id").alias(f"x_{side}"))
        cells = cells.join(own, ["kind", f"class_{side}", f"block_{side}"])
    across = cells.select("kind", F.least("x_a", "x_b").alias("id_a"), F.greatest("x_a", "x_b").alias("id_b"))
    return within.unionByName(across.where("id_a < id_b")).distinct()


def record_texts(knowledge_items: DataFrame, procedures: DataFrame) -> DataFrame:
    """kind, id, text of both tables; a null title or content counts as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    items = knowledge_items.select(F.lit("knowledge_item").alias("kind"), "id", F.concat(text("title"), F.lit(" "), text("content")).alias("text"))
    return items.unionByName(procedures.select(F.lit("procedure").alias("kind"), "id", text("content").alias("text")))
