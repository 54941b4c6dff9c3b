"""Splitting of oversized texts at natural boundaries, by agglomerative merging.

A text is taken apart into atomic segments that fit, along boundaries of falling strength: turns, paragraphs, lines,
sentences, words, characters. Adjacent segments wait in a heap, and the pair with the weakest boundary between them is
merged first as long as the merged piece and its overlap fit, so the cuts that remain are the strongest ones.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans.lineage import cut

LIMIT, OVERLAP = 4000, 200

TURN, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 5, 4, 3, 2, 1, 0

#: What begins a segment at each level. A match starts at the cut or, for all but turns, ends there.
_SPEAKERS = "user|human|customer|assistant|ai|bot|model|system|tool|tool_result|function"
_CUTS = {
    TURN: re.compile(rf"(?<=\s)(?=\[(?:{_SPEAKERS})\]\s?:)|^(?=(?:#+\s*|\*\*|<\|?)?(?:{_SPEAKERS})(?:\*\*|\|?>)?\s?:|<\|(?:im_start\|>)?(?:{_SPEAKERS}))", re.I | re.M),
    PARAGRAPH: re.compile(r"(?:\r?\n[ \t]*){2,}"),
    LINE: re.compile(r"\r?\n|\r|[  ]"),
    SENTENCE: re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*"),
    WORD: re.compile(r"\s+"),
}
_EXTENDS = re.compile(r"[̀-ͯ‌‍︀-️҃-҉֑-ֽؐ-ًؚ-़्ٟ\U0001f3fb-\U0001f3ff]")


def _cuts(text: str, lo: int, hi: int, level: int, fits: int) -> list[int]:
    if level == CHARACTER:
        out, at = [], lo + fits
        while at < hi:
            back = at
            while back > at - 16 and (_EXTENDS.match(text, back) or text[back - 1] == "‍" or text[back - 1 : back + 1] == "\r\n"):
                back -= 1
            at = back if back > at - 16 else at
            out.append(at)
            at += fits
        return out
    return [c for m in _CUTS[level].finditer(text, lo, hi) if lo < (c := m.end()) < hi]


def atoms(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, and the strength of the boundary before each. A unit that fits whole stays whole:
    merging weakest boundaries first would put it together again before any stronger boundary is looked at."""
    fits = limit - overlap
    starts, strengths = [0], [TURN + 1]
    todo = [(0, len(text), TURN, TURN + 1)]
    found: list[tuple[int, int]] = []
    while todo:
        lo, hi, level, strength = todo.pop()
        if lo:
            found.append((lo, strength))
        if hi - lo <= fits:
            continue
        while level >= CHARACTER and not (cuts := _cuts(text, lo, hi, level, fits)):
            level -= 1
        edges = [lo, *cuts, hi]
        todo += [(a, b, level - 1 if level else 0, strength if a == lo else level) for a, b in zip(edges, edges[1:]) if a != lo or level]
        if lo:  # its own start comes again with the first of its parts
            found.pop()
            if not level:
                found.append((lo, strength))
    for at, strength in sorted(found):
        if at >= overlap:  # the first piece must hold a full overlap for the next one
            starts.append(at)
            strengths.append(strength)
    return starts, strengths


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the pieces of text. Each piece but the first starts `overlap` characters before the end of the
    one before; no piece is longer than limit. An empty text has one empty piece, a text that fits is one piece."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    starts, strengths = atoms(text, limit, overlap)
    count = len(starts)
    left, right, end = list(range(-1, count - 1)), list(range(1, count + 1)), [*starts[1:], n]
    alive = [True] * count
    heap = [(strengths[i], end[i] - starts[i - 1], starts[i], i - 1, i) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        _, size, _, a, b = heapq.heappop(heap)
        if not alive[a] or not alive[b] or right[a] != b or size != end[b] - starts[a]:
            continue
        if size + (overlap if starts[a] else 0) > limit:
            continue
        alive[b] = False
        end[a], right[a] = end[b], right[b]
        if right[a] < count:
            left[right[a]] = a
            c = right[a]
            heapq.heappush(heap, (strengths[c], end[c] - starts[a], starts[c], a, c))
        if left[a] >= 0:
            heapq.heappush(heap, (strengths[a], end[a] - starts[left[a]], starts[a], left[a], a))
    return [(max(0, starts[i] - overlap) if starts[i] else 0, end[i]) for i in range(count) if alive[i]]


def piece_counts(items: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, n_chars, n_pieces of every row with a text; rows of a null text are left out. Nothing is shuffled."""
    schema = T.StructType([*items.select(*keys).schema, T.StructField("n_chars", T.LongType()), T.StructField("n_pieces", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            cols = [*batch.columns[: len(keys)], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(spans(t, limit, overlap)) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return items.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)


def pieces(items: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, text_key (a hash of the text, since rows of equal keys may carry different texts), piece_no (from 0), first (where
    the piece starts in the text, in code points), piece. Texts within the limit are one piece; null texts have none. Rows of
    equal keys and texts give their pieces once, null keys are keys like others. A text of any length is cut by itself, in
    time n log n."""
    keys = [*keys, "text_key"]
    items = items.withColumn("text_key", F.xxhash64(text))
    schema = T.StructType([*items.select(*keys).schema, T.StructField("piece_no", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, j, a, t[a:b]) for i, t in enumerate(batch.column(len(keys)).to_pylist()) for j, (a, b) in enumerate(spans(t, limit, overlap))]
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                took = pa.array([r[0] for r in part], pa.int64())
                cols = [c.take(took) for c in batch.columns[: len(keys)]]
                cols += [pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    cut_up = items.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)
    return cut_up.dropDuplicates([*keys, "piece_no"])


def rebuilt(cut_up: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, n_chars, fits, overlaps, text of each text that pieces() cut up: its pieces put together without what they
    repeat; fits tells that none is over the limit and that they aren't fewer than possible, overlaps that each later one
    starts with the last `overlap` characters of the one before. Pieces of one text meet in one row."""
    held = cut_up.groupBy(*keys, "text_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "first", "piece"))).alias("p"))
    own = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], overlap + 1, limit)))
    whole = held.select(*keys, "p", F.array_join(own, "").alias("text"))
    n = F.char_length("text").cast("bigint")
    after = F.slice("p", F.lit(2), F.size("p"))
    joined = F.forall(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), after, lambda a, b: F.right(a["piece"], F.lit(overlap)) == F.left(b["piece"], F.lit(overlap))), lambda ok: ok)
    fits = F.forall("p", lambda x: F.char_length(x["piece"]) <= limit) & (F.size("p") >= fewest_pieces(n, limit, overlap))
    return whole.select(*keys, n.alias("n_chars"), fits.alias("fits"), joined.alias("overlaps"), "text")


def fewest_pieces(n_chars: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The fewest pieces possible for n_chars characters."""
    more = F.ceil((n_chars - overlap) / F.lit(float(limit - overlap))).cast("bigint")
    return F.when(n_chars == 0, F.lit(0)).when(n_chars <= limit, F.lit(1)).otherwise(more).cast("bigint")


def oversized_and_miscounted(queue: DataFrame, runs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """record_type, record_id: `queue` items that were cut into several pieces, and `run` records that claim fewer than the
    transcript of their session's completed item can have. What the heap cuts at natural boundaries may be more than the
    fewest pieces possible, never less: a run is suspected if it claims fewer than these pieces, and an exact check by length
    follows. Runs without session or count and sessions without a completed transcript are not judged; repeated rows count
    once."""
    counts = piece_counts(queue, "transcript", ["id", "session_id", "status"], limit, overlap).where((F.col("n_pieces") > 1) | (F.lower(F.trim("status")) == "completed"))
    sizes = cut(counts.groupBy("id", "session_id").agg(F.max("n_chars").alias("n_chars"), F.max("n_pieces").alias("n_pieces"), F.max(F.lower(F.trim("status")) == "completed").alias("done")))
    large = sizes.where("n_pieces > 1").select(F.lit("queue").alias("record_type"), F.col("id").alias("record_id")).distinct()
    done = sizes.where("done").groupBy("session_id").agg(F.max("n_chars").alias("n_chars"), F.max("n_pieces").alias("n_pieces"))
    judged = runs.select("id", "session_id", "chunks_processed").where("chunks_processed is not null").join(done, "session_id")
    suspected = judged.where(F.col("chunks_processed") < F.col("n_pieces"))
    low = suspected.where(F.col("chunks_processed") < fewest_pieces(F.col("n_chars"), limit, overlap)).select(F.lit("run").alias("record_type"), F.col("id").alias("record_id")).distinct()
    return large.unionByName(low)
