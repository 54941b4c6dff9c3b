"""Retrieval: ranked signals, their fusion, decay and reranking.

A signal is a DataFrame (entity_type, entity_id, rank) with ranks from 0. Query sets of a stated size are broadcast in
blocks against all rows; vectors are compared in blocks with NumPy, and each task keeps only its best rows of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import scores

#: Query vectors that are broadcast at a time: 4096 * 4096 floats are 64 MB.
QUERY_BLOCK = 4096
#: Rows that are compared at a time, and documents that are compared vector by vector.
ROW_BLOCK, DOCUMENT_BLOCK = 2048, 64


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", include_self: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k rows with the largest cosine to each query, exactly. queries come in blocks of
    QUERY_BLOCK; of each block a task keeps only the k best rows, so a query costs k rows a task in the shuffle. Scores are
    rounded to twelve digits, and ties go to the smaller id. Rows with a null vector, or one of another length than the query's, have no score."""
    spark = rows.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator()
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    out = None
    while block := list(islice(asked, QUERY_BLOCK)):
        ids = [query_id for query_id, _ in block]
        shared = spark.sparkContext.broadcast((ids, _unit_vectors(pa.array([list(v) for _, v in block], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, of_length = shared.value
            best, kind = _Best(len(ids), k), None
            places: dict = {}
            for i, query_id in enumerate(ids):
                places.setdefault(query_id, []).append(i)
            for batch in batches:
                kind, keys = batch.column(0).type, batch.column(0).to_pylist()
                for n, (rows_of, units) in _unit_vectors(batch.column(1)).items():
                    if n not in of_length:
                        continue
                    asked, q = of_length[n]
                    at = {place: j for j, place in enumerate(asked)}
                    for lo in range(0, len(rows_of), ROW_BLOCK):
                        own = [keys[i] for i in rows_of[lo : lo + ROW_BLOCK]]
                        scored = q @ units[lo : lo + ROW_BLOCK].T
                        if not include_self:
                            for column, key_ in enumerate(own):
                                for place in places.get(key_, ()):
                                    if place in at:
                                        scored[at[place], column] = -np.inf
                        best.add(asked, own, scored, 12)
            if kind is not None:
                yield best.batch(ids, kind, schema.names)

        near = rows.select(key, vector).mapInArrow(run, schema)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def as_signal(ranked: DataFrame, entity_type: str, entity_id: str, order: list[Column], limit: int) -> DataFrame:
    """entity_type, entity_id, rank of the first `limit` rows in an order: a top-k without a window over all rows."""
    best = ranked.orderBy(*order).limit(limit)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return best.withColumn("rank", F.row_number().over(w) - 1).select(F.lit(entity_type).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), "rank")


def fuse(signals: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """entity_type, entity_id, score, contributions (signal, rank, share; largest share first): weighted reciprocal rank
    fusion. A signal without a weight counts with 1, one with weight 0 adds nothing."""
    rows = None
    for name, signal in signals.items():
        each = signal.select("entity_type", "entity_id", F.lit(name).alias("signal"), "rank", scores.rrf(weights.get(name, 1.0), F.col("rank")).alias("share"))
        rows = each if rows is None else rows.unionByName(each)
    held = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("minus"), "signal", "rank")))
    out = rows.groupBy("entity_type", "entity_id").agg(F.sum("share").alias("score"), held.alias("c"))
    return out.select("entity_type", "entity_id", "score", F.transform("c", lambda x: F.struct(x["signal"].alias("signal"), x["rank"].alias("rank"), (-x["minus"]).alias("share"))).alias("contributions"))


def top(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "entity_type", "entity_id").limit(limit)


def attribution(signals: dict[str, DataFrame]) -> DataFrame:
    """entity_id, signals: which signals brought each entity, in the order of their names."""
    rows = None
    for name, signal in signals.items():
        each = signal.select("entity_id", F.lit(name).alias("signal"))
        rows = each if rows is None else rows.unionByName(each)
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def hydrate(fused: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """fused with title and content of the entities (entity_type, entity_id, title, content, last_accessed_at, access_count,
    feedback_boost, superseded_by, valid_until), decayed and boosted. Stale entities drop out, after whatever limit was set."""
    from siltstone.operators.entities import is_stale

    rows = fused.join(entities, ["entity_type", "entity_id"]).where(~is_stale(F.col("superseded_by"), F.col("valid_until"), as_of))
    decayed = scores.decay_and_boost(F.col("score"), F.col("last_accessed_at"), F.col("access_count"), F.col("feedback_boost"), F.lit(as_of).cast("timestamp"))
    return rows.withColumn("score", decayed)


def graph_signal(seeds: DataFrame, edges: DataFrame, limit: int, most_seeds: int = 10) -> DataFrame:
    """entity_id, rank: what the first seeds (node, seed_rank) lead to in one step; the earliest seed finds it, seeds don't count."""
    first = seeds.where(F.col("seed_rank") < most_seeds)
    hits = first.join(edges.withColumnRenamed("source", "node"), "node").select("seed_rank", F.col("target").alias("entity_id"), "weight")
    found = hits.groupBy("entity_id").agg(F.min(F.struct("seed_rank", (-F.col("weight")).alias("w"))).alias("m")).join(first.select(F.col("node").alias("entity_id")), "entity_id", "left_anti")
    best = found.select("entity_id", (-F.col("m.w")).alias("score")).orderBy(F.desc("score"), "entity_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "entity_id")) - 1)


def token_overlap(query: str) -> Callable[[Column], Column]:
    """A deterministic stand-in for a cross-encoder: shared words by all words."""
    words = sorted({w for w in query.lower().split() if w})

    def score(text: Column) -> Column:
        own = F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), lambda w: w != ""))
        q = F.array(*map(F.lit, words)).cast("array<string>")
        return F.size(F.array_intersect(own, q)) / F.nullif(F.size(F.array_union(own, q)), F.lit(0))

    return score


def rerank(results: DataFrame, text: str, cross: Callable[[Column], Column], judge: Callable[[Column], Column] | None = None, judged: int = 20) -> DataFrame:
    """results with final = 0.2 first-stage + 0.8 cross score, or 0.2, 0.5 and 0.3 with a judge, who sees the `judged` best by
    cross score; all scaled to 0..1 over the results first. Results are a top-k, so one window over them is small."""
    one = Window.partitionBy(F.lit(0))
    rows = results.withColumn("__cross", F.coalesce(cross(F.col(text)), F.lit(1.0)))
    scaled = lambda c: scores.minmax(F.col(c), F.min(c).over(one), F.max(c).over(one))
    rows = rows.withColumns({"__b": scaled("score"), "__c": scaled("__cross")})
    if judge is None:
        rows = rows.withColumn("final", 0.2 * F.col("__b") + 0.8 * F.col("__c"))
    else:
        rows = rows.withColumn("__r", F.row_number().over(one.orderBy(F.desc("__cross"), "entity_id")))
        rows = rows.withColumn("__j", F.when(F.col("__r") <= judged, F.coalesce(judge(F.col(text)), F.lit(0.5))).otherwise(0.0))
        rows = rows.withColumn("final", 0.2 * F.col("__b") + 0.5 * F.col("__c") + 0.3 * F.col("__j"))
    return rows.drop("__cross", "__b", "__c", "__r", "__j").orderBy(F.desc("final"), "entity_id")


def rag_fusion(rankings: list[DataFrame], limit: int) -> DataFrame:
    """Rankings of several phrasings of a query, fused with equal weights."""
    return top(fuse({f"q{i}": r for i, r in enumerate(rankings)}, {}), limit)


def _unit_vectors(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors of an array of vectors. Vectors that are null or empty, or that hold a null, are left
    out. Values come from Arrow's buffers as they are."""
    sizes = np.where(np.asarray(vectors.is_null()), 0, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = vectors.flatten()
    ends = np.cumsum(sizes)
    starts, holes = ends - sizes, np.zeros(len(values) + 1, dtype=np.int64)
    if values.null_count:
        holes[1:] = np.cumsum(np.asarray(values.is_null()))
        values = values.fill_null(0)
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
    whole = (sizes > 0) & (holes[ends] == holes[starts])
    out = {}
    for n in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == n))
        out[n] = (at, _unit(numbers[starts[at][:, None] + np.arange(n)]))
    return out


def _grouped(groups: pa.ListArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """How many vectors each group has, and by length of vectors: unit vectors of all groups, in order, and the group of each."""
    sizes = np.where(np.asarray(groups.is_null()), 0, groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return sizes, {n: (units, of[at]) for n, (at, units) in _unit_vectors(groups.flatten()).items()}


class _Best:
    """The k best of each query so far; ties go to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.held: list[tuple[np.ndarray, np.ndarray, list]] = []
        self.waiting = 0

    def add(self, asked: np.ndarray, keys: list, scored: np.ndarray, digits: int) -> None:
        """scored: a row for each place in asked, a column for each key."""
        rounded = np.round(scored, digits)
        m, k = rounded.shape[1], min(self.k, rounded.shape[1])
        least = np.partition(rounded, m - k, axis=1)[:, m - k : m - k + 1]
        row, column = np.nonzero((rounded >= least) & (rounded > -np.inf))
        self.held.append((np.asarray(asked)[row], rounded[row, column], [keys[c] for c in column]))
        self.waiting += len(row)
        if self.waiting > 8 * self.k * self.queries + 100_000:
            self.settle()

    def settle(self) -> None:
        query = np.concatenate([q for q, _, _ in self.held]) if self.held else np.zeros(0, dtype=np.int64)
        score = np.concatenate([s for _, s, _ in self.held]) if self.held else np.zeros(0)
        keys = [x for _, _, own in self.held for x in own]
        order = np.lexsort((np.array(keys), -score, query)) if keys else np.zeros(0, dtype=np.int64)
        query, score = query[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        near = rank < self.k
        self.held = [(query[near], score[near], [keys[i] for i in order[near]])]
        self.waiting = int(near.sum())

    def batch(self, ids: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        self.settle()
        query, score, keys = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query], kind), pa.array(keys, kind), pa.array(score)], names=names)


def _max_sims(queries: int, of_query: dict[int, tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, of_doc: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """MaxSim of queries and documents; vectors that don't go together have a cosine of 0, as in functions.vectors.max_sim."""
    out = np.zeros((queries, len(sizes)))
    for n, (q, qs) in of_query.items():
        if n not in of_doc:
            continue
        d, ds = of_doc[n]
        sims = q @ d.T
        best = np.zeros((len(q), len(sizes)))
        starts = np.flatnonzero(np.r_[True, ds[1:] != ds[:-1]])
        best[:, ds[starts]] = np.maximum.reduceat(sims, starts, axis=1)
        mixed = np.bincount(ds, minlength=len(sizes)) < sizes
        best[:, mixed] = np.maximum(best[:, mixed], 0)
        np.add.at(out, qs, best)
    return out


def _blocks(asked: Iterator) -> Iterator[list]:
    """Rows (id, vectors) in lists of QUERY_BLOCK vectors at most, or of a single row."""
    block, size = [], 0
    for query_id, vectors in asked:
        if block and size + len(vectors) > QUERY_BLOCK:
            yield block
            block, size = [], 0
        block.append((query_id, vectors))
        size += len(vectors)
    if block:
        yield block


def late_interaction(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k documents with the largest sum over the query's vectors of the best cosine among the
    document's, exactly. queries and documents: id, vectors (array of arrays); one without vectors takes no part. Queries come
    in blocks of QUERY_BLOCK vectors and are compared with all documents; a task keeps only the k best of each query. Ties go to
    the smaller id."""
    spark = documents.sparkSession
    usable = F.col("id").isNotNull() & (F.size("vectors") > 0)
    asked = queries.where(usable).select("id", "vectors").toLocalIterator()
    kind = documents.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    out = None
    for block in _blocks(asked):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = zip(*shared.value)
            _, of_query = _grouped(pa.array([[None if v is None else list(v) for v in vs] for vs in vectors], pa.list_(pa.list_(pa.float64()))))
            best, kind, places = _Best(len(ids), k), None, np.arange(len(ids))
            for batch in batches:
                kind = batch.column(0).type
                for part in (batch.slice(i, DOCUMENT_BLOCK) for i in range(0, batch.num_rows, DOCUMENT_BLOCK)):
                    sizes, of_doc = _grouped(part.column(1))
                    best.add(places, part.column(0).to_pylist(), _max_sims(len(ids), of_query, sizes, of_doc), 9)
            if kind is not None:
                yield best.batch(list(ids), kind, schema.names)

        near = documents.where(usable).select("id", "vectors").mapInArrow(run, schema)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def agentic(search: Callable[[str], DataFrame], refine: Callable[[str, DataFrame], str | None], query: str, hops: int = 3) -> DataFrame:
    """Results of a query and of its refinements, until refine says None; of an entity found again the first result counts."""
    out = None
    for hop in range(hops):
        found = search(query).withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        following = refine(query, found)
        if following is None:
            break
        query = following
    w = Window.partitionBy("entity_id").orderBy("hop", F.desc("score"))
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").orderBy(F.desc("score"), "entity_id")


def cache_key(query: Column, project: Column, rerank_: Column, hyde: Column, limit: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(query)), F.coalesce(project, F.lit("")), rerank_.cast("string"), hyde.cast("string"), limit.cast("string"))
