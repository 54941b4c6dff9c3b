"""Hybrid search: six signals over five types of entities, fused by weights that go by the type of the query, then hydrated,
decayed and reranked.

A signal ranks at most three times as many entities as are asked for, so whatever meets in one task afterwards is small. Full
text, vectors and cues are scans with a top-k; the graph is asked for the edges of ten seeds, the tree for the leaves of the
nodes that were hit.
"""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scores, vectors
from siltstone.functions.text import QUERY_SIGNS, SIGNAL_WEIGHTS, STOP_WORDS
from siltstone.operators import entities as E
from siltstone.operators import fts, graph, tree
from siltstone.operators import retrieval as R

#: Types with full text, types that grow stale and decay, and of these the one that doesn't fall back on its creation.
SEARCHED = ("knowledge_item", "episode", "procedure")
DECAYING, NO_FALLBACK = ("knowledge_item", "episode", "procedure"), "knowledge_item"
MOST_SEEDS, FETCH = 10, 3


@dataclass(frozen=True)
class Corpus:
    """entities: entity_type, entity_id, title, content, project_id, cues (array), last_accessed_at, access_count,
    feedback_boost, superseded_by, valid_until, created_at. vectors: entity_type, entity_id, embedding. tokens: entity_type,
    entity_id, vectors (array of vectors). edges: source, target, weight, with ends named "type:id". nodes: id, level,
    parent_id, entity_type, entity_id of a tree, and node_vectors: id, embedding of its inner nodes; both may be absent."""

    entities: DataFrame
    vectors: DataFrame
    tokens: DataFrame
    edges: DataFrame
    nodes: DataFrame | None = None
    node_vectors: DataFrame | None = None

    def of_project(self, project: str) -> Corpus:
        own = self.entities.where(F.col("project_id") == project)
        ids = own.select("entity_type", "entity_id")
        near = lambda rows: rows.join(ids, ["entity_type", "entity_id"], "left_semi")
        return replace(self, entities=own, vectors=near(self.vectors), tokens=near(self.tokens))


def query_type(query: str) -> str:
    """As functions.text.classify_query, of one query."""
    low = query.lower()
    return next((kind for kind, signs in QUERY_SIGNS.items() if any(s in low for s in signs)), "semantic")


def query_cues(query: str) -> list[str]:
    """As functions.text.extract_cues, of one query."""
    return [w for w in re.split(r"[^\w-]+", query.lower()) if len(w.encode()) >= 3 and w not in STOP_WORDS]


def weights_of(kind: str, learned: dict[str, float] | None = None) -> dict[str, float]:
    """Weights by signal; late interaction counts as the dense signal does."""
    w = learned or SIGNAL_WEIGHTS[kind]
    return {"fts": w["fts"], "dense": w["dense"], "late": w["dense"], "graph": w["graph"], "raptor": w["raptor"], "cue": w["cue"]}


def _ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """entity_type, entity_id, rank of the first rows; ties go by type and id."""
    order = [*order, F.asc("entity_type"), F.asc("entity_id")]
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(w) - 1).select("entity_type", "entity_id", "rank")


def _held(ranked: DataFrame) -> DataFrame:
    """A signal as local rows: it has few, by its limit, and is asked for more than once."""
    return ranked.sparkSession.createDataFrame(ranked.collect(), ranked.schema)


def _ends(node: str) -> list[Column]:
    """entity_type and entity_id of a name "type:id"."""
    return [F.substring_index(node, ":", 1).alias("entity_type"), F.regexp_replace(node, "^[^:]*:", "").alias("entity_id")]


def _vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _full_text(corpus: Corpus, query: str, limit: int) -> DataFrame:
    out = None
    for kind in SEARCHED:
        own = corpus.entities.where(F.col("entity_type") == kind)
        each = fts.search(own, "entity_id", {"A": "title", "B": "content"}, query, limit).select(F.lit(kind).alias("entity_type"), "entity_id", "score")
        out = each if out is None else out.unionByName(each)
    return _ranked(out, [F.desc(F.round("score", 9))], limit)


def _tree_signal(corpus: Corpus, asked: Column, limit: int) -> DataFrame:
    """Leaves under the tree's nodes among the vectors nearest to the query; without any such node, the tree's first leaves."""
    near = corpus.vectors.select("entity_type", "entity_id", F.lit(None).cast("string").alias("id"), "embedding")
    near = near.unionByName(corpus.node_vectors.select(F.lit("raptor_node").alias("entity_type"), F.col("id").alias("entity_id"), "id", "embedding"))
    scored = near.select("entity_type", "entity_id", "id", F.round(vectors.cosine(F.col("embedding"), asked), 9).alias("score"))
    best = scored.orderBy(F.desc("score"), "entity_type", "entity_id").limit(FETCH * limit)
    hits = [r["id"] for r in best.where("id is not null").orderBy(F.desc("score"), "id").collect()]
    if not hits:
        return _ranked(corpus.nodes.where("level = 0"), [F.asc("id")], limit)
    found = corpus.nodes.sparkSession.createDataFrame(list(zip(hits, range(len(hits)))), "id string, rank int")
    return _ranked(tree.expand(found, corpus.nodes, limit), [F.asc("rank")], limit)


def signals(corpus: Corpus, query: str, vector: list[float], tokens: list[list[float]], limit: int = 10, weights: dict[str, float] | None = None, graph_expand: bool = True) -> dict[str, DataFrame]:
    """The six signals (entity_type, entity_id, rank) of a query. Cues are asked only where their weight is above 0; a query
    without cues, a corpus without a tree and a query without seeds leave their signal out."""
    most = FETCH * limit
    weights = weights or weights_of(query_type(query))
    asked, spark = _vector(vector), corpus.entities.sparkSession
    near = corpus.vectors.select("entity_type", "entity_id", F.round(vectors.cosine(F.col("embedding"), asked), 9).alias("score"))
    said = spark.createDataFrame([("", tokens)], "id string, vectors array<array<double>>")
    late = R.late_interaction(said, corpus.tokens.select(F.concat_ws(":", "entity_type", "entity_id").alias("id"), "vectors"), most).select(*_ends("id"), "rank")
    out = {"fts": _held(_full_text(corpus, query, most)), "dense": _held(_ranked(near, [F.desc("score")], most)), "late": _held(late)}
    if graph_expand:
        first = [(f"{r.entity_type}:{r.entity_id}") for s in ("fts", "dense") for r in out[s].where(F.col("rank") < MOST_SEEDS).orderBy("rank").collect()][:MOST_SEEDS]
        seeds = list(dict.fromkeys(first))
        if seeds:
            found = R.graph_signal(spark.createDataFrame(list(zip(seeds, range(len(seeds)))), "node string, seed_rank int"), corpus.edges, most, MOST_SEEDS)
            out["graph"] = found.select(*_ends("entity_id"), "rank")
    if corpus.nodes is not None:
        out["raptor"] = _tree_signal(corpus, asked, most)
    cues = query_cues(query)
    if weights["cue"] > 0 and cues:
        told = E.cue_search(corpus.entities.where("entity_type = 'episode'").withColumn("id", F.col("entity_id")), {"cues": cues})
        out["cue"] = _ranked(told, [F.desc_nulls_last("created_at")], most)
    return out


def hydrated(fused: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """fused with the title, content and project of its entities. Items, episodes and procedures drop out when they are stale
    and their scores decay, the latter two since their creation if they were never read; memories and reflections stay as they are."""
    rows = fused.join(entities, ["entity_type", "entity_id"])
    decays = F.col("entity_type").isin(*DECAYING)
    last = F.when(F.col("entity_type") == NO_FALLBACK, F.col("last_accessed_at")).otherwise(F.coalesce("last_accessed_at", "created_at"))
    decayed = scores.decay_and_boost(F.col("score"), last, F.col("access_count"), F.col("feedback_boost"), F.lit(as_of).cast("timestamp"))
    kept = rows.where(~(decays & E.is_stale(F.col("superseded_by"), F.col("valid_until"), as_of)))
    return kept.withColumn("score", F.when(decays, decayed).otherwise(F.col("score"))).orderBy(F.desc("score"), "entity_type", "entity_id")


def search(corpus: Corpus, query: str, embed: Callable[[str], tuple[list[float], list[list[float]]]], as_of: str, limit: int = 10, project: str | None = None, hyde: Callable[[str], str] | None = None, learned: dict[str, float] | None = None) -> DataFrame:
    """entity_type, entity_id, score, title, content, project_id, signals: the results of a query. embed gives a text's vector
    and those of its words; with hyde the vectors are those of a document that would answer the query, of the query itself if
    that fails. learned replaces the weights of the query's type."""
    held = corpus if project is None else corpus.of_project(project)
    text = query
    if hyde is not None:
        try:
            text = hyde(query) or query
        except Exception:  # a model that can't be reached costs the better vector, not the search
            text = query
    weights = weights_of(query_type(query), learned)
    vector, _ = embed(text)
    found = signals(held, query, vector, embed(query)[1], limit, weights)
    best = R.top(R.fuse(found, weights).withColumn("score", F.round("score", 12)), limit)
    out = hydrated(best, held.entities, as_of)
    named = F.array_sort(F.transform("contributions", lambda c: c["signal"]))
    return out.select("entity_type", "entity_id", "score", "title", "content", "project_id", named.alias("signals"))


def outside_project(results: DataFrame, project: str) -> DataFrame:
    """Results of other projects, and of none."""
    return results.where(~F.coalesce(F.col("project_id") == project, F.lit(False)))


def search_log(results: DataFrame, query: str, kind: str, project: str | None, as_of: str) -> DataFrame:
    """One row for the log: query, query_type, project_id, result_ids in their order, clicked_ids, signal_sources (result to
    signals) and created_at. Results are a top-k, so they fit one row."""
    held = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "entity_id", "signals")))
    row = results.agg(held.alias("r"))
    return row.select(
        F.lit(query).alias("query"), F.lit(kind).alias("query_type"), F.lit(project).cast("string").alias("project_id"),
        F.transform("r", lambda x: x["entity_id"]).alias("result_ids"), F.expr("cast(array() as array<string>)").alias("clicked_ids"),
        F.map_from_entries(F.transform("r", lambda x: F.struct(x["entity_id"], x["signals"]))).alias("signal_sources"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def latest_explanation(log: DataFrame, query: str) -> DataFrame:
    """The newest row of the log for a query; none if it was never asked."""
    return log.where(F.col("query") == query).orderBy(F.desc("created_at")).limit(1)


def relations(edges: DataFrame, node: str, depth: int = 1, direction: str = "both", min_weight: float = 0.0) -> DataFrame:
    """What a node is related to: its edges, or for a depth above one what can be reached from it."""
    if depth <= 1:
        return graph.edges_of(edges, node, direction)
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    return graph.explore(edges, start, depth, min_weight)


class Recent:
    """Results by key for a while: at most `most` of them, the oldest goes first. Results of searches are kept for 60 seconds,
    100 of them, answers of rerankers for 600, 500 of them."""

    def __init__(self, seconds: float = 60.0, most: int = 100, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key: str, value) -> None:
        self.held.pop(key, None)
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = (self.clock(), value)
