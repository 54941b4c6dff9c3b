"""Queries of retrieval, graphs and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import clustering as C
from siltstone.operators import entities as E
from siltstone.operators import fts
from siltstone.operators import graph as G
from siltstone.operators import retrieval as R
from siltstone.queries.inputs import EDGES, edges
from siltstone.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


QUESTION = "nightly cache OR planner"


def _words(col: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def _rank(fields: dict[str, str], terms: list[str]) -> str:
    weight = {"A": "1.0", "B": "0.4", "C": "0.2"}
    parts = []
    for cls, col in fields.items():
        for t in terms:
            n = f"len(list_filter({col}, lambda w: w = '{t}'))"
            parts.append(f"CASE WHEN {n} > 0 THEN {weight[cls]}::DOUBLE * (1 + ln({n}::DOUBLE)) ELSE 0.0::DOUBLE END")
    return " + ".join(parts)


_TITLE_BODY = {"A": "tw", "B": "cw"}
_MATCH = "list_contains(list_concat(tw, cw), 'nightly') AND (list_contains(list_concat(tw, cw), 'cache') OR list_contains(list_concat(tw, cw), 'planner'))"


def _has(*words: str) -> str:
    return " AND ".join(f"list_contains(list_concat(tw, cw), '{w}')" for w in words)


def _fts_sql(kind: str, table_: str) -> str:
    words = f"any_value({_words('title')}) AS tw, any_value({_words('content')}) AS cw"
    return f"SELECT '{kind}' AS entity_type, id AS entity_id, {_rank(_TITLE_BODY, ['cache', 'nightly', 'planner'])} AS score FROM (SELECT id, {words} FROM {table_} GROUP BY id) WHERE {_MATCH}"


def _distinct(s: SparkSession, d: str, name: str) -> DataFrame:
    """One row for each id: of an id's versions the least title, with the content that goes with it."""
    return table(s, d, name).groupBy("id").agg(F.min(F.struct("title", "content")).alias("m")).select("id", "m.title", "m.content")


@query(f"WITH f AS ({_fts_sql('knowledge_item', 'knowledge_items')}) SELECT entity_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, entity_id LIMIT 20")
def fts_topk(s: SparkSession, d: str) -> DataFrame:
    out = fts.search(_distinct(s, d, "knowledge_items"), "id", {"A": "title", "B": "content"}, QUESTION)
    return out.select(F.col("id").alias("entity_id"), F.round("score", 6).alias("score"))


@query(f"WITH f AS ({_fts_sql('knowledge_item', 'knowledge_items')}) SELECT entity_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, entity_id LIMIT 20")
def fts_indexed(s: SparkSession, d: str) -> DataFrame:
    """As fts_topk, from an inverted index."""
    indexed = fts.index(_distinct(s, d, "knowledge_items"), "id", {"A": "title", "B": "content"})
    return fts.search_index(indexed, "id", QUESTION).select(F.col("id").alias("entity_id"), F.round("score", 6).alias("score"))


@query(f"WITH a AS ({_fts_sql('knowledge_item', 'knowledge_items')} ORDER BY score DESC, entity_id LIMIT 3), b AS ({_fts_sql('procedure', 'procedures')} ORDER BY score DESC, entity_id LIMIT 3), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT entity_type, entity_id AS id, round(score, 6) AS score FROM u ORDER BY u.score DESC, entity_type, entity_id LIMIT 3")
def proactive_search(s: SparkSession, d: str) -> DataFrame:
    fields = {"A": "title", "B": "content"}
    tables = {"knowledge_item": (_distinct(s, d, "knowledge_items"), "id", fields), "procedure": (_distinct(s, d, "procedures"), "id", fields)}
    return fts.union_search(tables, QUESTION).withColumn("score", F.round("score", 6))


@query("SELECT id, role FROM session_messages WHERE regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])stale[^\\p{L}\\p{N}_]+lease($|[^\\p{L}\\p{N}_])') AND NOT regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}_])cursor($|[^\\p{L}\\p{N}_])')")
def message_search(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "session_messages")
    q = fts.parse('"stale lease" -cursor')
    return rows.where(F.lower("content").contains("lease")).where(fts.matches(fts.tokens(F.col("content")), q)).select("id", "role")


@query(f"WITH d AS (SELECT doc_id, replace(text, 'İ', 'i') AS text FROM documents), w AS (SELECT doc_id, unnest({_words('text')}) AS term FROM d) SELECT term, doc_id, count(*) AS tf FROM w GROUP BY 1, 2")
def postings(s: SparkSession, d: str) -> DataFrame:
    """The index over documents of all languages."""
    return fts.postings(table(s, d, "documents"), "doc_id", "text").select("term", "doc_id", "tf")


_KNN = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) - 1 AS rank FROM s)
"""


@query(_KNN + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank < 10")
def knn_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    out = R.knn(e.where("vec_id % 50 = 0"), e, 10)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_KNN + "SELECT query_id, id FROM r WHERE rank < 4 AND score > 0.2")
def similar_entities(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return R.knn(e.where("vec_id % 50 = 0"), e, 4).where("score > 0.2").select("query_id", "id")


@query("""WITH m AS (SELECT q.vec_id // 10 AS query_id, v.vec_id // 10 AS id, q.vec_id AS qv, max(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings v WHERE (q.vec_id // 10) % 50 = 0 GROUP BY 1, 2, 3),
t AS (SELECT query_id, id, sum(best) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM t)
SELECT query_id, id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank < 5""")
def maxsim(s: SparkSession, d: str) -> DataFrame:
    """Documents are the groups of ten vectors by id, queries those whose number is divisible by 50."""
    e = table(s, d, "embeddings")
    docs = e.groupBy(F.floor(F.col("vec_id") / 10).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return R.late_interaction(docs.where("id % 50 = 0"), docs, 5).withColumn("score", F.round("score", 5))


@query("WITH w AS (SELECT id, " + _words("title") + " AS tw, " + _words("content") + " AS cw FROM (SELECT id, max(title) AS title, max(content) AS content FROM knowledge_items GROUP BY 1)), " + ", ".join(
    f"s{i} AS (SELECT id, round({_rank(_TITLE_BODY, terms)}, 9) AS score FROM w WHERE {cond}), r{i} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM s{i})"
    for i, (terms, cond) in enumerate([(["cache", "nightly", "planner"], _MATCH), (["nightly", "planner"], _has("nightly", "planner")), (["cache", "planner"], _has("cache", "planner"))])
) + ", u AS (" + " UNION ALL ".join(f"SELECT id, 1.0::DOUBLE / (61 + rank) AS x FROM r{i} WHERE rank < 30" for i in range(3)) + ") SELECT id AS entity_id, round(sum(x), 9) AS score FROM u GROUP BY 1 ORDER BY sum(x) DESC, id LIMIT 10")
def rag_fusion(s: SparkSession, d: str) -> DataFrame:
    items = _distinct(s, d, "knowledge_items")
    rankings = [R.as_signal(fts.search(items, "id", {"A": "title", "B": "content"}, q, 30), "knowledge_item", "id", [F.desc(F.round("score", 9)), F.asc("id")], 30) for q in (QUESTION, "nightly planner", "cache planner")]
    return R.rag_fusion(rankings, 10).select("entity_id", F.round("score", 9).alias("score"))


@query("WITH" + EDGES + """, seeds(node, r) AS (VALUES ('view-1', 0), ('click-2', 1), ('error-3', 2)),
h AS (SELECT target, r, weight FROM edges JOIN seeds ON source = node WHERE target NOT IN (SELECT node FROM seeds)),
b AS (SELECT target AS entity_id, arg_min(-weight, (r, -weight)) AS w FROM h GROUP BY 1)
SELECT entity_id, (row_number() OVER (ORDER BY -w DESC, entity_id) - 1)::INT AS rank FROM b QUALIFY row_number() OVER (ORDER BY -w DESC, entity_id) <= 30""")
def graph_signal(s: SparkSession, d: str) -> DataFrame:
    seeds = s.createDataFrame([("view-1", 0), ("click-2", 1), ("error-3", 2)], "node string, seed_rank int")
    return R.graph_signal(seeds, edges(s, d), 30).select("entity_id", "rank")


@query("WITH" + EDGES + """, e AS (SELECT source, target, max(weight) AS weight FROM edges WHERE weight >= 0.5 GROUP BY 1, 2), seeds(node) AS (VALUES ('view-1'), ('click-2')),
l1 AS (SELECT s.node AS seed, target AS node, weight AS score, row_number() OVER (PARTITION BY s.node ORDER BY weight DESC, target) AS ord FROM seeds s JOIN e ON e.source = s.node WHERE target <> s.node),
l2a AS (SELECT seed, e.target AS node, l1.score * e.weight AS score, row_number() OVER (PARTITION BY seed, e.target ORDER BY ord, e.weight DESC) AS rn FROM l1 JOIN e ON e.source = l1.node
  WHERE e.target <> seed AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.seed = l1.seed AND x.node = e.target))
SELECT seed, node, 1 AS depth, round(score, 6) AS score FROM l1 UNION ALL SELECT seed, node, 2, round(score, 6) FROM l2a WHERE rn = 1""")
def graph_explore(s: SparkSession, d: str) -> DataFrame:
    seeds = s.createDataFrame([("view-1",), ("click-2",)], "node string")
    return G.explore(edges(s, d), seeds, 2, 0.5).withColumn("score", F.round("score", 6))


def _chain_sql() -> str:
    """Five hops, each the heaviest causal edge to a node that isn't on the path yet."""
    hops = ["c0 AS (SELECT DISTINCT source AS start, source AS cur, [source] AS path, 1.0::DOUBLE AS score FROM edges)"]
    for h in range(1, 6):
        hops.append(f"c{h} AS (SELECT start, target AS cur, list_append(path, target) AS path, score * weight AS score FROM c{h - 1} JOIN b ON source = cur WHERE NOT list_contains(path, target) QUALIFY row_number() OVER (PARTITION BY start ORDER BY weight DESC, target) = 1)")
    best = "b AS (SELECT source, target, max(weight) AS weight FROM edges WHERE relation IN ('led_to', 'caused', 'triggered', 'caused_by', 'resolved_by', 'preceded_by') GROUP BY 1, 2)"
    return "WITH" + EDGES + ", " + best + ", " + ", ".join(hops) + " UNION ALL ".join(f" SELECT start, {h} AS hop, cur AS node, round(score, 6) AS score FROM c{h}" for h in range(1, 6))


@query(_chain_sql())
def causal_chain(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return G.causal_chain(e, e.select(F.col("source").alias("node")).distinct()).withColumn("score", F.round("score", 6))


@query("WITH" + EDGES + "SELECT source, target, relation, round(weight * 0.95::DOUBLE, 6) AS weight FROM edges WHERE weight * 0.95::DOUBLE >= 0.05")
def edge_decay(s: SparkSession, d: str) -> DataFrame:
    return G.edge_decay(edges(s, d)).select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query("WITH" + EDGES + "SELECT source, target, relation, round(weight, 6) AS weight FROM edges WHERE source = 'view-1' OR target = 'view-1'")
def get_edges(s: SparkSession, d: str) -> DataFrame:
    return G.edges_of(edges(s, d), "view-1").select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query("WITH" + EDGES + """, t AS (SELECT CASE WHEN source = 'view-1' THEN 'view-0' ELSE source END AS source, CASE WHEN target = 'view-1' THEN 'view-0' ELSE target END AS target, relation, weight, usage_count FROM edges)
SELECT source, target, relation, round(max(weight), 6) AS weight, sum(usage_count)::BIGINT AS usage_count FROM t WHERE source <> target GROUP BY 1, 2, 3""")
def edge_transfer(s: SparkSession, d: str) -> DataFrame:
    moved = s.createDataFrame([("view-1", "view-0")], "old_id string, new_id string")
    return G.transfer_edges(edges(s, d), moved).withColumn("weight", F.round("weight", 6))


@query("""WITH RECURSIVE l AS (SELECT id, max(superseded_by) AS nxt FROM knowledge_items WHERE superseded_by IS NOT NULL AND superseded_by <> id GROUP BY 1),
c AS (SELECT id AS root, id, 1 AS version FROM l WHERE id NOT IN (SELECT nxt FROM l) UNION ALL SELECT root, nxt, version + 1 FROM c JOIN l ON l.id = c.id WHERE version < 50) SELECT root, id, version FROM c""")
def evolution_chain(s: SparkSession, d: str) -> DataFrame:
    return G.evolution_chain(table(s, d, "knowledge_items"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT source || '/' || lang AS id, source AS parent_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT DISTINCT source, 'all' FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION SELECT 'all', NULL),
c AS (SELECT id AS node, id AS leaf FROM n WHERE id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL) UNION ALL SELECT n.parent_id, leaf FROM c JOIN n ON n.id = c.node WHERE n.parent_id IS NOT NULL) SELECT node, leaf FROM c""")
def raptor_leaves(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("source is not null and lang is not null")
    tree = docs.select(F.concat_ws("/", "source", "lang").alias("id"), F.col("source").alias("parent_id")).unionByName(docs.select(F.col("source").alias("id"), F.lit("all").alias("parent_id"))).distinct()
    return G.leaves_of(tree.unionByName(s.createDataFrame([("all", None)], "id string, parent_id string")))


@query()
def label_propagation(s: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(edges(s, d))


@query()
def cluster_groups(s: SparkSession, d: str) -> DataFrame:
    return G.cluster_groups(G.synchronous_labels(edges(s, d)))


@query("WITH RECURSIVE" + EDGES + """, u AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges),
r AS (SELECT DISTINCT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def graph_components(s: SparkSession, d: str) -> DataFrame:
    return G.components(edges(s, d))


@query("SELECT DISTINCT id AS source, session_id AS target, 'produced_by' AS relation FROM learning_runs WHERE session_id IS NOT NULL")
def session_edges(s: SparkSession, d: str) -> DataFrame:
    return G.session_edges(table(s, d, "learning_runs"), "session_id").select("source", "target", "relation").distinct()


@query()
def greedy_clusters(s: SparkSession, d: str) -> DataFrame:
    return C.greedy_clusters(table(s, d, "embeddings"), "label", ["vec_id"], threshold=0.1)


@query()
def kmeans_clusters(s: SparkSession, d: str) -> DataFrame:
    return C.kmeans(table(s, d, "embeddings"), 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), k AS (SELECT embedding AS e FROM embeddings WHERE vec_id % 50 <> 0)
SELECT vec_id FROM n WHERE (SELECT max(list_cosine_similarity(n.embedding::DOUBLE[], e::DOUBLE[])) FROM k) <= 0.6""")
def vector_dedup(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return C.dedup_against(e.where("vec_id % 50 = 0"), e.where("vec_id % 50 <> 0"), 0.6, "vec_id").select("vec_id")


@query("""WITH t AS (SELECT DISTINCT lower(title) AS t FROM knowledge_items WHERE project_id IS NOT NULL),
w AS (SELECT t, list_filter(string_split_regex(t, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT t, list_distinct(flatten(list_transform(w, lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i, 3))))) AS g FROM w),
p AS (SELECT a.t AS ta, b.t AS tb FROM g a, g b WHERE a.t = b.t OR len(list_intersect(a.g, b.g)) > 0.4 * len(list_distinct(list_concat(a.g, b.g)))),
n AS (SELECT ta, count(DISTINCT k.project_id) AS projects FROM p JOIN knowledge_items k ON lower(k.title) = tb WHERE k.project_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT k.project_id) >= 2)
SELECT DISTINCT id, projects FROM knowledge_items JOIN n ON lower(title) = ta WHERE project_id IS NOT NULL""")
def promotion(s: SparkSession, d: str) -> DataFrame:
    return E.promotable(table(s, d, "knowledge_items"))


@query("SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY access_count DESC, id, updated_at) AS rn FROM knowledge_items WHERE project_id IS NOT NULL) WHERE rn <= 3")
def topk_per_project(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("access_count"), "id", "updated_at")
    return table(s, d, "knowledge_items").where("project_id is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("project_id", "id")
