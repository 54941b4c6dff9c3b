"""Queries of the hybrid search. The tables hold no vectors of records, so each record gets the vector, the word vectors and
the cluster of a row of the embeddings by its digest; the query gets those of row 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import extract_cues
from siltstone.operators import hybrid as H
from siltstone.operators import retrieval as R
from siltstone.plans.lineage import cut
from siltstone.queries.inputs import AS_OF, EPISODES, MEMORIES, episodes, memories
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


QUESTION, LIMIT = "nightly because OR cache OR planner", 10


def _entities(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    k = table(s, d, "knowledge_items").groupBy("id").agg(*(F.max(c).alias(c) for c in ("title", "content", "project_id", "last_accessed_at", "access_count", "feedback_boost", "superseded_by", "valid_until", "created_at")))
    p = table(s, d, "procedures").groupBy("id").agg(*(F.max(c).alias(c) for c in ("title", "content", "project_id", "times_used", "superseded_by", "valid_until", "created_at")))
    p = p.withColumns({"last_accessed_at": none.cast("timestamp"), "access_count": F.col("times_used"), "feedback_boost": F.lit(0.0).cast("float")})
    e = episodes(s, d).withColumns({"access_count": F.lit(0).cast("bigint"), "feedback_boost": F.lit(0.0).cast("float"), "valid_until": none.cast("timestamp")})
    m = memories(s, d).select("id", F.concat(F.lit("["), "category", F.lit("] "), "key").alias("title"), F.col("value").alias("content"), "project_id", "created_at")
    r = table(s, d, "documents").where("entity_type = 'reflection'").select(F.concat(F.lit("rf"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("Reflection: "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"), "project_id", "created_at")
    plain = {"last_accessed_at": none.cast("timestamp"), "access_count": F.lit(0).cast("bigint"), "feedback_boost": F.lit(0.0).cast("float"), "superseded_by": none.cast("string"), "valid_until": none.cast("timestamp")}
    out = None
    for kind, rows in {"knowledge_item": k, "procedure": p, "episode": e, "core_memory": m.withColumns(plain), "reflection": r.withColumns(plain)}.items():
        each = rows.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), "title", "content", "project_id", extract_cues(F.col("title")).alias("cues"), "last_accessed_at", "access_count", "feedback_boost", "superseded_by", "valid_until", "created_at")
        out = each if out is None else out.unionByName(each)
    return out


def _corpus(s: SparkSession, d: str) -> tuple[H.Corpus, list[float], list[list[float]]]:
    e = table(s, d, "embeddings")
    n = e.count()
    entities = cut(_entities(s, d))
    no = F.conv(F.left(F.md5("entity_id"), F.lit(8)), 16, 10).cast("bigint") % n
    placed = entities.select("entity_type", "entity_id", no.alias("vec_id"))
    vectors = cut(placed.join(e, "vec_id").select("entity_type", "entity_id", "embedding", "label"))
    tens = e.groupBy(F.floor(F.col("vec_id") / 10).alias("ten")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    tokens = placed.withColumn("ten", F.floor(F.col("vec_id") / 10)).join(tens, "ten").select("entity_type", "entity_id", "vectors")
    k, name = table(s, d, "knowledge_items"), lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    tagged = k.where("project_id is not null").select("id", "project_id", F.try_element_at("tags", F.lit(1)).alias("tag"), "utility_score")
    first = table(s, d, "procedures").where("project_id is not null").groupBy("project_id", F.try_element_at("tags", F.lit(1)).alias("tag")).agg(F.min("id").alias("target"))
    told = episodes(s, d).where("project_id is not null").groupBy("project_id").agg(F.min("id").alias("target"))
    edges = tagged.join(first, ["project_id", "tag"]).select(name("knowledge_item", "id").alias("source"), name("procedure", "target").alias("target"), F.col("utility_score").alias("weight"))
    edges = edges.unionByName(k.where("superseded_by is not null").select(name("knowledge_item", "id").alias("source"), name("knowledge_item", "superseded_by").alias("target"), F.lit(0.9).alias("weight")))
    edges = edges.unionByName(tagged.join(told, "project_id").select(name("knowledge_item", "id").alias("source"), name("episode", "target").alias("target"), F.lit(0.4).alias("weight")))
    leaves = vectors.select(F.concat_ws(":", "entity_type", "entity_id").alias("id"), F.lit(0).alias("level"), F.concat(F.lit("t/"), F.col("label").cast("string")).alias("parent_id"), "entity_type", "entity_id")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda x: x["x"]).alias("embedding"))
    inner = means.select(F.concat(F.lit("t/"), F.col("label").cast("string")).alias("id"), "embedding")
    nodes = leaves.unionByName(inner.select("id", F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit("raptor_node").alias("entity_type"), F.lit(None).cast("string").alias("entity_id")))
    asked = {r.vec_id: [float(x) for x in r.embedding] for r in e.where("vec_id < 10").collect()}
    return H.Corpus(entities, vectors.drop("label"), tokens, edges, nodes, inner), asked[0], [asked[i] for i in sorted(asked)]


def _signals(s: SparkSession, d: str) -> dict[str, DataFrame]:
    corpus, vector, tokens = _corpus(s, d)
    return H.signals(corpus, QUESTION, vector, tokens, LIMIT)


_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
_CUES = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: strlen(w) >= 3)"


def _score() -> str:
    one = lambda col, t, w: f"CASE WHEN len(list_filter({col}, lambda w: w = '{t}')) > 0 THEN {w}::DOUBLE * (1 + ln(len(list_filter({col}, lambda w: w = '{t}'))::DOUBLE)) ELSE 0.0::DOUBLE END"
    return " + ".join(one(col, t, w) for col, w in (("tw", "1.0"), ("cw", "0.4")) for t in ("because", "cache", "nightly", "planner"))


#: Weights of a causal query, which the question is: fts 0.5, dense and late interaction 1, graph 2, tree 0.5, cue 1.5.
_SIGNALS = "WITH" + EPISODES + "," + MEMORIES + f""",
ent AS (
  SELECT 'knowledge_item' AS entity_type, id AS entity_id, max(title) AS title, max(content) AS content, max(project_id) AS project_id, max(last_accessed_at) AS la, max(access_count) AS ac, max(feedback_boost)::DOUBLE AS fb, max(superseded_by) AS sb, max(valid_until) AS vu, max(created_at) AS created_at FROM knowledge_items GROUP BY id
  UNION ALL SELECT 'procedure', id, max(title), max(content), max(project_id), NULL, max(times_used), 0, max(superseded_by), max(valid_until), max(created_at) FROM procedures GROUP BY id
  UNION ALL SELECT 'episode', id, title, content, project_id, NULL, 0, 0, NULL, NULL, created_at FROM episodes
  UNION ALL SELECT 'core_memory', id, '[' || category || '] ' || key, value, project_id, NULL, 0, 0, NULL, NULL, created_at FROM memories
  UNION ALL SELECT 'reflection', 'rf' || doc_id, 'Reflection: ' || doc_id, coalesce(text, ''), project_id, NULL, 0, 0, NULL, NULL, created_at FROM documents WHERE entity_type = 'reflection'),
placed AS (SELECT entity_type, entity_id, ('0x' || left(md5(entity_id), 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM ent),
ft AS (SELECT entity_type, entity_id, {_WORDS.format('title')} AS tw, {_WORDS.format('content')} AS cw FROM ent WHERE entity_type IN ('knowledge_item', 'episode', 'procedure')),
fs AS (SELECT entity_type, entity_id, round({_score()}, 9) AS score FROM ft WHERE list_contains(list_concat(tw, cw), 'nightly') AND (list_contains(list_concat(tw, cw), 'because') OR list_contains(list_concat(tw, cw), 'cache') OR list_contains(list_concat(tw, cw), 'planner'))),
fr AS (SELECT entity_type, entity_id, row_number() OVER (ORDER BY score DESC, entity_type, entity_id) - 1 AS rank FROM fs),
sim AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings),
ds AS (SELECT entity_type, entity_id, score FROM placed JOIN sim USING (vec_id)),
dr AS (SELECT entity_type, entity_id, row_number() OVER (ORDER BY score DESC, entity_type, entity_id) - 1 AS rank FROM ds),
ms AS (SELECT v.vec_id // 10 AS ten, q.vec_id AS q, max(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS best FROM embeddings v, embeddings q WHERE q.vec_id < 10 GROUP BY 1, 2),
mt AS (SELECT ten, round(sum(best), 9) AS score FROM ms GROUP BY 1),
lr AS (SELECT entity_type, entity_id, row_number() OVER (ORDER BY score DESC, entity_type, entity_id) - 1 AS rank FROM placed JOIN mt ON ten = vec_id // 10),
chain AS (SELECT entity_type || ':' || entity_id AS node, row_number() OVER (ORDER BY s, rank) AS no FROM (SELECT *, 0 AS s FROM fr WHERE rank < 30 UNION ALL SELECT *, 1 FROM dr WHERE rank < 30)),
seeds AS (SELECT node, min(no) AS no FROM chain WHERE no <= 10 GROUP BY 1),
tagged AS (SELECT id, project_id, tags[1] AS tag, utility_score FROM knowledge_items WHERE project_id IS NOT NULL),
edg AS (
  SELECT 'knowledge_item:' || id AS source, 'procedure:' || t AS target, utility_score AS weight FROM tagged JOIN (SELECT project_id, tags[1] AS tag, min(id) AS t FROM procedures GROUP BY 1, 2) USING (project_id, tag)
  UNION ALL SELECT 'knowledge_item:' || id, 'knowledge_item:' || superseded_by, 0.9 FROM knowledge_items WHERE superseded_by IS NOT NULL
  UNION ALL SELECT 'knowledge_item:' || id, 'episode:' || t, 0.4 FROM tagged JOIN (SELECT project_id, min(id) AS t FROM episodes GROUP BY 1) USING (project_id)),
gh AS (SELECT target, no, weight FROM edg JOIN seeds ON source = node WHERE target NOT IN (SELECT node FROM seeds)),
gd AS (SELECT target, arg_min(weight, (no, -weight)) AS w FROM gh GROUP BY 1),
gr AS (SELECT string_split(target, ':')[1] AS entity_type, regexp_replace(target, '^[^:]*:', '') AS entity_id, row_number() OVER (ORDER BY w DESC, target) - 1 AS rank FROM gd),
mean AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
node AS (SELECT 't/' || label AS id, list(x ORDER BY i) AS v FROM mean GROUP BY label),
pool AS (SELECT entity_type, entity_id, NULL AS id, score FROM ds UNION ALL SELECT 'raptor_node', id, id, round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) FROM node),
hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM pool ORDER BY score DESC, entity_type, entity_id LIMIT 90) WHERE id IS NOT NULL),
leaf AS (SELECT entity_type, entity_id, 't/' || label AS parent_id FROM placed JOIN embeddings USING (vec_id)),
rl AS (SELECT entity_type, entity_id, rank AS o, '' AS n FROM leaf JOIN hits ON id = parent_id UNION ALL SELECT entity_type, entity_id, 0, entity_type || ':' || entity_id FROM leaf WHERE (SELECT count(*) FROM hits) = 0),
rr AS (SELECT entity_type, entity_id, row_number() OVER (ORDER BY o, n, entity_type, entity_id) - 1 AS rank FROM rl),
cr AS (SELECT 'episode' AS entity_type, id AS entity_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) - 1 AS rank FROM episodes WHERE list_has_any({_CUES.format('title')}, ['nightly', 'because', 'cache', 'planner'])),
sig AS (
  SELECT 'fts' AS signal, entity_type, entity_id, rank, 0.5::DOUBLE AS w FROM fr WHERE rank < 30 UNION ALL SELECT 'dense', *, 1.0 FROM dr WHERE rank < 30 UNION ALL SELECT 'late', *, 1.0 FROM lr WHERE rank < 30
  UNION ALL SELECT 'graph', *, 2.0 FROM gr WHERE rank < 30 UNION ALL SELECT 'raptor', *, 0.5 FROM rr WHERE rank < 30 UNION ALL SELECT 'cue', *, 1.5 FROM cr WHERE rank < 30),
fused AS (SELECT entity_type, entity_id, round(sum(w / (60 + rank + 1)), 12) AS score, list_sort(list(DISTINCT signal)) AS signals FROM sig GROUP BY 1, 2)
"""


@query(_SIGNALS + "SELECT entity_type, entity_id, round(score, 9) AS score FROM fused ORDER BY fused.score DESC, entity_type, entity_id LIMIT 20")
def rrf_fused(s: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(_signals(s, d), H.weights_of("causal")).withColumn("score", F.round("score", 12))
    return R.top(fused, 20).select("entity_type", "entity_id", F.round("score", 9).alias("score"))


@query(_SIGNALS + "SELECT entity_type, entity_id, signal, rank::INT AS rank, round(w / (60 + rank + 1), 9) AS share FROM sig")
def rrf_explained(s: SparkSession, d: str) -> DataFrame:
    fused = R.fuse(_signals(s, d), H.weights_of("causal"))
    return fused.select("entity_type", "entity_id", F.explode("contributions").alias("c")).select("entity_type", "entity_id", "c.signal", "c.rank", F.round("c.share", 9).alias("share"))


@query(_SIGNALS + "SELECT entity_id, signals FROM fused")
def attribution(s: SparkSession, d: str) -> DataFrame:
    return R.attribution(_signals(s, d))


_HYDRATED = _SIGNALS + """, top AS (SELECT * FROM fused ORDER BY score DESC, entity_type, entity_id LIMIT 10),
raw AS (SELECT *, score * exp(-0.693::DOUBLE / 30 * coalesce((epoch_us(TIMESTAMPTZ '2025-06-30 00:00:00+00') - epoch_us(CASE WHEN entity_type = 'knowledge_item' THEN la ELSE coalesce(la, created_at) END)) / 86400000000.0::DOUBLE, 30.0)) * (1 + 0.1::DOUBLE * ln(1 + ac::DOUBLE)) + 0.1::DOUBLE * coalesce(fb, 0) AS decayed FROM top JOIN ent USING (entity_type, entity_id)),
res AS (SELECT *, CASE WHEN entity_type IN ('knowledge_item', 'episode', 'procedure') THEN decayed ELSE score END AS final FROM raw WHERE entity_type NOT IN ('knowledge_item', 'episode', 'procedure') OR (sb IS NULL AND coalesce(TIMESTAMPTZ '2025-06-30 00:00:00+00' <= vu, true)))
"""


def _results(s: SparkSession, d: str) -> DataFrame:
    corpus, vector, tokens = _corpus(s, d)
    return H.search(corpus, QUESTION, lambda _: (vector, tokens), AS_OF, LIMIT)


@query(_HYDRATED + "SELECT entity_type, entity_id, title, round(final, 8) AS score, signals FROM res")
def hybrid_hydrated(s: SparkSession, d: str) -> DataFrame:
    return _results(s, d).select("entity_type", "entity_id", "title", F.round("score", 8).alias("score"), "signals")


@query(_HYDRATED + "SELECT entity_type, entity_id FROM res WHERE coalesce(project_id <> (SELECT min(project_id) FROM res), true)")
def cross_project(s: SparkSession, d: str) -> DataFrame:
    """The results outside the first project among them."""
    out = _results(s, d)
    first = out.agg(F.min("project_id")).first()[0]
    return H.outside_project(out, first or "").select("entity_type", "entity_id")


@query(_HYDRATED + "SELECT list(entity_id ORDER BY final DESC, entity_id) AS result_ids, 'causal' AS query_type FROM res")
def search_log(s: SparkSession, d: str) -> DataFrame:
    row = H.search_log(_results(s, d), QUESTION, H.query_type(QUESTION), None, AS_OF)
    return H.latest_explanation(row, QUESTION).select("result_ids", "query_type")


@query(_HYDRATED + """, w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS own FROM res),
x AS (SELECT *, len(list_intersect(own, ['cache', 'nightly', 'planner']))::DOUBLE / len(list_distinct(list_concat(own, ['cache', 'nightly', 'planner']))) AS c, len(list_intersect(own, ['job', 'nightly']))::DOUBLE / len(list_distinct(list_concat(own, ['job', 'nightly']))) AS j FROM w),
n AS (SELECT *, min(final) OVER () AS f0, max(final) OVER () AS f1, min(c) OVER () AS c0, max(c) OVER () AS c1 FROM x)
SELECT entity_type, entity_id, round(0.2::DOUBLE * (final - f0) / CASE WHEN f1 > f0 THEN f1 - f0 ELSE 1.0 END + 0.5::DOUBLE * (c - c0) / CASE WHEN c1 > c0 THEN c1 - c0 ELSE 1.0 END + 0.3::DOUBLE * j, 6) AS final FROM n""")
def hybrid_reranked(s: SparkSession, d: str) -> DataFrame:
    return R.rerank(_results(s, d), "content", R.token_overlap("nightly cache planner"), R.token_overlap("nightly job")).select("entity_type", "entity_id", F.round("final", 6).alias("final"))
