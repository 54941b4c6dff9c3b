"""Queries of keyed changes, models, learning, trees and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import json_with, snippet
from siltstone.operators import analytics as A
from siltstone.operators import entities as E
from siltstone.operators import learning, models, tree
from siltstone.operators import retrieval as R
from siltstone.operators.context import pack_sections
from siltstone.queries.inputs import AS_OF, edges
from siltstone.sources import ingest
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


@query("SELECT id, title, kind FROM knowledge_items WHERE id IN (SELECT DISTINCT superseded_by FROM knowledge_items)")
def scan_many(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items")
    return k.join(k.select(F.col("superseded_by").alias("id")).where("id is not null").distinct(), "id", "left_semi").select("id", "title", "kind")


@query("SELECT id, CASE WHEN times_used > 3 THEN upper(title) ELSE title END AS title, needs_embedding OR times_used > 3 AS needs_embedding FROM (SELECT id, max(title) AS title, max(times_used) AS times_used, bool_or(needs_embedding) AS needs_embedding FROM procedures GROUP BY 1)")
def update_coalesce(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "procedures").groupBy("id").agg(F.max("title").alias("title"), F.max("times_used").alias("times_used"), F.max("needs_embedding").alias("needs_embedding"))
    return E.update_coalesce(p, p.where("times_used > 3").select("id", F.upper("title").alias("title"))).select("id", "title", "needs_embedding")


@query("SELECT id, needs_embedding AND kind <> 'pattern' AS needs_embedding FROM knowledge_items")
def mark_embedded(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items")
    return _marked(k)


def _marked(k: DataFrame) -> DataFrame:
    keyed = k.withColumn("row_key", F.concat_ws("|", "id", "kind"))
    return E.mark_embedded(keyed, keyed.where("kind = 'pattern'"), "row_key").select("id", "needs_embedding")


@query("SELECT project_id, file_path, id FROM git_activity WHERE file_path IS NOT NULL AND project_id IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, file_path ORDER BY created_at DESC, id DESC) = 1")
def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """All keys, those with rows of equal times too: of these the largest id is the latest."""
    g = table(s, d, "git_activity").where("file_path is not null and project_id is not null and created_at is not null").select("id", "project_id", "file_path", "created_at")
    old = F.col("created_at") < F.lit("2025-04-01").cast("timestamp")
    return E.upsert_latest(g.where(old), g.where(~old), ["project_id", "file_path"], "created_at", "id").select("project_id", "file_path", "id")


@query("SELECT m.session_id, m.id FROM session_messages m WHERE created_at IS NOT NULL AND session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1")
def latest_checkpoint(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "session_messages").where("created_at is not null and session_id is not null")
    return m.groupBy("session_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("SELECT session_id, epoch_us(min(created_at)) // 1000000 AS start_epoch FROM session_messages WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def session_start_epoch(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "session_messages").where("session_id is not null and created_at is not null")
    return m.groupBy("session_id").agg(F.unix_seconds(F.min("created_at")).alias("start_epoch"))


@query("SELECT doc_id, source FROM documents WHERE entity_type = 'reflection' AND source = 'cli_capture' ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20")
def list_reflections(s: SparkSession, d: str) -> DataFrame:
    return E.listed(table(s, d, "documents"), {"entity_type": "reflection", "source": "cli_capture"}, None, [F.desc_nulls_last("created_at"), F.asc("doc_id")]).select("doc_id", "source")


@query("SELECT id, status, retry_count FROM learning_queue WHERE status = 'pending' ORDER BY queued_at DESC, id, retry_count LIMIT 50")
def list_queue(s: SparkSession, d: str) -> DataFrame:
    return E.listed(table(s, d, "learning_queue"), {"status": "pending"}, None, [F.desc("queued_at"), F.asc("id"), F.asc("retry_count")], 50).select("id", "status", "retry_count")


@query("SELECT id, duration_ms FROM learning_runs ORDER BY created_at DESC, id, duration_ms LIMIT 25")
def recent_runs(s: SparkSession, d: str) -> DataFrame:
    return E.listed(table(s, d, "learning_runs"), None, None, [F.desc("created_at"), F.asc("id"), F.asc("duration_ms")], 25).select("id", "duration_ms")


@query("SELECT id, commit_hash FROM git_activity WHERE starts_with(file_path, 'build/') AND regexp_matches(commit_message, '#[0-9]+$')")
def prefix_and_regex(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "git_activity").where(F.col("file_path").startswith("build/") & F.col("commit_message").rlike("#[0-9]+$")).select("id", "commit_hash")


@query("""WITH w AS (SELECT id, kind, source_metadata AS m FROM knowledge_items) SELECT id, kind AS context, json_extract_string(m, '$.rev') AS rev, len(json_keys(coalesce(m, '{}'))) + 1 - CASE WHEN list_contains(json_keys(coalesce(m, '{}')), 'last_usage_context') THEN 1 ELSE 0 END AS keys FROM w""")
def json_set(s: SparkSession, d: str) -> DataFrame:
    """The kind written into each item's metadata, and read back with what was there."""
    rows = table(s, d, "knowledge_items").select("id", json_with(F.col("source_metadata"), "last_usage_context", F.col("kind")).alias("m"))
    return rows.select("id", F.get_json_object("m", "$.last_usage_context").alias("context"), F.get_json_object("m", "$.rev").alias("rev"), F.size(F.json_object_keys("m")).cast("bigint").alias("keys"))


@query("SELECT id, round(least(utility_score + CASE kind WHEN 'pattern' THEN 0.05::DOUBLE WHEN 'snippet' THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END, 1.0::DOUBLE), 6) AS utility FROM knowledge_items")
def record_usage(s: SparkSession, d: str) -> DataFrame:
    gain = F.when(F.col("kind") == "pattern", 0.05).when(F.col("kind") == "snippet", 0.03).otherwise(0.01)
    return table(s, d, "knowledge_items").select("id", F.round(F.least(F.col("utility_score") + gain, F.lit(1.0)), 6).alias("utility"))


@query("SELECT id, access_count + coalesce(n, 0) AS access_count FROM knowledge_items LEFT JOIN (SELECT 'pattern' AS kind, count(*) AS n FROM events WHERE event_type = 'view') USING (kind)")
def touch_on_read(s: SparkSession, d: str) -> DataFrame:
    reads = table(s, d, "events").where("event_type = 'view'").agg(F.count("*").alias("n")).withColumn("kind", F.lit("pattern"))
    return table(s, d, "knowledge_items").join(F.broadcast(reads), "kind", "left").select("id", (F.col("access_count") + F.coalesce("n", F.lit(0))).alias("access_count"))


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE queued_at < TIMESTAMPTZ '2025-06-23 00:00:00+00') AS to_collect FROM learning_queue GROUP BY 1")
def queue_retention(s: SparkSession, d: str) -> DataFrame:
    old = ~A.since(F.col("queued_at"), AS_OF, 7, inclusive=True)
    return table(s, d, "learning_queue").groupBy("status").agg(F.count("*").alias("n"), F.count_if(old).alias("to_collect"))


@query()
def learned_records(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "learning_queue").where("status = 'completed'").groupBy("session_id").agg(F.first("transcript", ignorenulls=True).alias("transcript"))
    return learning.learn(q)[0].select("session_id", "kind", "pos", "domain", "id")


@query()
def learned_runs(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "learning_queue").where("status = 'completed'").groupBy("session_id").agg(F.first("transcript", ignorenulls=True).alias("transcript"))
    return learning.learn(q)[2]


@query()
def contradictions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "procedures").groupBy("id").agg(F.max("title").alias("title"), F.max("created_at").alias("t"))
    judge = lambda pairs: pairs.withColumn("confidence", F.when(F.col("similarity") > 0.6, 0.9).otherwise(0.5))
    return learning.contradictions(p.where("t >= timestamp '2025-05-01'"), p.where("t < timestamp '2025-05-01'"), judge)


@query()
def raptor_tree(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "embeddings").select(F.lit("vector").alias("entity_type"), F.col("vec_id").alias("entity_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("title"), "embedding")
    return tree.build(items, "t").groupBy("level", "parent_id").agg(F.count("*").alias("n"))


@query()
def raptor_signal(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    nodes = tree.build(e.select(F.lit("vector").alias("entity_type"), F.col("vec_id").alias("entity_id"), F.lit("v").alias("title"), "embedding"), "t")
    near = R.knn(e.where("vec_id = 0"), e, 5).select(F.concat(F.lit("vector:"), F.col("id").cast("string")).alias("id"), "rank")
    return tree.expand(near, nodes, 20)


@query()
def text_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Procedures by the hashed vectors of their contents: every fiftieth title length is a query."""
    p = table(s, d, "procedures").groupBy("id").agg(F.max("content").alias("content")).withColumn("embedding", models.embedded(F.col("content")))
    return R.knn(p.where("pmod(xxhash64(id), 50) = 0"), p, 3, "id").select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def compact_restore(s: SparkSession, d: str) -> DataFrame:
    """The latest 20 episodes, 10 items and 50 procedures of each project, packed by priority."""
    docs = table(s, d, "documents").where("entity_type = 'episode' and project_id is not null and text is not null").select("project_id", F.lit(1).alias("p"), F.col("doc_id").cast("string").alias("id"), snippet(F.col("text")).alias("t"), "created_at")
    items = table(s, d, "knowledge_items").where("project_id is not null").select("project_id", F.lit(2).alias("p"), "id", snippet(F.col("content")).alias("t"), F.col("updated_at").alias("created_at"))
    procs = table(s, d, "procedures").where("project_id is not null").select("project_id", F.lit(3).alias("p"), "id", snippet(F.col("content")).alias("t"), F.col("updated_at").alias("created_at"))
    rows = docs.unionByName(items).unionByName(procs)
    from pyspark.sql import Window

    w = Window.partitionBy("project_id", "p").orderBy(F.desc_nulls_last("created_at"), "id", "t")
    most = F.element_at(F.array(F.lit(20), F.lit(10), F.lit(50)), F.col("p"))
    kept = rows.withColumn("n", F.row_number().over(w)).where("n <= 50").where(F.col("n") <= most)
    sections = kept.select("project_id", (F.col("p") * 100 + F.col("n")).alias("priority"), F.concat_ws("/", "p", "id", "n").alias("section"), F.octet_length("t").alias("bytes"))
    return pack_sections(sections, "project_id", 6000)


@query()
def ingested_pages(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    url = F.concat(F.when(F.col("doc_id") % 7 == 0, "http://10.0.0.8/").otherwise("https://pages.example/"), F.col("doc_id").cast("string"))
    pages = docs.select(url.alias("url"), F.concat(F.lit("<html><title>t</title><body><main>"), F.col("text"), F.lit("</main></body></html>")).alias("html"))
    known = docs.where("doc_id % 5 = 0").select(url.alias("source_url"))
    return ingest.pages(pages, known).select("url", "title", F.md5("content").alias("md5"))


@query("""WITH k AS (SELECT DISTINCT commit_hash FROM git_activity WHERE created_at < TIMESTAMPTZ '2025-05-01 00:00:00+00'), n AS (SELECT commit_hash, max(commit_message) AS m FROM git_activity WHERE commit_hash NOT IN (SELECT commit_hash FROM k) GROUP BY 1)
SELECT commit_hash, CASE WHEN starts_with(lower(m), 'fix') OR starts_with(lower(m), 'feat') OR starts_with(lower(m), 'refactor') OR contains(lower(m), 'bug') OR contains(lower(m), 'critical') THEN 'medium' ELSE 'low' END AS severity FROM n""")
def ingested_commits(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "git_activity")
    rows = g.groupBy("commit_hash").agg(F.max("commit_message").alias("commit_message"), F.array_sort(F.collect_set(F.struct("change_type", "file_path"))).alias("files"))
    return ingest.commits(rows, g.where("created_at < timestamp '2025-05-01'"))[1].select("commit_hash", "severity")


@query()
def agentic_search(s: SparkSession, d: str) -> DataFrame:
    from siltstone.operators import fts

    items = table(s, d, "knowledge_items").groupBy("id").agg(F.first("title").alias("title"), F.first("content").alias("content"))
    search = lambda q: fts.search(items, "id", {"A": "title", "B": "content"}, q, 10).withColumnRenamed("id", "entity_id")
    steps = {"nightly cache": "nightly planner", "nightly planner": None}
    return R.agentic(search, lambda q, found: steps[q], "nightly cache").select("entity_id", "hop", F.round("score", 6).alias("score"))


@query()
def edge_clusters(s: SparkSession, d: str) -> DataFrame:
    from siltstone.operators import graph as G

    return G.label_propagation(edges(s, d)).groupBy("cluster").agg(F.count("*").alias("size"))
