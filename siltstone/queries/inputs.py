"""Inputs of queries that the tables have no own form of: a search log, logs, edges and episodes drawn from events and
documents by fixed arithmetic. Each has its SQL twin for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import table

EVENTS_AS_OF, AS_OF = "2024-01-31 00:00:00", "2025-06-30 00:00:00"
RELATIONS = ("led_to", "related", "caused", "triggered", "caused_by", "resolved_by", "preceded_by", "resulted_in", "derived_from", "fixed_by", "mentions")
TYPES = ("semantic", "temporal", "causal", "decision", "procedural")


def searches(spark: SparkSession, d: str) -> DataFrame:
    """id, query, query_type, result_ids, clicked_ids, signal_sources, created_at."""
    e = table(spark, d, "events")
    i = F.sequence(F.lit(0), F.lit(4))
    ids = F.transform(i, lambda k: F.concat(F.lit("e"), ((F.col("event_id") * 7 + k * 13) % 97).cast("string")))
    names = F.transform(i, lambda k: F.filter(F.array(
        F.when((F.col("event_id") + k) % 2 == 0, "fts"), F.when((F.col("event_id") + k) % 3 == 0, "dense"), F.when((F.col("event_id") + k) % 5 == 0, "graph"), F.when((F.col("event_id") + k) % 7 == 1, "cue"),
    ), lambda s: s.isNotNull()))
    none = F.expr("cast(array() as array<string>)")
    kind = F.element_at(F.array(*map(F.lit, TYPES), F.lit(None)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.withColumn("ids", ids).select(
        F.col("event_id").alias("id"), F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("query"), kind.alias("query_type"),
        F.when(F.col("event_type") == "signup", none).otherwise(F.col("ids")).alias("result_ids"),
        F.when(F.col("event_type").isin("click", "purchase"), F.array(F.element_at("ids", (F.col("event_id") % 5 + 1).cast("int")))).otherwise(none).alias("clicked_ids"),
        F.map_from_arrays("ids", names).alias("signal_sources"), F.col("ts").alias("created_at"),
    )
    return rows


SEARCHES = """
searches AS (
  SELECT event_id AS id, 'q' || (user_id % 40) AS query, ts AS created_at,
    CASE event_id % 6 WHEN 0 THEN 'semantic' WHEN 1 THEN 'temporal' WHEN 2 THEN 'causal' WHEN 3 THEN 'decision' WHEN 4 THEN 'procedural' END AS query_type,
    CASE WHEN event_type = 'signup' THEN []::VARCHAR[] ELSE list_transform(range(0, 5), lambda k: 'e' || ((event_id * 7 + k * 13) % 97)) END AS result_ids,
    CASE WHEN event_type IN ('click', 'purchase') THEN ['e' || ((event_id * 7 + (event_id % 5) * 13) % 97)] ELSE []::VARCHAR[] END AS clicked_ids
  FROM events),
attributed AS (
  SELECT s.*, 'e' || ((s.id * 7 + k * 13) % 97) AS entity, sig.signal
  FROM searches s, range(0, 5) r(k), (VALUES ('fts', 2, 0), ('dense', 3, 0), ('graph', 5, 0), ('cue', 7, 1)) sig(signal, m, rest)
  WHERE (s.id + k) % m = rest)
"""


def logs(spark: SparkSession, d: str) -> DataFrame:
    """timestamp, level, target, message."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    return e.select(
        F.col("ts").alias("timestamp"), level.alias("level"), F.concat(F.lit("svc."), (F.col("user_id") % 7).cast("string")).alias("target"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" failed at node-"), (F.col("event_id") % 13).cast("string")).alias("message"),
    )


LOGS = """
logs AS (
  SELECT ts AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level,
    'svc.' || (user_id % 7) AS target, event_type || ' ' || event_id || ' failed at node-' || (event_id % 13) AS message
  FROM events)
"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, relation, weight, usage_count: steps of users from one kind of event to the next."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string"))
    steps = e.select("event_id", node.alias("source"), F.lead(node).over(w).alias("target")).where("target is not null")
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("event_id") % 11 + 1).cast("int"))
    rows = steps.select("source", "target", relation.alias("relation"), (0.01 + (F.col("event_id") % 90) / 100.0).alias("weight"))
    return rows.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"), F.count("*").alias("usage_count"))


EDGES = """
steps AS (
  SELECT event_id, event_type || '-' || (event_id % 50) AS source, lead(event_type || '-' || (event_id % 50)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
edges AS (
  SELECT source, target, CASE event_id % 11 WHEN 0 THEN 'led_to' WHEN 1 THEN 'related' WHEN 2 THEN 'caused' WHEN 3 THEN 'triggered' WHEN 4 THEN 'caused_by' WHEN 5 THEN 'resolved_by' WHEN 6 THEN 'preceded_by'
      WHEN 7 THEN 'resulted_in' WHEN 8 THEN 'derived_from' WHEN 9 THEN 'fixed_by' ELSE 'mentions' END AS relation,
    max(0.01::DOUBLE + (event_id % 90)::DOUBLE / 100.0::DOUBLE) AS weight, count(*) AS usage_count
  FROM steps WHERE target IS NOT NULL GROUP BY ALL)
"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """id, title, content, kind, severity, resolved, project_id, utility_score, last_accessed_at, superseded_by, created_at and
    updated_at of the documents that are episodes; what a document doesn't have is drawn from its number."""
    n = F.col("doc_id")
    return table(spark, d, "documents").where("entity_type = 'episode'").select(
        F.concat(F.lit("ep"), n.cast("string")).alias("id"), F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("title"), F.coalesce("text", F.lit("")).alias("content"),
        F.element_at(F.array(*map(F.lit, ("discovery", "error", "decision", "success"))), (n % 4 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low")), F.lit(None)), (n % 5 + 1).cast("int")).alias("severity"),
        (n % 3 == 0).alias("resolved"), "project_id", (n % 20 / F.lit(20.0)).alias("utility_score"), F.lit(None).cast("timestamp").alias("last_accessed_at"),
        F.lit(None).cast("string").alias("superseded_by"), "created_at", F.col("created_at").alias("updated_at"),
    )


EPISODES = """
episodes AS (
  SELECT 'ep' || doc_id AS id, left(coalesce(text, ''), 60) AS title, coalesce(text, '') AS content, (['discovery', 'error', 'decision', 'success'])[doc_id % 4 + 1] AS kind,
    (['critical', 'high', 'medium', 'low', NULL])[doc_id % 5 + 1] AS severity, doc_id % 3 = 0 AS resolved, project_id, (doc_id % 20) / 20.0::DOUBLE AS utility_score,
    NULL::TIMESTAMPTZ AS last_accessed_at, NULL::VARCHAR AS superseded_by, created_at, created_at AS updated_at
  FROM documents WHERE entity_type = 'episode')
"""


def memories(spark: SparkSession, d: str) -> DataFrame:
    """id, category, key, value, project_id, confirmations, contradictions, utility_score, created_at: a core memory of each
    kind and tag that a project's items have, and a global one of each tag."""
    k = table(spark, d, "knowledge_items").select("project_id", "kind", F.explode("tags").alias("tag"), "created_at")
    own = k.where("project_id is not null").groupBy("project_id", "kind", "tag").agg(F.count("*").alias("n"), F.min("created_at").alias("created_at"))
    every = k.groupBy("tag").agg(F.count("*").alias("n"), F.min("created_at").alias("created_at")).select(F.lit(None).cast("string").alias("project_id"), F.lit("fact").alias("kind"), "tag", "n", "created_at")
    rows = own.unionByName(every)
    return rows.select(
        F.concat_ws("/", F.lit("m"), F.coalesce("project_id", F.lit("-")), "kind", "tag").alias("id"), F.col("kind").alias("category"), F.col("tag").alias("key"), F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")).alias("value"),
        "project_id", F.col("n").alias("confirmations"), F.lit(0).cast("bigint").alias("contradictions"), F.lit(1.0).alias("utility_score"), "created_at",
    )


MEMORIES = """
kt AS (SELECT project_id, kind, unnest(tags) AS tag, created_at FROM knowledge_items),
mr AS (SELECT project_id, kind, tag, count(*) AS n, min(created_at) AS created_at FROM kt WHERE project_id IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT NULL, 'fact', tag, count(*), min(created_at) FROM kt GROUP BY tag),
memories AS (SELECT 'm/' || coalesce(project_id, '-') || '/' || kind || '/' || tag AS id, kind AS category, tag AS key, 'seen ' || n || ' times' AS value, project_id, n AS confirmations, created_at FROM mr)
"""
