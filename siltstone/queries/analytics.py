"""Queries of the analytics, predicates, joins and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import analytics as A
from siltstone.operators import entities as E
from siltstone.queries.inputs import AS_OF, EDGES, EPISODES, EVENTS_AS_OF, LOGS, MEMORIES, SEARCHES, edges, episodes, logs, memories, searches
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


@query("""
SELECT file_path, count(DISTINCT commit_hash) AS groups, sum(coalesce(lines_added, 0))::BIGINT AS added, sum(coalesce(lines_removed, 0))::BIGINT AS removed,
  (sum(coalesce(lines_added, 0)) + sum(coalesce(lines_removed, 0)))::BIGINT AS churn
FROM git_activity WHERE file_path IS NOT NULL AND created_at > TIMESTAMPTZ '2025-05-31 00:00:00+00' GROUP BY 1 ORDER BY groups DESC, churn DESC, file_path LIMIT 20""")
def hot_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "git_activity").where(A.since(F.col("created_at"), AS_OF, 30))
    return A.hot_items(rows, "file_path", "commit_hash", "lines_added", "lines_removed")


@query("""
WITH m AS (SELECT DISTINCT commit_hash AS g, file_path AS i FROM git_activity WHERE file_path IS NOT NULL), n AS (SELECT i, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS together FROM m a JOIN m b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT item_a, item_b, together, round(together / n.n::DOUBLE, 6) AS ratio FROM p JOIN n ON n.i = item_a""")
def coupled_files(s: SparkSession, d: str) -> DataFrame:
    return A.coupled_items(table(s, d, "git_activity"), "file_path", "commit_hash").withColumn("ratio", F.round("ratio", 6))


@query("WITH" + SEARCHES + """, shown AS (SELECT unnest(result_ids) AS entity, count(*) AS shown FROM searches GROUP BY 1), clicked AS (SELECT unnest(clicked_ids) AS entity, count(*) AS clicked FROM searches GROUP BY 1)
SELECT entity, shown, coalesce(clicked, 0) AS clicked, round(least(coalesce(clicked, 0)::DOUBLE / shown, 1.0::DOUBLE), 6) AS boost FROM shown LEFT JOIN clicked USING (entity)""")
def ctr_feedback(s: SparkSession, d: str) -> DataFrame:
    return A.ctr_feedback(searches(s, d)).withColumn("boost", F.round("boost", 6))


@query("WITH" + SEARCHES + """, shown AS (SELECT unnest(result_ids) AS entity, count(*) AS shown FROM searches GROUP BY 1), clicked AS (SELECT unnest(clicked_ids) AS entity, count(*) AS clicked FROM searches GROUP BY 1),
items AS (SELECT id, 'e' || (('0x' || left(md5(id), 8))::BIGINT % 97) AS entity, feedback_boost FROM (SELECT id, max(feedback_boost) AS feedback_boost FROM knowledge_items GROUP BY 1))
SELECT id, round(coalesce(least(coalesce(clicked, 0)::DOUBLE / shown, 1.0::DOUBLE), feedback_boost::DOUBLE), 5) AS boost FROM items LEFT JOIN shown USING (entity) LEFT JOIN clicked USING (entity)""")
def feedback_update(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "knowledge_items").groupBy("id").agg(F.max("feedback_boost").alias("feedback_boost"))
    items = items.withColumn("entity", F.concat(F.lit("e"), (F.conv(F.left(F.md5("id"), F.lit(8)), 16, 10).cast("bigint") % 97).cast("string")))
    out = A.apply_feedback(items, A.ctr_feedback(searches(s, d)), "entity")
    return out.select("id", F.round(F.col("feedback_boost").cast("double"), 5).alias("boost"))


@query("WITH" + SEARCHES + "SELECT count(*) AS searches, count(*) FILTER (WHERE len(clicked_ids) > 0) AS with_clicks, round(count(*) FILTER (WHERE len(clicked_ids) > 0) / count(*)::DOUBLE, 6) AS click_rate, round(avg(nullif(len(result_ids), 0)), 6) AS avg_results FROM searches")
def search_totals(s: SparkSession, d: str) -> DataFrame:
    return A.search_totals(searches(s, d)).withColumns({"click_rate": F.round("click_rate", 6), "avg_results": F.round("avg_results", 6)})


@query("WITH" + SEARCHES + "SELECT coalesce(query_type, 'unknown') AS query_type, count(*) AS searches, count(*) FILTER (WHERE len(clicked_ids) > 0) AS with_clicks FROM searches GROUP BY 1")
def searches_by_type(s: SparkSession, d: str) -> DataFrame:
    return A.searches_by_type(searches(s, d))


@query("WITH" + SEARCHES + "SELECT query, count(*) AS searches FROM searches GROUP BY 1 ORDER BY searches DESC, query LIMIT 10")
def top_queries(s: SparkSession, d: str) -> DataFrame:
    return A.top_queries(searches(s, d))


@query("WITH" + SEARCHES + ", h AS (SELECT signal, count(*) AS clicks FROM attributed WHERE list_contains(clicked_ids, entity) GROUP BY 1) SELECT signal, clicks, round(clicks / (SELECT sum(clicks) FROM h)::DOUBLE, 6) AS share FROM h")
def signal_clicks(s: SparkSession, d: str) -> DataFrame:
    return A.signal_clicks(searches(s, d)).withColumn("share", F.round("share", 6))


@query("WITH" + SEARCHES + """, used AS (SELECT * FROM searches WHERE query_type IS NOT NULL AND len(clicked_ids) > 0 AND created_at > TIMESTAMP '2024-01-24 00:00:00'), n AS (SELECT query_type, count(*) AS samples FROM used GROUP BY 1)
SELECT a.query_type, signal, samples, count(*) AS shows, count(*) FILTER (WHERE list_contains(a.clicked_ids, entity)) AS clicks, round(count(*) FILTER (WHERE list_contains(a.clicked_ids, entity)) / count(*)::DOUBLE, 6) AS ctr
FROM attributed a JOIN n ON n.query_type = a.query_type WHERE len(a.clicked_ids) > 0 AND a.created_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2, 3""")
def signal_ctr(s: SparkSession, d: str) -> DataFrame:
    return A.signal_ctr(searches(s, d), EVENTS_AS_OF).withColumn("ctr", F.round("ctr", 6))


@query("WITH" + SEARCHES + "SELECT query, count(*) AS searches FROM (SELECT query || '-' || (id % 31) AS query, clicked_ids FROM searches) GROUP BY 1 HAVING count(*) >= 2 AND sum(len(clicked_ids)) = 0 ORDER BY searches DESC, query LIMIT 10")
def knowledge_gaps(s: SparkSession, d: str) -> DataFrame:
    return A.knowledge_gaps(searches(s, d).withColumn("query", F.concat("query", F.lit("-"), (F.col("id") % 31).cast("string"))))


@query("SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 6) AS avg_value, round(avg(value * value), 4) AS avg_square FROM events GROUP BY 1")
def score_trends(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").withColumn("square", F.col("value") * F.col("value"))
    return A.score_trends(rows, "ts", ["value", "square"]).withColumns({"avg_value": F.round("avg_value", 6), "avg_square": F.round("avg_square", 4)})


@query("""
WITH r AS (SELECT *, patterns_extracted + episodes_extracted + procedures_extracted + memories_extracted AS x FROM learning_runs WHERE created_at >= TIMESTAMPTZ '2025-05-31 00:00:00+00')
SELECT count(*) AS runs, round(coalesce(avg(x), 0), 6) AS avg_extracted, round(coalesce(avg(CASE WHEN x + duplicates_skipped > 0 THEN duplicates_skipped / (x + duplicates_skipped)::DOUBLE ELSE 0 END), 0), 6) AS avg_duplicate_rate,
  coalesce(sum(patterns_extracted), 0)::BIGINT AS patterns, coalesce(sum(episodes_extracted), 0)::BIGINT AS episodes, coalesce(sum(procedures_extracted), 0)::BIGINT AS procedures, coalesce(sum(memories_extracted), 0)::BIGINT AS memories,
  round(coalesce(avg(duration_ms), 0), 4) AS avg_duration_ms, round(coalesce(avg(chunks_processed), 0), 6) AS avg_chunks FROM r""")
def learning_analytics(s: SparkSession, d: str) -> DataFrame:
    out = A.learning_analytics(table(s, d, "learning_runs"), AS_OF)
    return out.withColumns({"avg_extracted": F.round("avg_extracted", 6), "avg_duplicate_rate": F.round("avg_duplicate_rate", 6), "avg_duration_ms": F.round("avg_duration_ms", 4), "avg_chunks": F.round("avg_chunks", 6)})


@query("WITH" + SEARCHES + "SELECT count(*) AS injections, round(avg(nullif(len(result_ids), 0)), 6) AS avg_injected, round(avg(nullif(len(clicked_ids), 0)), 6) AS avg_referenced, round(avg(nullif(len(clicked_ids), 0)) / avg(nullif(len(result_ids), 0)), 6) AS usage_rate FROM searches")
def context_usage(s: SparkSession, d: str) -> DataFrame:
    rows = searches(s, d).select(F.col("result_ids").alias("injected_entity_ids"), F.col("clicked_ids").alias("referenced_entity_ids"))
    out = A.context_usage(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_injected", "avg_referenced", "usage_rate")})


@query("WITH" + SEARCHES + "SELECT unnest(clicked_ids) AS element, count(*) AS n FROM searches GROUP BY 1 ORDER BY n DESC, element LIMIT 10")
def top_referenced(s: SparkSession, d: str) -> DataFrame:
    return A.top_elements(searches(s, d), "clicked_ids")


@query("""
WITH latest AS (SELECT * FROM knowledge_items ORDER BY updated_at DESC, id, access_count DESC LIMIT 1000), cur AS (SELECT * FROM latest WHERE superseded_by IS NULL),
r AS (SELECT coalesce(tags[1], kind) AS topic, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - floor((epoch_us(TIMESTAMPTZ '2025-06-30 00:00:00+00') - epoch_us(coalesce(last_accessed_at, created_at))) / 86400000000.0) / 30.0::DOUBLE)) AS f,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, ln(1 + access_count::DOUBLE) / 5 + coalesce(feedback_boost::DOUBLE, 0))) AS c, utility_score < 0.3 AS st FROM cur)
SELECT topic, count(*) AS items, round(avg(f), 6) AS freshness, round(avg(c), 6) AS confidence, count(*) FILTER (WHERE st) AS stale,
  round(0.4::DOUBLE * avg(f) + 0.4::DOUBLE * avg(c) + 0.2::DOUBLE * (1 - count(*) FILTER (WHERE st) / count(*)::DOUBLE), 6) AS overall FROM r GROUP BY 1""")
def topic_health(s: SparkSession, d: str) -> DataFrame:
    out = A.topic_health(table(s, d, "knowledge_items"), AS_OF)
    return out.withColumns({c: F.round(c, 6) for c in ("freshness", "confidence", "overall")})


@query("WITH" + SEARCHES + "," + EPISODES + "," + MEMORIES + """,
sp AS (SELECT s.*, p.id AS project_id FROM searches s JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS no FROM projects) p ON p.no = s.id % 50),
f AS (SELECT project_id, count(*) FILTER (WHERE last_accessed_at > TIMESTAMPTZ '2025-05-31 00:00:00+00') / count(*)::DOUBLE AS v FROM knowledge_items WHERE superseded_by IS NULL GROUP BY 1),
p AS (SELECT project_id, avg(success_rate) AS v FROM procedures WHERE superseded_by IS NULL AND times_used >= 3 GROUP BY 1),
e AS (SELECT project_id, count(*) / 3.0::DOUBLE AS v FROM episodes WHERE created_at > TIMESTAMPTZ '2025-06-23 00:00:00+00' GROUP BY 1),
m AS (SELECT project_id, count(*) / 5.0::DOUBLE AS v FROM memories GROUP BY 1),
c AS (SELECT project_id, count(*) FILTER (WHERE len(clicked_ids) > 0) / count(*)::DOUBLE AS v FROM sp WHERE created_at > TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
l AS (SELECT count(*) / 2.0::DOUBLE AS v FROM learning_runs WHERE created_at > TIMESTAMPTZ '2025-06-23 00:00:00+00'),
j AS (SELECT DISTINCT q.id AS project_id, coalesce(f.v, 0.0) AS freshness, coalesce(p.v, 1.0) AS procedures, coalesce(e.v, 0.0) AS episodes, coalesce(m.v, 0.0) AS memories, coalesce(c.v, 1.0) AS search, l.v AS learning
  FROM projects q LEFT JOIN f ON f.project_id = q.id LEFT JOIN p ON p.project_id = q.id LEFT JOIN e ON e.project_id = q.id LEFT JOIN m ON m.project_id = q.id LEFT JOIN c ON c.project_id = q.id, l),
u AS (UNPIVOT j ON freshness, procedures, episodes, memories, search, learning INTO NAME dimension VALUE raw),
w AS (SELECT project_id, dimension, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw::DOUBLE)) AS score FROM u)
SELECT project_id, dimension, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'healthy' WHEN score >= 0.4 THEN 'warning' ELSE 'critical' END AS status, round(avg(score) OVER (PARTITION BY project_id), 6) AS overall FROM w""")
def project_health(s: SparkSession, d: str) -> DataFrame:
    projects = table(s, d, "projects")
    numbered = projects.select(F.col("id").alias("project_id"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).alias("no"))
    log = searches(s, d).withColumn("created_at", F.col("created_at") + F.expr("interval 516 days"))
    asked = log.join(F.broadcast(numbered), F.col("id") % 50 == F.col("no"))
    out = A.project_health(projects, table(s, d, "knowledge_items"), table(s, d, "procedures"), episodes(s, d), memories(s, d), asked, table(s, d, "learning_runs"), AS_OF)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "overall")})


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM knowledge_items UNION ALL SELECT unnest(tags) FROM procedures) GROUP BY 1")
def tag_counts(s: SparkSession, d: str) -> DataFrame:
    return A.tag_counts(table(s, d, "knowledge_items"), table(s, d, "procedures"))


@query("WITH t AS (SELECT id, list_transform(tags, lambda t: CASE WHEN t = 'shard' THEN 'partition' ELSE t END) AS t FROM procedures) SELECT id, list_sort(list_distinct(t)) AS tags FROM t")
def tag_rename(s: SparkSession, d: str) -> DataFrame:
    return A.rename_tag(table(s, d, "procedures"), "shard", "partition").select("id", F.array_sort(F.array_distinct("tags")).alias("tags"))


@query("WITH t AS (SELECT id, list_transform(tags, lambda t: CASE WHEN t IN ('shard', 'parser', 'cache') THEN 'core' ELSE t END) AS t FROM procedures) SELECT id, list_sort(list_distinct(t)) AS tags FROM t")
def tag_merge(s: SparkSession, d: str) -> DataFrame:
    return A.merge_tags(table(s, d, "procedures"), ["shard", "parser", "cache"], "core").select("id", F.array_sort(F.array_distinct("tags")).alias("tags"))


@query("WITH" + LOGS + "SELECT level, count(*) AS n FROM logs GROUP BY 1")
def log_stats(s: SparkSession, d: str) -> DataFrame:
    return A.log_levels(logs(s, d))


@query("WITH" + LOGS + "SELECT count(*) AS n FROM logs WHERE level = 'ERROR' AND starts_with(target, 'svc.3') AND regexp_matches(message, 'node-1[0-2]$')")
def log_count_matching(s: SparkSession, d: str) -> DataFrame:
    return A.logs_matching(logs(s, d), "ERROR", "svc.3", "node-1[0-2]$").agg(F.count("*").alias("n"))


@query("WITH" + LOGS + """, b AS (SELECT *, left(sha256(target || '::' || trim(regexp_replace(regexp_replace(regexp_replace(message, '[^\\p{L}\\p{N}\\s.:_-]', '', 'g'), '[0-9]+', '<N>', 'g'), '\\s+', ' ', 'g'))), 32) AS fingerprint FROM logs WHERE level IN ('ERROR', 'WARN'))
SELECT fingerprint, left(min(message), 200) AS title, min(target) AS target, count(*) AS event_count, epoch_us(min(timestamp)) AS first_seen, epoch_us(max(timestamp)) AS last_seen FROM b GROUP BY 1""")
def error_groups(s: SparkSession, d: str) -> DataFrame:
    return A.error_groups(logs(s, d)).withColumns({"first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


@query("SELECT 'knowledge_items' AS table_name, count(*) AS n FROM knowledge_items UNION ALL SELECT 'procedures', count(*) FROM procedures UNION ALL SELECT 'session_messages', count(*) FROM session_messages UNION ALL SELECT 'git_activity', count(*) FROM git_activity")
def table_counts(s: SparkSession, d: str) -> DataFrame:
    return A.table_counts(**{n: table(s, d, n) for n in ("knowledge_items", "procedures", "session_messages", "git_activity")})


_OLD = "created_at < TIMESTAMPTZ '2025-05-31 00:00:00+00'"


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"knowledge": table(s, d, "knowledge_items"), "episodes": episodes(s, d), "procedures": table(s, d, "procedures").withColumn("utility_score", F.coalesce("success_rate", F.lit(0.05)))}


def _searched(s: SparkSession, d: str) -> DataFrame:
    return searches(s, d).withColumn("created_at", F.col("created_at") + F.expr("interval 516 days"))


@query("WITH" + SEARCHES + "," + EPISODES + f"""SELECT 'knowledge' AS candidate, count(*) AS n FROM knowledge_items WHERE utility_score < 0.1 AND {_OLD} UNION ALL SELECT 'episodes', count(*) FROM episodes WHERE utility_score < 0.1 AND {_OLD}
UNION ALL SELECT 'procedures', count(*) FROM procedures WHERE coalesce(success_rate, 0.05) < 0.1 AND {_OLD} UNION ALL SELECT 'search_queries', count(*) FROM searches WHERE created_at < TIMESTAMP '2023-12-31 00:00:00'""")
def retention_preview(s: SparkSession, d: str) -> DataFrame:
    return A.retention_preview(_tables(s, d), _searched(s, d), AS_OF)


@query("WITH" + EPISODES + f""", k AS (SELECT id FROM knowledge_items WHERE NOT coalesce(utility_score < 0.1 AND {_OLD}, false) UNION ALL SELECT id FROM episodes WHERE NOT coalesce(utility_score < 0.1 AND {_OLD}, false)
  UNION ALL SELECT id FROM procedures WHERE NOT coalesce(coalesce(success_rate, 0.05) < 0.1 AND {_OLD}, false)),
e AS (SELECT DISTINCT id AS source, superseded_by AS target FROM knowledge_items WHERE superseded_by IS NOT NULL UNION SELECT DISTINCT id, 'none' FROM procedures)
SELECT 'rows' AS what, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""")
def retention_run(s: SparkSession, d: str) -> DataFrame:
    """Edges of the test lead from superseded items to what replaced them, and from each procedure to nothing."""
    k = table(s, d, "knowledge_items")
    e = k.where("superseded_by is not null").select(F.col("id").alias("source"), F.col("superseded_by").alias("target")).unionByName(table(s, d, "procedures").select(F.col("id").alias("source"), F.lit("none").alias("target"))).distinct()
    kept, _, left = A.retention_run(_tables(s, d), _searched(s, d), e, AS_OF)
    rows = None
    for t in kept.values():
        rows = t.select("id") if rows is None else rows.unionByName(t.select("id"))
    return rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), "n").unionByName(left.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


@query("WITH" + LOGS + "SELECT level, count(*) AS n FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1")
def log_retention(s: SparkSession, d: str) -> DataFrame:
    return A.log_levels(A.log_retention(logs(s, d), EVENTS_AS_OF, 7))


@query("""
WITH x AS (SELECT event_type AS x0, lead(event_type, 1) OVER w AS x1, lead(event_type, 2) OVER w AS x2, lead(event_type, 3) OVER w AS x3, lead(event_type, 4) OVER w AS x4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT x0 || ' ' || x1 || ' ' || x2 AS gram, 3 AS size FROM x WHERE x2 IS NOT NULL UNION ALL SELECT x0 || ' ' || x1 || ' ' || x2 || ' ' || x3, 4 FROM x WHERE x3 IS NOT NULL
  UNION ALL SELECT x0 || ' ' || x1 || ' ' || x2 || ' ' || x3 || ' ' || x4, 5 FROM x WHERE x4 IS NOT NULL)
SELECT gram, size, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2""")
def ngram_mining(s: SparkSession, d: str) -> DataFrame:
    return A.ngrams(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id, event_id AS source, target FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL")
def consecutive_pairs(s: SparkSession, d: str) -> DataFrame:
    return A.consecutive_pairs(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query("SELECT id, session_id, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY queued_at DESC, id DESC, status) AS rn FROM learning_queue) WHERE rn = 1")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return A.latest_per_key(table(s, d, "learning_queue"), ["session_id"], [F.desc("queued_at"), F.desc("id"), F.asc("status")]).select("id", "session_id", "status")


@query("""WITH t AS (SELECT tag FROM (SELECT unnest(tags) AS tag FROM knowledge_items WHERE kind = 'pattern') GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 1)
SELECT id, title, kind FROM knowledge_items, t WHERE kind = 'pattern' AND list_contains(tags, tag) ORDER BY updated_at DESC, id, title LIMIT 20 OFFSET 2""")
def list_knowledge(s: SparkSession, d: str) -> DataFrame:
    """The second page of the patterns with the tag that most of them have."""
    k = table(s, d, "knowledge_items")
    tag = A.tag_counts(k.where("kind = 'pattern'")).first()
    out = E.listed(k, {"kind": "pattern", "project_id": None}, tag and tag["tag"], [F.desc("updated_at"), F.asc("id"), F.asc("title")], 20, 2)
    return out.select("id", "title", "kind")


@query("SELECT id, title FROM procedures WHERE project_id = (SELECT min(project_id) FROM procedures) ORDER BY updated_at DESC, id, title LIMIT 20")
def list_procedures(s: SparkSession, d: str) -> DataFrame:
    first = table(s, d, "procedures").agg(F.min("project_id")).first()[0]
    return E.listed(table(s, d, "procedures"), {"project_id": first}, None, [F.desc("updated_at"), F.asc("id"), F.asc("title")]).select("id", "title")


@query("SELECT id, title FROM knowledge_items WHERE project_id IS NULL AND kind = 'artifact' ORDER BY updated_at DESC, id, title LIMIT 20")
def list_global_knowledge(s: SparkSession, d: str) -> DataFrame:
    return E.listed(table(s, d, "knowledge_items").where("project_id is null"), {"kind": "artifact"}, None, [F.desc("updated_at"), F.asc("id"), F.asc("title")]).select("id", "title")


@query("SELECT doc_id, source FROM documents WHERE entity_type = 'episode' AND created_at BETWEEN TIMESTAMPTZ '2025-02-01 00:00:00+00' AND TIMESTAMPTZ '2025-02-10 00:00:00+00'")
def list_in_range(s: SparkSession, d: str) -> DataFrame:
    return E.in_range(table(s, d, "documents").where("entity_type = 'episode'"), "created_at", "2025-02-01 00:00:00", "2025-02-10 00:00:00").select("doc_id", "source")


@query("SELECT id, title FROM knowledge_items WHERE needs_embedding ORDER BY created_at, id, title LIMIT 50")
def needing_embedding(s: SparkSession, d: str) -> DataFrame:
    return E.listed(table(s, d, "knowledge_items").where("needs_embedding"), None, None, [F.asc("created_at"), F.asc("id"), F.asc("title")], 50).select("id", "title")


@query("SELECT session_id, count(*) AS n, count(*) FILTER (WHERE tool_use IS NOT NULL) AS with_tools FROM session_messages GROUP BY 1")
def message_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "session_messages").groupBy("session_id").agg(F.count("*").alias("n"), F.count("tool_use").alias("with_tools"))


@query("SELECT id, kind FROM knowledge_items WHERE list_has_any(tags, ['shard', 'parser'])")
def array_overlap(s: SparkSession, d: str) -> DataFrame:
    return E.overlapping(table(s, d, "knowledge_items"), "tags", ["shard", "parser"]).select("id", "kind")


@query("SELECT id, title FROM knowledge_items WHERE superseded_by IS NOT NULL OR TIMESTAMPTZ '2025-06-30 00:00:00+00' > valid_until")
def stale_items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").where(E.is_stale(F.col("superseded_by"), F.col("valid_until"), AS_OF)).select("id", "title")


@query("SELECT id, json_extract_string(source_metadata, '$.rev') AS rev FROM knowledge_items WHERE source_metadata IS NOT NULL")
def json_path(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").where("source_metadata is not null").select("id", F.get_json_object("source_metadata", "$.rev").alias("rev"))


@query("WITH" + EDGES + """, ids AS (SELECT DISTINCT event_type || '-' || (event_id % 50) AS id FROM events WHERE event_id % 50 < 30)
SELECT source, target, relation FROM edges WHERE source NOT IN (SELECT id FROM ids) OR target NOT IN (SELECT id FROM ids)""")
def orphan_edges(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "events").where("event_id % 50 < 30").select(F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string")).alias("id"))
    return E.orphan_edges(edges(s, d), ids).select("source", "target", "relation")


@query("SELECT id, CASE WHEN id IN (SELECT id FROM knowledge_items) THEN 'knowledge_item' WHEN id IN (SELECT id FROM procedures) THEN 'procedure' ELSE 'queue' END AS entity_type FROM (SELECT id FROM knowledge_items UNION SELECT id FROM procedures UNION SELECT id FROM learning_queue)")
def detect_entity_type(s: SparkSession, d: str) -> DataFrame:
    tables = {"knowledge_item": table(s, d, "knowledge_items"), "procedure": table(s, d, "procedures"), "queue": table(s, d, "learning_queue")}
    ids = tables["knowledge_item"].select("id").unionByName(tables["procedure"].select("id")).unionByName(tables["queue"].select("id"))
    return E.entity_types(ids, tables)


@query("""SELECT 'm' || (event_id % 20) AS category, event_type AS key, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'p' || (user_id % 3) END AS project_id, arg_max(value, event_id) AS value, count(*) AS confirmations FROM events GROUP BY 1, 2, 3""")
def upsert_core_memory(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    rows = e.select(F.concat(F.lit("m"), (F.col("event_id") % 20).cast("string")).alias("category"), F.col("event_type").alias("key"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("project_id"), "value", F.col("event_id").alias("seq"))
    state = rows.where("seq <= 500").transform(lambda x: E.upsert_memories(x.limit(0).withColumn("confirmations", F.lit(0).cast("bigint")).drop("seq"), x))
    return E.upsert_memories(state, rows.where("seq > 500"))


@query("WITH" + EDGES + """, i AS (SELECT source, target, relation, 0.5::DOUBLE AS weight FROM edges WHERE relation IN ('caused', 'led_to') UNION ALL SELECT source, target, 'seen_with', weight FROM edges WHERE weight >= 0.5),
u AS (SELECT source, target, relation, weight, usage_count FROM edges UNION ALL SELECT source, target, relation, weight, 1 FROM i) SELECT source, target, relation, round(max(weight), 6) AS weight, sum(usage_count)::BIGINT AS usage_count FROM u GROUP BY 1, 2, 3""")
def upsert_edge(s: SparkSession, d: str) -> DataFrame:
    """Edges of two relations come again with a weight of a half, and those of half the weight or more as a new relation."""
    e = edges(s, d)
    again = e.where("relation in ('caused', 'led_to')").withColumn("weight", F.lit(0.5)).unionByName(e.where("weight >= 0.5").withColumn("relation", F.lit("seen_with")))
    return E.upsert_edges(e, again).withColumn("weight", F.round("weight", 6))


@query("SELECT name, max(path) AS path FROM projects GROUP BY 1")
def get_or_create_project(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "projects").select("name", "path")
    return E.get_or_create(p.where("path is null or length(name) % 2 = 0"), p)


@query("""
WITH k AS (SELECT id, any_value(title) AS title FROM knowledge_items GROUP BY 1), old AS (SELECT id, (SELECT max(id) FROM k) AS n FROM k WHERE id < (SELECT max(id) FROM k) AND substr(id, 3, 1) = '4')
SELECT k.id, CASE WHEN old.id IS NOT NULL THEN n ELSE s.superseded_by END AS superseded_by FROM k JOIN (SELECT id, max(superseded_by) AS superseded_by FROM knowledge_items GROUP BY 1) s USING (id) LEFT JOIN old USING (id)""")
def supersede(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items").groupBy("id").agg(F.max("superseded_by").alias("superseded_by"), F.max("valid_until").alias("valid_until"))
    last = k.agg(F.max("id").alias("new_id"))
    old = k.where("substr(id, 3, 1) = '4'").select(F.col("id").alias("old_id"), F.lit("merged").alias("reason")).join(F.broadcast(last)).where("old_id < new_id")
    return E.supersede(k, old, AS_OF).select("id", "superseded_by")


@query("SELECT m.id FROM session_messages m WHERE EXISTS (SELECT 1 FROM learning_queue q WHERE q.session_id = m.session_id)")
def cascade_keep(s: SparkSession, d: str) -> DataFrame:
    return E.children_of(table(s, d, "session_messages"), table(s, d, "learning_queue"), "session_id", "session_id").select("id")


@query("SELECT id FROM session_messages WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM learning_queue)")
def delete_by_key(s: SparkSession, d: str) -> DataFrame:
    return E.delete_entities(table(s, d, "session_messages"), table(s, d, "learning_queue"), "session_id").select("id")


@query("WITH" + SEARCHES + """, c AS (SELECT DISTINCT 'e' || (event_id % 97) AS entity FROM events WHERE event_type = 'error'),
n AS (SELECT s.id, u.entity FROM searches s, unnest(s.result_ids) u(entity) WHERE NOT list_contains(clicked_ids, u.entity)),
r AS (SELECT id, entity, row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id DESC) AS rn FROM n JOIN searches USING (id) WHERE entity IN (SELECT entity FROM c))
SELECT id, list_sort(list(entity)) AS clicked FROM r WHERE rn = 1 GROUP BY 1""")
def click_attribution(s: SparkSession, d: str) -> DataFrame:
    log = searches(s, d)
    clicks = table(s, d, "events").where("event_type = 'error'").select(F.concat(F.lit("e"), (F.col("event_id") % 97).cast("string")).alias("entity"))
    after = E.click(log, clicks).select("id", "clicked_ids")
    before = log.select("id", F.size("clicked_ids").alias("had"))
    return after.join(before, "id").where("size(clicked_ids) > had").select("id", F.array_sort(F.expr("slice(clicked_ids, had + 1, size(clicked_ids) - had)")).alias("clicked"))
