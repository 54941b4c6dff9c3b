"""Queries of lifecycle jobs, text preparation, context packing and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import analytics as A
from siltstone.operators import chunking as K
from siltstone.operators import context as N
from siltstone.operators import lifecycle as L
from siltstone.queries.inputs import EVENTS_AS_OF, AS_OF, LOGS, SEARCHES, logs, searches
from siltstone.sources import adhoc, html, parsers
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


_D7, _D30 = "TIMESTAMPTZ '2025-06-23 00:00:00+00'", "TIMESTAMPTZ '2025-05-31 00:00:00+00'"


@query(f"""
WITH x AS (SELECT *, coalesce(last_accessed_at >= {_D7}, false) AS recent, CASE WHEN last_accessed_at IS NULL THEN created_at < {_D7} ELSE last_accessed_at < {_D7} END AS idle FROM knowledge_items),
y AS (SELECT *, CASE WHEN idle AND utility_score > 0.1 THEN utility_score * 0.95::DOUBLE WHEN recent THEN least(utility_score * 1.1::DOUBLE, 1.0::DOUBLE) ELSE utility_score END AS u FROM x)
SELECT id, round(u, 6) AS utility_score FROM y WHERE NOT coalesce(u < 0.1 AND created_at < {_D30}, false) AND NOT coalesce(superseded_by IS NOT NULL AND updated_at < {_D7}, false)""")
def memory_decay(s: SparkSession, d: str) -> DataFrame:
    return L.memory_decay(table(s, d, "knowledge_items"), AS_OF).select("id", F.round("utility_score", 6).alias("utility_score"))


@query("""
WITH o AS (SELECT (SELECT min(id) FROM procedures) AS id, event_type <> 'error' AS ok FROM events WHERE event_type IN ('purchase', 'error')), n AS (SELECT id, count(*) FILTER (WHERE ok) AS s, count(*) FILTER (WHERE NOT ok) AS f FROM o GROUP BY 1),
p AS (SELECT p.id, p.times_success + coalesce(s, 0) AS sc, p.times_failure + coalesce(f, 0) AS fl FROM procedures p LEFT JOIN n USING (id)),
q AS (SELECT *, (sc + fl)::DOUBLE AS n, sc::DOUBLE / nullif(sc + fl, 0) AS r FROM p)
SELECT id, sc AS times_success, fl AS times_failure, CASE WHEN n > 0 THEN round(greatest(0.0::DOUBLE, (r + 1.9208::DOUBLE / n - 1.96::DOUBLE * sqrt(r * (1 - r) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n)), 6) END AS success_rate FROM q""")
def record_outcomes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "procedures")
    first = F.broadcast(p.agg(F.min("id").alias("id")))
    o = table(s, d, "events").where("event_type in ('purchase', 'error')").select((F.col("event_type") != "error").alias("success")).join(first)
    return L.outcome_counts(p, o).select("id", "times_success", "times_failure", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT id FROM knowledge_items WHERE sr_next_review <= TIMESTAMPTZ '2025-06-30 00:00:00+00' AND superseded_by IS NULL")
def due_for_review(s: SparkSession, d: str) -> DataFrame:
    return L.due_for_review(table(s, d, "knowledge_items"), AS_OF).select("id")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 2.5::DOUBLE AS ef, 0 AS rep, 0 AS itv FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, i, ef2, CASE WHEN q < 3 THEN 0 ELSE rep + 1 END, CASE WHEN q < 3 OR rep = 0 THEN 1 WHEN rep = 1 THEN 6 ELSE round(itv::DOUBLE * ef2)::INT END FROM (
    SELECT e.user_id, e.i, f.rep, f.itv, event_id % 6 AS q, CASE WHEN event_id % 6 < 3 THEN f.ef ELSE greatest(f.ef + (0.1::DOUBLE - (5 - event_id % 6) * (0.08::DOUBLE + (5 - event_id % 6) * 0.02::DOUBLE)), 1.3::DOUBLE) END AS ef2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id AS id, round(ef, 6) AS easiness, rep AS repetitions, itv AS interval FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def review_history(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    rows = e.select(F.col("user_id").alias("id"), "ts", "event_id", (F.col("event_id") % 6).cast("int").alias("quality"))
    return L.review_history(rows, ["ts", "event_id"]).withColumn("easiness", F.round("easiness", 6))


@query("WITH" + SEARCHES + """, used AS (SELECT * FROM attributed WHERE query_type IS NOT NULL AND len(clicked_ids) > 0 AND created_at > TIMESTAMP '2024-01-24 00:00:00'), n AS (SELECT query_type, count(DISTINCT id) AS samples FROM used GROUP BY 1),
c AS (SELECT query_type, signal, count(*) FILTER (WHERE list_contains(clicked_ids, entity)) / count(*)::DOUBLE AS rate FROM used GROUP BY 1, 2),
u(query_type, fts, dense, raptor, graph, cue) AS (VALUES ('semantic', 1.0, 1.5, 1.0, 0.5, 0.0), ('temporal', 0.5, 1.0, 0.3, 0.5, 1.5), ('causal', 0.5, 1.0, 0.5, 2.0, 1.5), ('decision', 1.0, 1.0, 0.5, 1.0, 0.0), ('procedural', 1.5, 1.0, 0.5, 0.3, 0.0)),
v AS (UNPIVOT u ON fts, dense, raptor, graph, cue INTO NAME signal VALUE usual),
j AS (SELECT v.query_type, v.signal, usual::DOUBLE AS usual, samples, coalesce(rate, 0) AS rate, max(coalesce(rate, 0)) OVER (PARTITION BY v.query_type) AS best FROM v JOIN n ON n.query_type = v.query_type LEFT JOIN c ON c.query_type = v.query_type AND c.signal = v.signal)
SELECT query_type, signal, samples, round(0.3::DOUBLE * (0.3::DOUBLE + 1.7::DOUBLE * rate / best) + 0.7::DOUBLE * usual, 6) AS weight FROM j WHERE samples >= 10 AND best > 0""")
def weight_learning(s: SparkSession, d: str) -> DataFrame:
    return L.learn_weights(A.signal_ctr(searches(s, d), EVENTS_AS_OF)).withColumn("weight", F.round("weight", 6))


@query("""SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY queued_at DESC, id DESC) AS rn FROM learning_queue WHERE status = 'pending')
WHERE rn = 1 AND (epoch_us(TIMESTAMPTZ '2025-06-30 00:00:00+00') - epoch_us(queued_at)) / 1e6 > 180""")
def debounced_queue(s: SparkSession, d: str) -> DataFrame:
    return L.debounced(table(s, d, "learning_queue"), AS_OF).select("id")


@query("""WITH i AS (SELECT DISTINCT session_id FROM learning_queue WHERE status = 'processing')
SELECT id, CASE WHEN status = 'pending' AND session_id IN (SELECT session_id FROM i) THEN 'cancelled' ELSE status END AS status FROM learning_queue UNION ALL SELECT 'again-' || session_id, 'pending' FROM i""")
def enqueue(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "learning_queue")
    again = q.where("status = 'processing'").select("session_id").distinct().select(F.concat(F.lit("again-"), "session_id").alias("id"), "session_id")
    return L.enqueue(q, again).select("id", "status")


@query("""WITH r AS (SELECT id, retry_count, status FROM learning_queue QUALIFY row_number() OVER (PARTITION BY id ORDER BY retry_count DESC, list_position(['failed_permanent', 'cancelled', 'completed', 'processing', 'pending'], status) NULLS LAST, status DESC) = 1)
SELECT id, retry_count + CASE WHEN status = 'processing' THEN 1 ELSE 0 END AS retry_count, CASE WHEN status <> 'processing' THEN status WHEN retry_count + 1 >= 3 THEN 'failed_permanent' ELSE 'pending' END AS status FROM r""")
def retry_queue(s: SparkSession, d: str) -> DataFrame:
    """All ids, those with repeated rows too: each in its last state."""
    q = L.one_state(table(s, d, "learning_queue"))
    return L.retried(q, q.where("status = 'processing'"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_no FROM g) SELECT user_id, session_no, count(*) AS n FROM h GROUP BY 1, 2""")
def debounced_sessions(s: SparkSession, d: str) -> DataFrame:
    return L.sessions_of(table(s, d, "events"), "user_id", "ts", 86400.0).select("user_id", "session_no", "n")


@query("WITH" + LOGS + "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, timestamp)) AS start, target, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY 1, 2")
def error_windows(s: SparkSession, d: str) -> DataFrame:
    return L.windows(logs(s, d).where("level = 'ERROR'"), "timestamp", ["target"], "1 hour").withColumn("start", F.unix_micros("start"))


@query("WITH" + LOGS + """, r(name, threshold, w, l, t, p, last) AS (VALUES ('any', 10, 86400, NULL, NULL, NULL, NULL::TIMESTAMP), ('errors', 2, 172800, 'ERROR', NULL, NULL, NULL), ('svc', 1, 604800, NULL, 'svc.1', 'node-[0-3]$', NULL), ('quiet', 1, 604800, NULL, NULL, NULL, TIMESTAMP '2024-01-30 12:00:00'), ('high', 1000000, 604800, NULL, NULL, NULL, NULL))
SELECT name AS rule, count(*) AS n FROM logs JOIN r ON timestamp > TIMESTAMP '2024-01-31 00:00:00' - to_seconds(w) AND timestamp <= TIMESTAMP '2024-01-31 00:00:00' AND (l IS NULL OR level = l) AND (t IS NULL OR starts_with(target, t)) AND (p IS NULL OR regexp_matches(message, p))
WHERE last IS NULL OR date_diff('second', last, TIMESTAMP '2024-01-31 00:00:00') >= w GROUP BY name, threshold HAVING count(*) >= threshold""")
def alert_windows(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame(
        [("any", 10, 86400, None, None, None, None), ("errors", 2, 172800, "ERROR", None, None, None), ("svc", 1, 604800, None, "svc.1", "node-[0-3]$", None), ("quiet", 1, 604800, None, None, None, "2024-01-30 12:00:00"), ("high", 1000000, 604800, None, None, None, None)],
        "name string, threshold int, window_secs int, filter_level string, filter_target string, filter_pattern string, last string",
    ).withColumn("last_triggered_at", F.col("last").cast("timestamp"))
    return L.alerts(logs(s, d), rules, EVENTS_AS_OF)


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, ts, 5.0::DOUBLE - 1 AS tokens, true AS allowed FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, ts, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, t >= 1 FROM (SELECT e.user_id, e.i, e.ts, least(5.0::DOUBLE, f.tokens + (epoch_us(e.ts) - epoch_us(f.ts)) / 1000000.0::DOUBLE * 5.0 / 86400.0) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, allowed, count(*) AS n FROM f GROUP BY 1, 2""")
def rate_limited(s: SparkSession, d: str) -> DataFrame:
    rows = L.token_bucket(table(s, d, "events"), "user_id", "ts", 5, 86400.0)
    return rows.groupBy("user_id", "allowed").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, ts AS last, true AS ok FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, CASE WHEN epoch_us(e.ts) - epoch_us(f.last) >= 43200000000 THEN e.ts ELSE f.last END, epoch_us(e.ts) - epoch_us(f.last) >= 43200000000 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, count(*) AS n FROM f WHERE ok GROUP BY 1""")
def cooldown(s: SparkSession, d: str) -> DataFrame:
    return L.cooled_down(table(s, d, "events"), "user_id", "ts", 43200.0).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 0 AS chunk_no, ceil(strlen(text) / 4.0)::BIGINT AS tokens, md5(text) AS md5 FROM documents WHERE text <> '' AND ceil(strlen(text) / 4.0) <= 6000")
def chunked_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents that fit one chunk are given as they are; larger ones are those of markdown_chunks."""
    docs = table(s, d, "documents")
    fits = docs.where(F.ceil(F.octet_length("text") / 4.0) <= 6000).select("doc_id")
    return K.chunks(docs, "doc_id", "text").join(fits, "doc_id", "left_semi").select("doc_id", "chunk_no", "tokens", F.md5("chunk").alias("md5"))


@query()
def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    return K.chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_no", "tokens", F.md5("chunk").alias("md5"))


@query()
def transcript_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "learning_queue").groupBy("id").agg(F.first("transcript", ignorenulls=True).alias("transcript"))
    return K.chunks(rows, "id", "transcript", K.chunk_transcript).select("id", "chunk_no", "tokens", F.md5("chunk").alias("md5"))


@query("""WITH RECURSIVE k AS (SELECT project_id, kind, sum(strlen(content))::BIGINT AS bytes, max(utility_score) AS u FROM knowledge_items WHERE project_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY u DESC, kind) AS i FROM k),
f AS (SELECT project_id, i, kind, bytes, bytes <= 12000 AS took, CASE WHEN bytes <= 12000 THEN bytes ELSE 0 END AS used FROM b WHERE i = 1
  UNION ALL SELECT b.project_id, b.i, b.kind, b.bytes, f.used + b.bytes <= 12000, CASE WHEN f.used + b.bytes <= 12000 THEN f.used + b.bytes ELSE f.used END FROM f JOIN b ON b.project_id = f.project_id AND b.i = f.i + 1)
SELECT project_id, kind AS section, bytes AS used FROM f WHERE took AND bytes > 0""")
def context_pack(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items").where("project_id is not null").groupBy("project_id", "kind").agg(F.sum(F.octet_length("content")).alias("bytes"), F.max("utility_score").alias("u"))
    rows = k.select("project_id", F.col("kind").alias("section"), "bytes", F.rank().over(_by("project_id")).alias("priority"))
    return N.pack_sections(rows, "project_id", 12_000)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy(F.desc("u"), "kind")


@query()
def optimized_context(s: SparkSession, d: str) -> DataFrame:
    return N.optimize(table(s, d, "documents"), "doc_id", "text", 500).select("doc_id", "bytes_before", "bytes_after", "saved")


@query("""WITH t AS (SELECT DISTINCT id, '[TOOL: read]' || chr(10) || CASE WHEN length(transcript) % 2 = 0 THEN 'tool_call: edit now' || chr(10) ELSE '' END || transcript AS t FROM learning_queue WHERE transcript IS NOT NULL),
l AS (SELECT id, trim(unnest(string_split(t, chr(10)))) AS l FROM t)
SELECT id, CASE WHEN regexp_matches(l, '^\\[(TOOL|Tool):[^\\]]*\\]$') THEN trim(regexp_extract(l, ':([^\\]]*)\\]', 1)) ELSE regexp_extract(l, ':\\s*(\\S+)', 1) END AS tool, count(*) AS n FROM l
WHERE regexp_matches(l, '^\\[(TOOL|Tool):[^\\]]*[^\\s\\]][^\\]]*\\]$') OR regexp_matches(l, '^(tool_call|Tool):\\s*\\S+') GROUP BY 1, 2""")
def tool_calls(s: SparkSession, d: str) -> DataFrame:
    """Transcripts, each with a call or two put before it."""
    edit = F.when(F.length("transcript") % 2 == 0, F.lit("tool_call: edit now\n")).otherwise("")
    rows = table(s, d, "learning_queue").where("transcript is not null").select("id", F.concat(F.lit("[TOOL: read]\n"), edit, "transcript").alias("t")).distinct()
    return parsers.tool_calls(rows, "id", "t").groupBy("id", "tool").agg(F.count("*").alias("n"))


@query()
def html_markdown(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<html><head><title>Doc "), F.col("doc_id").cast("string"), F.lit("</title></head><body><nav>x</nav><p>"), F.col("text"), F.lit("</p></body></html>")).alias("html"))
    return html.pages_to_markdown(rows, "doc_id", "html").select("doc_id", "title", F.md5("markdown").alias("md5"))


@query("SELECT entity_type, count(*) AS n FROM documents GROUP BY 1")
def adhoc_sql(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "documents").createOrReplaceTempView("adhoc_documents")
    return adhoc.query(s, "SELECT entity_type, count(*) AS n FROM adhoc_documents GROUP BY 1")


@query("SELECT 'projects' AS table_name, 'id' AS column_name UNION ALL SELECT 'projects', 'name' UNION ALL SELECT 'projects', 'path' UNION ALL SELECT 'projects', 'created_at' UNION ALL SELECT 'projects', 'updated_at'")
def catalog(s: SparkSession, d: str) -> DataFrame:
    return adhoc.describe({"projects": table(s, d, "projects")}).select("table_name", "column_name")


@query("SELECT id, name AS value, sha256(name) AS hash FROM projects")
def vault(s: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    stored = table(s, d, "projects").select("id", adhoc.encrypt(F.col("name"), key).alias("secret"), adhoc.key_hash(F.col("name")).alias("hash"))
    return stored.select("id", adhoc.decrypt(F.col("secret"), key).alias("value"), "hash")


@query("""WITH e AS (SELECT doc_id::VARCHAR AS id, 'episode' AS kind, created_at AS t FROM documents WHERE entity_type = 'episode' UNION ALL SELECT doc_id::VARCHAR, 'session', created_at FROM documents WHERE entity_type = 'session')
SELECT id, kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM e WHERE t >= TIMESTAMPTZ '2025-03-01 00:00:00+00' AND t < TIMESTAMPTZ '2025-03-08 00:00:00+00'""")
def timeline(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("created_at >= timestamp '2025-03-01 00:00:00' and created_at < timestamp '2025-03-08 00:00:00'")
    rows = docs.where("entity_type in ('episode', 'session')").select(F.col("doc_id").cast("string").alias("id"), F.col("entity_type").alias("kind"), F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("minute"))
    return rows.orderBy(F.desc("minute"), "id")


@query("SELECT doc_id FROM (SELECT doc_id, created_at FROM documents WHERE entity_type = 'git_commit' AND created_at IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 50) WHERE created_at > TIMESTAMPTZ '2025-06-23 00:00:00+00'")
def git_timeline(s: SparkSession, d: str) -> DataFrame:
    """The limit comes before the cut-off: of the 50 latest commits those of the last week."""
    latest = table(s, d, "documents").where("entity_type = 'git_commit' and created_at is not null").orderBy(F.desc("created_at"), "doc_id").limit(50)
    return latest.where(A.since(F.col("created_at"), AS_OF, 7)).select("doc_id")


@query("SELECT change_type, file_path, count(*) AS n FROM (SELECT CASE upper(left(change_type, 1)) WHEN 'A' THEN 'add' WHEN 'M' THEN 'modify' WHEN 'D' THEN 'delete' WHEN 'R' THEN 'rename' END AS change_type, file_path FROM git_activity WHERE file_path <> '' AND file_path IS NOT NULL) GROUP BY 1, 2")
def name_status(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "git_activity").where("file_path <> ''").select(F.concat(F.upper(F.left("change_type", F.lit(1))), F.lit("\t"), "file_path").alias("line"))
    return parsers.name_status(g).groupBy("change_type", "file_path").agg(F.count("*").alias("n"))
