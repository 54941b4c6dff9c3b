"""Queries of writes, upkeep, contexts and parsers that have no table of their own: inputs are drawn from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import context, entities, records, upkeep
from siltstone.operators import lifecycle as L
from siltstone.operators.hybrid import relations as related
from siltstone.queries.inputs import AS_OF, EDGES, EPISODES, MEMORIES, edges, episodes, memories
from siltstone.sources import parsers
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


_NOW = "TIMESTAMPTZ '2025-06-30 00:00:00+00'"


def _once(s: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return table(s, d, name).groupBy("id").agg(*(F.max(c).alias(c) for c in columns))


@query("SELECT kind, count(*) AS n FROM (SELECT kind FROM knowledge_items UNION ALL SELECT coalesce(CASE WHEN length(title) % 2 = 0 THEN 'pattern' END, 'artifact') FROM (SELECT DISTINCT title, content FROM procedures)) GROUP BY 1")
def insert_entity(s: SparkSession, d: str) -> DataFrame:
    """Procedures as new items, every other one without a kind."""
    new = table(s, d, "procedures").select("title", "content").distinct().withColumn("kind", F.when(F.length("title") % 2 == 0, "pattern"))
    return records.inserted(table(s, d, "knowledge_items"), new, "knowledge_item", AS_OF).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT id FROM knowledge_items UNION ALL SELECT 'new' || i FROM range(0, 50) t(i))")
def bulk_create(s: SparkSession, d: str) -> DataFrame:
    new = s.range(50).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"), F.lit("c").alias("content"))
    return records.inserted(table(s, d, "knowledge_items"), new, "knowledge_item", AS_OF, most=100).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT commit_hash, count(*) AS files, sum(coalesce(lines_added, 0))::BIGINT AS added, sum(coalesce(lines_removed, 0))::BIGINT AS removed FROM git_activity GROUP BY 1")
def record_commit(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "git_activity").groupBy("commit_hash").agg(F.max("project_id").alias("project_id"), F.max("commit_message").alias("commit_message"), F.collect_list(F.struct("file_path", "change_type", "lines_added", "lines_removed")).alias("files"))
    return records.commit_rows(g, AS_OF).groupBy("commit_hash").agg(F.count("*").alias("files"), F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed"))


@query("WITH" + EPISODES + "SELECT id, resolved OR kind = 'error' AS resolved FROM episodes")
def resolve_episode(s: SparkSession, d: str) -> DataFrame:
    e = episodes(s, d)
    return records.resolve_episodes(e, e.where("kind = 'error'"), AS_OF).select("id", "resolved")


@query("WITH" + EPISODES + "SELECT id, kind, title FROM episodes WHERE resolved = false AND kind = 'decision' ORDER BY created_at DESC NULLS LAST, id LIMIT 20")
def list_episodes(s: SparkSession, d: str) -> DataFrame:
    return entities.listed(episodes(s, d), {"kind": "decision", "resolved": False}, None, [F.desc_nulls_last("created_at"), F.asc("id")]).select("id", "kind", "title")


@query("WITH" + EPISODES + """, c AS (SELECT *, list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}_-]+'), lambda w: strlen(w) >= 3) AS what, CASE WHEN project_id IS NULL THEN []::VARCHAR[] ELSE [project_id] END AS place FROM episodes)
SELECT id FROM c WHERE list_has_any(what, ['nightly', 'cache', 'planner', 'stale']) AND list_has_any(place, (SELECT list(id) FROM projects))""")
def cue_search_5w(s: SparkSession, d: str) -> DataFrame:
    """Two of the five questions: what, by the words of the title, and where, by the project."""
    from siltstone.functions.text import extract_cues

    where = [r.id for r in table(s, d, "projects").select("id").collect()]
    rows = episodes(s, d).withColumns({"what": extract_cues(F.col("title")), "place": F.when(F.col("project_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("project_id"))})
    return entities.cue_search(rows, {"what": ["nightly", "cache", "planner", "stale"], "place": where, "who": []}).select("id")


@query("WITH" + EPISODES + "SELECT id FROM episodes ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, created_at DESC NULLS LAST, id LIMIT 30")
def severity_sort(s: SparkSession, d: str) -> DataFrame:
    return records.by_severity(episodes(s, d)).limit(30).select("id")


@query("WITH" + MEMORIES + "SELECT id, category, key FROM memories WHERE project_id IS NULL ORDER BY confirmations DESC, id LIMIT 50")
def list_global(s: SparkSession, d: str) -> DataFrame:
    return entities.listed(memories(s, d).where("project_id is null"), None, None, [F.desc("confirmations"), F.asc("id")], 50).select("id", "category", "key")


@query("WITH" + MEMORIES + "SELECT id, CASE WHEN category = 'pattern' THEN 'changed' ELSE value END AS value, confirmations + CASE WHEN category IN ('pattern', 'fact') THEN 1 ELSE 0 END AS confirmations FROM memories")
def merge_core_memory(s: SparkSession, d: str) -> DataFrame:
    m = memories(s, d).withColumn("confidence", F.lit(0.5))
    changes = m.where("category in ('pattern', 'fact')").select("id", F.when(F.col("category") == "pattern", "changed").alias("value"), F.lit(None).cast("double").alias("confidence"))
    return records.merge_memories(m, changes).select("id", "value", "confirmations")


@query("WITH" + MEMORIES + "SELECT id, CASE WHEN category = 'fact' THEN 2 ELSE 0 END AS contradictions FROM memories")
def record_contradiction(s: SparkSession, d: str) -> DataFrame:
    m = memories(s, d)
    facts = m.where("category = 'fact'").select("id")
    return records.record_contradictions(m, facts.unionByName(facts)).select("id", F.col("contradictions").cast("int").alias("contradictions"))


@query("WITH q AS (SELECT DISTINCT session_id AS id FROM learning_queue), m AS (SELECT DISTINCT session_id AS id FROM session_messages WHERE session_id IS NOT NULL) SELECT coalesce(q.id, m.id) AS id, CASE WHEN q.id IS NULL THEN 'active' ELSE 'done' END AS status FROM q FULL JOIN m ON q.id = m.id")
def ensure_sessions(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "learning_queue").select(F.col("session_id").alias("id")).distinct().withColumns({"status": F.lit("active"), "created_at": F.lit(None).cast("timestamp")})
    done = records.set_where(known, known, {"status": F.lit("done")})
    return records.ensure_sessions(done, table(s, d, "session_messages").select(F.col("session_id").alias("id")), AS_OF).select("id", "status")


@query("SELECT session_id, md5(string_agg(content, chr(10) ORDER BY created_at NULLS FIRST, id, content)) AS md5 FROM session_messages WHERE session_id IS NOT NULL AND content IS NOT NULL GROUP BY 1")
def session_transcripts(s: SparkSession, d: str) -> DataFrame:
    return records.transcript_texts(table(s, d, "session_messages")).select("session_id", F.md5("transcript_text").alias("md5"))


@query(f"SELECT id, CASE WHEN length(name) % 2 = 0 THEN 'completed' ELSE 'active' END AS status, CASE WHEN length(name) % 2 = 0 THEN epoch_us({_NOW}) END AS completed_at FROM projects")
def work_units(s: SparkSession, d: str) -> DataFrame:
    units = table(s, d, "projects").select("id", "name", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"), "updated_at")
    out = records.work_unit_status(units, units.where("length(name) % 2 = 0").select("id", F.lit("completed").alias("status")), AS_OF)
    return out.select("id", "status", F.unix_micros("completed_at").alias("completed_at"))


@query("SELECT session_id AS id, max(project_id) AS work_unit_id FROM learning_queue GROUP BY 1")
def link_sessions(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "learning_queue")
    known = q.select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("work_unit_id")).distinct()
    return records.link_sessions(known, q.select(F.col("session_id").alias("id"), F.col("project_id").alias("work_unit_id")))


@query("""SELECT * FROM (VALUES ('semantic', 'fts', 1.5::DOUBLE), ('semantic', 'dense', 0.5::DOUBLE), ('causal', 'graph', 2.0::DOUBLE)) t(query_type, signal, weight)""")
def signal_weights(s: SparkSession, d: str) -> DataFrame:
    schema = "query_type string, signal string, weight double, samples bigint"
    old = s.createDataFrame([("semantic", "fts", 1.0, 10), ("semantic", "dense", 0.5, 10)], schema)
    return records.upsert_weights(old, s.createDataFrame([("semantic", "fts", 1.5, 20), ("causal", "graph", 2.0, 12)], schema)).select("query_type", "signal", "weight")


@query("SELECT event_type AS fingerprint, count(*) AS event_count, CASE WHEN max(event_id) > 500 THEN 'open' ELSE 'resolved' END AS status, epoch_us(min(ts)) AS first_seen FROM events GROUP BY 1")
def error_group_merge(s: SparkSession, d: str) -> DataFrame:
    """Groups of events up to number 500 are resolved; those seen after that are open again."""
    e = table(s, d, "events")
    groups = lambda rows: rows.groupBy(F.col("event_type").alias("fingerprint")).agg(F.lit("t").alias("title"), F.lit("x").alias("target"), F.count("*").alias("event_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    out = records.merge_error_groups(groups(e.where("event_id <= 500")).withColumn("status", F.lit("resolved")), groups(e.where("event_id > 500")))
    return out.select("fingerprint", "event_count", "status", F.unix_micros("first_seen").alias("first_seen"))


@query("SELECT action, count(*) AS n FROM (SELECT event_type AS action FROM events WHERE event_id <= 500 UNION ALL SELECT 'delete' FROM projects) GROUP BY 1")
def audit_log(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events").where("event_id <= 500").select(F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("ts").alias("created_at"))
    more = table(s, d, "projects").select(F.lit("admin").alias("actor"), F.lit("delete").alias("action"), F.lit("project").alias("entity_type"), F.col("id").alias("entity_id"))
    return records.audited(log, more, AS_OF).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id AS source, superseded_by AS target FROM knowledge_items WHERE superseded_by IS NOT NULL AND project_id = (SELECT min(project_id) FROM knowledge_items WHERE superseded_by IS NOT NULL)")
def edge_item_join(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items")
    e = k.where("superseded_by is not null").select(F.col("id").alias("source"), F.col("superseded_by").alias("target")).distinct()
    first = k.where("superseded_by is not null").agg(F.min("project_id")).first()[0]
    return records.edges_of_items(e, k, first)


@query("SELECT count(*) AS searches, coalesce(sum(user_id)::BIGINT // count(*), 0) AS avg_ms, max(user_id)::BIGINT AS max_ms FROM events")
def system_metrics(s: SparkSession, d: str) -> DataFrame:
    return records.search_metrics(table(s, d, "events").withColumn("ms", F.col("user_id").cast("bigint")), "ms")


@query("WITH" + EDGES + "SELECT source, target, relation, round(weight, 6) AS weight FROM edges WHERE target = 'view-1'")
def relations(s: SparkSession, d: str) -> DataFrame:
    return related(edges(s, d), "view-1", 1, "incoming").select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query("SELECT * FROM (SELECT id, needs_embedding AND id NOT IN (SELECT id FROM (SELECT id, bool_or(needs_embedding) AS due, min(created_at) AS c FROM procedures GROUP BY 1) WHERE due ORDER BY c, id LIMIT 50) AS needs_embedding FROM (SELECT id, bool_or(needs_embedding) AS needs_embedding FROM procedures GROUP BY 1))")
def embedding_backfill(s: SparkSession, d: str) -> DataFrame:
    from siltstone.operators.models import embedded

    p = table(s, d, "procedures").groupBy("id").agg(F.max("content").alias("content"), F.max("needs_embedding").alias("needs_embedding"), F.min("created_at").alias("created_at"))
    return upkeep.backfill(p, embedded, F.col("content"))[1].select("id", "needs_embedding")


@query()
def dedup_cascade(s: SparkSession, d: str) -> DataFrame:
    """Procedures of May and later against the earlier ones, sessions by day."""
    from siltstone.operators.models import embedded

    p = _once(s, d, "procedures", "title", "content", "created_at").withColumn("embedding", embedded(F.col("content")))
    new = p.where("created_at >= timestamp '2025-05-01'").select("id", F.to_date("created_at").cast("string").alias("session_id"), F.unix_micros("created_at").alias("pos"), "title", "embedding")
    return upkeep.unseen(new, p.where("created_at < timestamp '2025-05-01'").select("title", "embedding"), 0.6).select("id", "session_id")


@query()
def consolidation(s: SparkSession, d: str) -> DataFrame:
    from siltstone.operators.models import embedded

    k = _once(s, d, "knowledge_items", "title", "content", "project_id", "superseded_by", "updated_at").withColumn("embedding", embedded(F.col("content")))
    none = s.createDataFrame([], "source string, target string, relation string, weight double, usage_count bigint")
    merged, replaced, _ = upkeep.consolidate(k, none)
    return replaced.join(merged.select(F.col("id").alias("new_id"), "title"), "new_id").groupBy("new_id", "title").agg(F.count("*").alias("members"))


@query()
def promoted_copies(s: SparkSession, d: str) -> DataFrame:
    copies, made = upkeep.promote(_once(s, d, "knowledge_items", "title", "content", "project_id"))
    return made.groupBy("source").agg(F.count("*").alias("sources")).join(copies.select(F.col("id").alias("source"), "title"), "source")


@query("""WITH c AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
x AS (SELECT user_id, t AS a, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS c, lead(t, 3) OVER w AS d, lead(t, 4) OVER w AS e FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT user_id, [a, b, c] AS steps FROM x WHERE c IS NOT NULL UNION ALL SELECT user_id, [a, b, c, d] FROM x WHERE d IS NOT NULL UNION ALL SELECT user_id, [a, b, c, d, e] FROM x WHERE e IS NOT NULL),
n AS (SELECT user_id, steps, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, 'Tool sequence: ' || array_to_string(steps, ' → ') AS title, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, len(steps) DESC, array_to_string(steps, chr(31))) <= 5""")
def tool_sequences(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = table(s, d, "events").select("user_id", F.row_number().over(w).alias("pos"), F.col("event_type").alias("tool"))
    return upkeep.tool_sequences(calls, "user_id").select("user_id", "title", "n")


@query("""WITH p AS (SELECT id, max(updated_at) AS u, max(times_success) AS s, max(times_failure) AS f FROM procedures WHERE project_id = (SELECT min(project_id) FROM procedures) GROUP BY 1), shown AS (SELECT id FROM p ORDER BY u DESC, id LIMIT 50)
SELECT id, s + 1 AS times_success, f AS times_failure FROM p WHERE id IN (SELECT id FROM shown) UNION ALL SELECT id, s, f FROM p WHERE id NOT IN (SELECT id FROM shown)""")
def outcome_detect(s: SparkSession, d: str) -> DataFrame:
    """Every procedure, and one that doesn't exist, is reported as a success of the first project."""
    first = table(s, d, "procedures").agg(F.min("project_id")).first()[0] or ""
    p = table(s, d, "procedures").where(F.col("project_id") == first).groupBy("id").agg(*(F.max(c).alias(c) for c in ("project_id", "updated_at", "times_success", "times_failure", "times_used", "success_rate")))
    told = table(s, d, "procedures").select("id").unionByName(s.createDataFrame([("made up",)], "id string")).distinct().withColumn("success", F.lit(True))
    return L.outcome_counts(p, upkeep.valid_outcomes(told, p, first)).select("id", "times_success", "times_failure")


@query("""SELECT DISTINCT session_id AS source, file_path AS target, 'mentions' AS relation FROM (SELECT commit_hash AS session_id, file_path, row_number() OVER (PARTITION BY commit_hash ORDER BY id) AS rn FROM git_activity) WHERE rn <= 20 AND trim(file_path) <> ''""")
def entity_edges(s: SparkSession, d: str) -> DataFrame:
    """Commits as sessions, their files as entities."""
    from siltstone.operators.models import ENTITY_TYPES

    found = table(s, d, "git_activity").select(F.col("commit_hash").alias("session_id"), F.col("id").alias("pos"), F.col("file_path").alias("name"), F.lit("file").alias("entity_type"))
    return upkeep.entity_edges(found, ENTITY_TYPES).select("source", "target", "relation")


@query("SELECT id, md5(transcript) AS md5 FROM (SELECT DISTINCT id, transcript FROM learning_queue) WHERE strlen(transcript) <= 32000")
def session_state(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "learning_queue").where("transcript is not null").select("id", "transcript").distinct()
    last = rows.withColumn("last", upkeep.last_part(F.col("transcript")))
    return last.where(F.octet_length("transcript") <= 32_000).select("id", F.md5("last").alias("md5"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    m = memories(s, d).select("project_id", F.when(F.col("project_id").isNull(), "global_memories").otherwise("core_memories").alias("section"), F.col("id").alias("place"), F.concat(F.lit("["), "category", F.lit("] "), "key", F.lit(": "), "value").alias("line"), F.col("id").alias("entity_id"))
    e = episodes(s, d).where("not resolved and project_id is not null").select("project_id", F.lit("unresolved_episodes").alias("section"), F.col("id").alias("place"), F.concat(F.lit("["), "kind", F.lit("] "), "title", F.lit(": "), F.left("content", F.lit(200))).alias("line"), F.col("id").alias("entity_id"))
    k = table(s, d, "knowledge_items").where("kind = 'pattern' and project_id is not null").groupBy("id").agg(*(F.max(c).alias(c) for c in ("title", "content", "project_id")))
    k = k.select("project_id", F.lit("project_patterns").alias("section"), F.col("id").alias("place"), F.concat(F.lit("## "), "title", F.lit("\n"), F.left("content", F.lit(300))).alias("line"), F.col("id").alias("entity_id"))
    p = table(s, d, "procedures").where("project_id is not null and success_rate > 0.3").groupBy("id").agg(*(F.max(c).alias(c) for c in ("title", "content", "project_id")))
    p = p.select("project_id", F.lit("proven_procedures").alias("section"), F.col("id").alias("place"), F.concat(F.lit("## "), "title", F.lit("\n"), F.left("content", F.lit(300))).alias("line"), F.col("id").alias("entity_id"))
    return m.unionByName(e).unionByName(k).unionByName(p)


_CONTEXT = "WITH RECURSIVE" + EPISODES + "," + MEMORIES + """,
li AS (SELECT project_id, CASE WHEN project_id IS NULL THEN 1 ELSE 0 END AS o, id, '[' || category || '] ' || key || ': ' || value AS line FROM memories
  UNION ALL SELECT project_id, 2, id, '[' || kind || '] ' || title || ': ' || left(content, 200) FROM episodes WHERE NOT resolved AND project_id IS NOT NULL
  UNION ALL SELECT max(project_id), 4, id, '## ' || max(title) || chr(10) || left(max(content), 300) FROM knowledge_items WHERE kind = 'pattern' AND project_id IS NOT NULL GROUP BY id
  UNION ALL SELECT max(project_id), 5, id, '## ' || max(title) || chr(10) || left(max(content), 300) FROM procedures WHERE project_id IS NOT NULL AND success_rate > 0.3 GROUP BY id),
mo(o, section, header, most) AS (VALUES (0, 'core_memories', 'CORE MEMORIES', 50), (1, 'global_memories', 'GLOBAL MEMORIES', 50), (2, 'unresolved_episodes', 'UNRESOLVED ISSUES', 10), (4, 'project_patterns', 'PROJECT PATTERNS', 10), (5, 'proven_procedures', 'PROVEN PROCEDURES', 10)),
n AS (SELECT li.*, section, header, row_number() OVER (PARTITION BY li.project_id, li.o ORDER BY id) AS rn, most FROM li JOIN mo USING (o)),
a AS (SELECT p.id AS project_id, o, section, header, rn, line FROM n JOIN (SELECT DISTINCT id FROM projects) p ON n.project_id = p.id OR n.project_id IS NULL WHERE rn <= most),
t AS (SELECT project_id, o, section, chr(10) || '=== ' || max(header) || ' ===' || chr(10) || string_agg(line || chr(10), '' ORDER BY rn) || chr(10) AS text FROM a GROUP BY 1, 2, 3),
b AS (SELECT *, strlen(text) AS bytes, row_number() OVER (PARTITION BY project_id ORDER BY o) AS i FROM t),
f AS (SELECT project_id, i, section, text, bytes <= 8000 AS took, CASE WHEN bytes <= 8000 THEN bytes ELSE 0 END AS used FROM b WHERE i = 1
  UNION ALL SELECT b.project_id, b.i, b.section, b.text, f.used + b.bytes <= 8000, CASE WHEN f.used + b.bytes <= 8000 THEN f.used + b.bytes ELSE f.used END FROM f JOIN b ON b.project_id = f.project_id AND b.i = f.i + 1)
"""


@query(_CONTEXT + "SELECT project_id, section, md5(text) AS md5 FROM f WHERE took")
def build_context(s: SparkSession, d: str) -> DataFrame:
    """Five of the sections, for every project, within 8,000 bytes."""
    out = context.session_context(_lines(s, d), table(s, d, "projects"), 8000)
    return out.select("project_id", "section", F.md5("text").alias("md5"))


@query()
def generate_guide(s: SparkSession, d: str) -> DataFrame:
    heads = {"pattern": "Conventions", "artifact": "Project Info", "fact": "Critical Rules"}
    m = memories(s, d).where("project_id is not null").select("project_id", F.coalesce(*(F.when(F.col("category") == c, F.lit(h)) for c, h in heads.items()), F.lit("Preferences")).alias("heading"), F.concat(F.lit("- **"), "key", F.lit("**: "), "value").alias("line"))
    e = records.by_severity(episodes(s, d).where("not resolved and project_id is not null")).select("project_id", F.lit("Active Issues").alias("heading"), F.concat(F.lit("- **"), "title", F.lit("**")).alias("line"))
    bodies = m.unionByName(e).groupBy("project_id", "heading").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    return context.guide(bodies, "Project", 4000).select("project_id", F.octet_length("text").alias("bytes"), F.md5("text").alias("md5"))


@query("""SELECT commit_hash, count(*) AS n FROM (SELECT DISTINCT commit_hash, change_type, file_path FROM git_activity WHERE file_path IS NOT NULL AND file_path <> '' AND file_path NOT LIKE '% ' AND file_path NOT LIKE ' %') GROUP BY 1""")
def git_log(s: SparkSession, d: str) -> DataFrame:
    """The commits written out as a log and read again."""
    g = table(s, d, "git_activity").where("file_path <> '' and file_path not like '% ' and file_path not like ' %'")
    lines = F.array_join(F.array_sort(F.collect_set(F.concat(F.upper(F.left("change_type", F.lit(1))), F.lit("\t"), "file_path"))), "\n")
    log = g.groupBy("commit_hash").agg(F.concat(F.lit("\x1e"), F.first("commit_hash"), F.lit("\x1fann\x1f1700000000\x1fsubject\n"), lines).alias("text"))
    return parsers.git_log(log.select("text")).groupBy("commit_hash").agg(F.count("*").alias("n"))


@query()
def symbols(s: SparkSession, d: str) -> DataFrame:
    """Code in documents' text, as if each were a source file."""
    rows = table(s, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("pub struct Doc {\n}\nimpl Doc {\n    pub fn read(&self) -> Text::Kind {\n    }\n}\n"), "text").alias("text"))
    return parsers.symbols(rows).groupBy("symbol_name", "symbol_type", "parent_symbol").agg(F.count("*").alias("n"))


@query()
def impact(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "projects").select(F.col("id").alias("path"), F.concat(F.lit("pub struct Lock {\n}\nfn use_it() -> Lock::Guard {\n}\n// "), "name").alias("text"))
    return parsers.impact(parsers.symbols(rows), "Lock").groupBy("role", "risk").agg(F.count("*").alias("n"))
