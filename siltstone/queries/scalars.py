"""Queries of scalar functions over texts, scores and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scores as S
from siltstone.functions import text as X
from siltstone.functions import vectors as V
from siltstone.queries.inputs import AS_OF
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


def _signs(text: str, signs) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in signs) + ")"


def _case(text: str, groups: dict) -> str:
    return "CASE " + " ".join(f"WHEN {_signs(text, signs)} THEN '{name}'" for name, signs in groups.items()) + " ELSE 'semantic' END"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("""
SELECT id, CASE WHEN times_used > 0 THEN round(greatest(0.0::DOUBLE, (p + 1.9208::DOUBLE / n - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n)), 6) END AS wilson
FROM (SELECT *, times_used::DOUBLE AS n, greatest(0.0::DOUBLE, least(times_success::DOUBLE, times_used::DOUBLE)) / nullif(times_used, 0)::DOUBLE AS p FROM procedures)""")
def wilson_rank(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "procedures").select("id", F.round(S.wilson_lower(F.col("times_success"), F.col("times_used")), 6).alias("wilson"))


_DAYS = "(epoch_us(TIMESTAMPTZ '2025-06-30 00:00:00+00') - epoch_us({})) / 86400000000.0::DOUBLE"


@query(f"""
SELECT id, round(utility_score * exp(-0.693::DOUBLE / 30 * coalesce({_DAYS.format('last_accessed_at')}, 30.0)) * (1 + 0.1::DOUBLE * ln(1 + access_count::DOUBLE)) + 0.1::DOUBLE * coalesce(feedback_boost::DOUBLE, 0), 6) AS score FROM knowledge_items""")
def decay_and_boost(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "knowledge_items").select("id", F.round(S.decay_and_boost(c("utility_score"), c("last_accessed_at"), c("access_count"), c("feedback_boost"), F.lit(AS_OF).cast("timestamp")), 6).alias("score"))


@query(f"""SELECT id, round(utility_score * exp(-0.693::DOUBLE / 30 * coalesce({_DAYS.format('last_accessed_at')}, 30.0)) * (1 + 0.1::DOUBLE * ln(1 + access_count::DOUBLE)), 6) AS score FROM knowledge_items""")
def search_decay(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "knowledge_items").select("id", F.round(S.search_decay(c("utility_score"), c("last_accessed_at"), c("access_count"), F.lit(AS_OF).cast("timestamp")), 6).alias("score"))


@query(f"""SELECT id, round(utility_score * exp(-0.693::DOUBLE / 23 * {_DAYS.format('updated_at')}) * greatest(ln(1 + times_used::DOUBLE), 0.1::DOUBLE) * least(1 + {_DAYS.format('created_at')} / 30, 2.0::DOUBLE), 6) AS relevance FROM knowledge_items""")
def edge_relevance(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "knowledge_items").select("id", F.round(S.edge_relevance(c("utility_score"), c("updated_at"), c("times_used"), c("created_at"), F.lit(AS_OF).cast("timestamp")), 6).alias("relevance"))


@query("""
WITH r AS (SELECT id, (id_no % 6)::INT AS q, sr_easiness::DOUBLE AS e, sr_repetitions AS r, sr_interval_days AS i FROM (SELECT *, length(content) AS id_no FROM knowledge_items)),
g AS (SELECT *, CASE WHEN q < 3 THEN e ELSE greatest(e + (0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)), 1.3::DOUBLE) END AS e2 FROM r)
SELECT id, round(e2, 5) AS easiness, CASE WHEN q < 3 THEN 0 ELSE r + 1 END AS repetitions, CASE WHEN q < 3 OR r = 0 THEN 1 WHEN r = 1 THEN 6 ELSE round(i * e2)::INT END AS "interval" FROM g""")
def sm2_review(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items")
    q, e, r, i = (F.length("content") % 6), F.col("sr_easiness").cast("double"), F.col("sr_repetitions"), F.col("sr_interval_days")
    return k.select("id", F.round(S.sm2_easiness(q, e), 5).alias("easiness"), S.sm2_repetitions(q, r).alias("repetitions"), S.sm2_interval(q, e, r, i).alias("interval"))


@query("SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH p AS (SELECT doc_id, round(ceil(length(text) / 4.0) * 100.0::DOUBLE / 1000)::BIGINT AS percent FROM documents WHERE text IS NOT NULL)
SELECT doc_id, percent, CASE WHEN percent < 25 THEN 'none' WHEN percent < 50 THEN 'low' WHEN percent < 75 THEN 'medium' WHEN percent < 90 THEN 'high' ELSE 'critical' END AS band FROM p""")
def context_budget(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select("doc_id", S.budget_used(F.length("text"), 1000).alias("percent"))
    return rows.select("doc_id", "percent", S.budget_band(F.col("percent")).alias("band"))


@query("SELECT id, " + _case("lower(title)", X.QUERY_SIGNS) + " AS query_type FROM knowledge_items")
def classify_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").select("id", X.classify_query(F.col("title")).alias("query_type"))


def _domain_sql() -> str:
    names = list(X.DOMAIN_WORDS)
    scores = ", ".join("(" + " + ".join(f"contains(t, '{w}')::INT" for w in X.DOMAIN_WORDS[n]) + f") AS {n}" for n in names)
    best = "greatest(" + ", ".join(names) + ")"
    pick = " ".join(f"WHEN {n} = {best} THEN '{n}'" for n in reversed(names))
    return f"WITH s AS (SELECT doc_id, {scores} FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CASE WHEN {best} < 3 THEN 'general' {pick} END AS domain FROM s"


@query(_domain_sql())
def detect_domain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", X.detect_domain(F.col("text")).alias("domain"))


@query("SELECT id, CASE WHEN starts_with(lower(commit_message), 'fix') OR starts_with(lower(commit_message), 'feat') OR starts_with(lower(commit_message), 'refactor') OR contains(lower(commit_message), 'bug') OR contains(lower(commit_message), 'critical') THEN 'medium' ELSE 'low' END AS severity FROM git_activity")
def classify_severity(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "git_activity").select("id", X.classify_severity(F.col("commit_message")).alias("severity"))


@query(f"SELECT id, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: strlen(w) >= 3 AND NOT list_contains({_list(X.STOP_WORDS)}, w)) AS cues FROM knowledge_items")
def extract_cues(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").select("id", X.extract_cues(F.col("title")).alias("cues"))


@query(f"WITH p AS (SELECT id, list_filter(string_split_regex(file_path, '[/\\\\.\\-_]'), lambda w: strlen(w) > 2 AND NOT list_contains({_list(X.PATH_SKIP)}, w)) AS p FROM git_activity) SELECT id, CASE WHEN len(p) > 0 THEN array_to_string(p[1:4], ' ') END AS keywords FROM p")
def keywords_path(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "git_activity").select("id", X.keywords_path(F.col("file_path")).alias("keywords"))


@query(f"WITH p AS (SELECT id, list_filter(string_split_regex(commit_message, '\\s+'), lambda w: strlen(w) > 2 AND NOT list_contains({_list(X.SHELL_SKIP)}, w) AND NOT starts_with(w, '-')) AS p FROM git_activity) SELECT id, CASE WHEN len(p) > 0 THEN array_to_string(p[1:3], ' ') END AS keywords FROM p")
def keywords_shell(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "git_activity").select("id", X.keywords_shell(F.col("commit_message")).alias("keywords"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT id, {_TRI.format('title')} AS a, {_TRI.format("'How to rebuild the stale cache'")} AS b FROM knowledge_items)
SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM g""")
def trigram_similarity(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").select("id", F.round(X.trigram_similarity(F.col("title"), F.lit("How to rebuild the stale cache")), 6).alias("similarity"))


@query(f"""WITH g AS (SELECT id, title, {_TRI.format('title')} AS a, {_TRI.format("'Why the cached planner needs a lock'")} AS b FROM procedures),
s AS (SELECT id, title, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS similarity FROM g)
SELECT id, title, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.2 ORDER BY s.similarity DESC, id LIMIT 5""")
def similar_titles(s: SparkSession, d: str) -> DataFrame:
    from siltstone.operators.entities import similar_titles as find

    return find(table(s, d, "procedures"), "Why the cached planner needs a lock", 0.2).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r', '', 'g'), '[ \t]+', ' ', 'g'), '\n ', '\n', 'g'), '\n{3,}', '\n\n', 'g') AS clean FROM documents""")
def cleanup_whitespace(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.cleanup_whitespace(F.col("text")).alias("clean"))


@query("SELECT doc_id, len(list_filter(string_split(text, '\n\n'), lambda x: trim(x) <> ''))::INT AS sections FROM documents")
def split_sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(X.split_sections(F.col("text"))).alias("sections"))


@query("SELECT id, strlen(trim(content)) >= 50 AND strlen(trim(title)) >= 5 AND trim(title) <> trim(content) AS passes FROM knowledge_items")
def quality_gate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "knowledge_items").select("id", X.passes_gate(F.col("title"), F.col("content")).alias("passes"))


@query("SELECT id, strlen(trim(content)) >= 50 AND strlen(trim(title)) >= 5 AND trim(title) <> trim(content) AND len(steps) >= 2 AS passes FROM procedures")
def procedure_gate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "procedures").select("id", X.passes_procedure_gate(F.col("title"), F.col("content"), F.col("steps")).alias("passes"))


@query("SELECT id, left(content, 150) AS snippet FROM procedures")
def snippets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "procedures").select("id", X.snippet(F.col("content")).alias("snippet"))


@query()
def truncated_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.truncate_bytes(F.col("text"), 100).alias("cut"), X.truncate_word(F.col("text"), 100).alias("words"))


@query()
def headlines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(F.lower("text").contains("nightly")).select("doc_id", X.headline(F.col("text"), ["nightly", "job"]).alias("headline"))


@query("""WITH f AS (SELECT project_id, list(DISTINCT file_path) AS files FROM (SELECT project_id, file_path FROM git_activity WHERE file_path IS NOT NULL UNION ALL
    SELECT project_id, (['package.json', 'next.config.ts', 'prisma/schema.prisma', 'Cargo.toml', 'docker-compose.yml', 'Dockerfile', 'flake.nix', 'pyproject.toml', 'go.mod', 'tsconfig.json', 'web/package.json', 'pom.xml', 'Gemfile'])[length(commit_message) % 13 + 1] FROM git_activity) WHERE project_id IS NOT NULL GROUP BY 1)
SELECT project_id, list_filter([CASE WHEN list_contains(files, 'package.json') THEN 'node.js' END, CASE WHEN list_has_any(files, ['next.config.js', 'next.config.ts', 'next.config.mjs']) THEN 'next.js' END, CASE WHEN list_contains(files, 'prisma/schema.prisma') THEN 'prisma' END,
  CASE WHEN list_contains(files, 'Cargo.toml') THEN 'rust' END, CASE WHEN list_has_any(files, ['docker-compose.yml', 'docker-compose.yaml', 'Dockerfile']) THEN 'docker' END, CASE WHEN list_contains(files, 'flake.nix') THEN 'nixos' END,
  CASE WHEN list_has_any(files, ['requirements.txt', 'pyproject.toml']) THEN 'python' END, CASE WHEN list_contains(files, 'go.mod') THEN 'go' END, CASE WHEN list_contains(files, 'tsconfig.json') THEN 'typescript' END], lambda x: x IS NOT NULL) AS stack FROM f""")
def tech_stack(s: SparkSession, d: str) -> DataFrame:
    """The files of each project's commits, and a file for each commit by the length of its message."""
    made = ("package.json", "next.config.ts", "prisma/schema.prisma", "Cargo.toml", "docker-compose.yml", "Dockerfile", "flake.nix", "pyproject.toml", "go.mod", "tsconfig.json", "web/package.json", "pom.xml", "Gemfile")
    g = table(s, d, "git_activity").where("project_id is not null")
    files = g.select("project_id", "file_path").where("file_path is not null").unionByName(g.select("project_id", F.element_at(F.array(*map(F.lit, made)), F.length("commit_message") % 13 + 1).alias("file_path")))
    marked = files.where(X.tech_stack(F.col("file_path")).isNotNull()).groupBy("project_id").agg(F.collect_set("file_path").alias("files"))
    return g.select("project_id").distinct().join(marked, "project_id", "left").select("project_id", X.tech_stacks(F.coalesce("files", F.array())).alias("stack"))


@query("""WITH w AS (SELECT id, content, list_filter(string_split_regex(content, '[^\\p{L}\\p{N}_-]+'), lambda w: strlen(w) >= 3 AND NOT list_contains(
  ['the', 'and', 'for', 'not', 'was', 'error', 'with', 'from', 'that', 'this', 'can', 'cannot', 'could', 'did', 'does', 'find', 'found', 'module', 'file', 'such', 'failed', 'fatal', 'missing'], lower(w))) AS w FROM session_messages)
SELECT id, CASE WHEN regexp_matches(lower(content), 'error|panic|failed|exception|fatal|cannot find|not found|no such file|denied') AND len(w) > 0 THEN array_to_string(w[1:4], ' OR ') END AS keywords FROM w""")
def error_keywords(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "session_messages").select("id", X.error_keywords(F.col("content")).alias("keywords"))


@query("""WITH u AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'http://10.0.' || (event_id % 300) || '.7/x' WHEN 1 THEN 'https://host-' || user_id || '.internal:8080/' WHEN 2 THEN 'https://example.com/' || user_id WHEN 3 THEN 'http://172.' || (event_id % 40) || '.1.9:80' ELSE 'http://localhost/a' END AS url FROM events),
h AS (SELECT event_id, regexp_extract(url, '^(?:https?://)*([^/:]*)', 1) AS host FROM u),
o AS (SELECT event_id, host, list_transform(string_split(host, '.'), lambda p: try_cast(p AS INT)) AS p FROM h)
SELECT event_id, host = 'localhost' OR host LIKE '%.internal' OR (len(p) = 4 AND NOT list_contains(list_transform(p, lambda x: x IS NULL OR x > 255 OR x < 0), true) AND (p[1] = 10 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31))) AS private FROM o""")
def private_urls(s: SparkSession, d: str) -> DataFrame:
    e, n = table(s, d, "events"), F.col("event_id")
    t = lambda c: c.cast("string")
    url = F.when(n % 5 == 0, F.concat(F.lit("http://10.0."), t(n % 300), F.lit(".7/x"))).when(n % 5 == 1, F.concat(F.lit("https://host-"), t(F.col("user_id")), F.lit(".internal:8080/")))
    url = url.when(n % 5 == 2, F.concat(F.lit("https://example.com/"), t(F.col("user_id")))).when(n % 5 == 3, F.concat(F.lit("http://172."), t(n % 40), F.lit(".1.9:80"))).otherwise("http://localhost/a")
    return e.select("event_id", X.is_private_url(url).alias("private"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 4) AS distance FROM embeddings, q""")
def vector_measures(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    one = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))
    return e.join(one).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"), F.round(V.distance(F.col("embedding"), F.col("q")), 4).alias("distance"))


@query("""WITH v AS (SELECT id, min(utility_score) OVER () AS lo, max(utility_score) OVER () AS hi, utility_score AS u FROM knowledge_items) SELECT id, round((u - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 6) AS scaled FROM v""")
def minmax_scaled(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "knowledge_items")
    ends = F.broadcast(k.agg(F.min("utility_score").alias("lo"), F.max("utility_score").alias("hi")))
    return k.join(ends).select("id", F.round(S.minmax(F.col("utility_score"), F.col("lo"), F.col("hi")), 6).alias("scaled"))
