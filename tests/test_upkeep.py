import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.vectors import cosine
from siltstone.operators import analytics, context, hybrid, records, retrieval, upkeep

AS_OF = "2025-06-30 00:00:00"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_what_is_unseen(spark):
    v = lambda *x: [float(i) for i in x]
    new = [
        ("a", "s", 1, "Rebuild the stale cache", v(1, 0)), ("b", "s", 2, "Pin the planner version", v(0, 1)), ("c", "s", 3, "Quite another matter", v(0.05, 1)),
        ("d", "t", 1, "Fresh words only here", v(0.02, 1)), ("e", "t", 2, "Nearest to a known vector", v(-1, 0)), ("f", "t", 3, "Without any vector", None), ("g", "t", 4, None, v(1, 1)),
    ]
    df = spark.createDataFrame(new, "id string, session_id string, pos int, title string, embedding array<double>")
    known = spark.createDataFrame([("rebuild the stale caches", v(0, -1)), ("unrelated", v(-1, 0.01))], "title string, embedding array<double>")
    # a: a known title is alike; c: like b before it in its session; d: another session; e: near a known vector.
    assert rows(upkeep.unseen(df, known), "id") == [("b",), ("d",), ("f",), ("g",)]
    assert upkeep.unseen(df.limit(0), known).count() == 0 and upkeep.unseen(df, known.limit(0)).count() == 6


def test_consolidation(spark):
    items = [(f"i{n}", f"t{n}", f"c{n % 2}", "p", None, n, [1.0, 0.01 * n]) for n in range(4)] + [("x", "t", "c", "p", None, 9, [0.0, 1.0]), ("y", "t", "c", None, "z", 9, [1.0, 0.0])]
    df = spark.createDataFrame(items, "id string, title string, content string, project_id string, superseded_by string, n int, embedding array<double>").withColumn("updated_at", F.timestamp_seconds("n"))
    edges = spark.createDataFrame([("i0", "x", "r", 0.5, 1), ("i1", "x", "r", 0.7, 2), ("i0", "i1", "r", 1.0, 1)], "source string, target string, relation string, weight double, usage_count bigint")
    merged, replaced, moved = upkeep.consolidate(df, edges)
    one = merged.first()
    assert merged.count() == 1 and (one.title, one.content, one.project_id) == ("t0", "c0\n\nc1", "p")
    assert rows(replaced, "old_id", "new_id") == [(f"i{n}", one.id) for n in range(4)]
    assert rows(moved, "source", "target", "weight", "usage_count") == [(one.id, "x", 0.7, 3)]


def test_promotion_makes_copies_and_edges(spark):
    df = spark.createDataFrame([("a", "Rebuild the cache", "1", "p"), ("b", "rebuild the cache", "2", "q"), ("c", "Other words", "3", "p")], "id string, title string, content string, project_id string")
    copies, edges = upkeep.promote(df)
    assert [(r.title, r.content, r.kind) for r in copies.collect()] == [("Rebuild the cache", "1", "pattern")]
    assert rows(edges, "target", "relation") == [("a", "derived_from"), ("b", "derived_from")]


def test_last_part_is_whole(spark):
    df = spark.createDataFrame([("é" * 10,), ("ab",), ("x" + "日" * 5,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(upkeep.last_part(F.col("t"), 7)).collect()] == ["ééé", "ab", "日日", None, ""]


def test_memories_sessions_and_groups(spark):
    m = spark.createDataFrame([("a", "x", 0.5, 1, 0), ("b", "y", 0.5, 1, 0)], "id string, value string, confidence double, confirmations bigint, contradictions bigint")
    change = spark.createDataFrame([("a", None, 0.9), ("zz", "q", 0.1)], "id string, value string, confidence double")
    assert rows(records.merge_memories(m, change), "id", "value", "confidence", "confirmations") == [("a", "x", 0.9, 2), ("b", "y", 0.5, 1)]
    assert rows(records.record_contradictions(m, change), "id", "contradictions") == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        records.inserted(m, m.select("value"), "procedure", AS_OF, most=1)
    twice = records.inserted(m, m.select("value").unionByName(m.select("value")), "procedure", AS_OF)
    assert twice.count() == 4 and twice.select("id").distinct().count() == 4
    s = spark.createDataFrame([("a", "done", None)], "id string, status string, created_at timestamp")
    assert rows(records.ensure_sessions(s, spark.createDataFrame([("a",), ("b",), (None,)], "id string"), AS_OF), "id", "status") == [("a", "done"), ("b", "active")]
    e = spark.createDataFrame([("1", "low", 1), ("2", None, 9), ("3", "critical", 1), ("4", "critical", 2)], "id string, severity string, created_at int")
    assert [r.id for r in records.by_severity(e).collect()] == ["4", "3", "1", "2"]


def test_queries_are_read_as_columns_are(spark):
    asked = ["why did the nightly-job fail", "how to deploy", "", "neden bozuldu", "What happened YESTERDAY to my_cache?"]
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", X.classify_query(F.col("q")).alias("t"), X.extract_cues(F.col("q")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(hybrid.query_type(q), hybrid.query_cues(q)) for q in asked]


def test_recent_results():
    now = [0.0]
    held = hybrid.Recent(60, 2, lambda: now[0])
    held.put("a", 1)
    held.put("b", 2)
    held.put("c", 3)
    assert held.get("a") is None and held.get("b") == 2
    now[0] = 61.0
    assert held.get("c") is None


def corpus(spark):
    rng = np.random.default_rng(2)
    ids = [("knowledge_item", f"k{i}") for i in range(12)] + [("episode", f"e{i}") for i in range(6)] + [("core_memory", "m0"), ("reflection", "r0")]
    told = [(t, i, f"nightly cache {i}", "because of a lease", "p" if n % 2 else None, ["nightly"], None, n, 0.0, "k0" if i == "k1" else None, None, f"2025-06-{n + 1:02} 00:00:00") for n, (t, i) in enumerate(ids)]
    schema = "entity_type string, entity_id string, title string, content string, project_id string, cues array<string>, last_accessed_at timestamp, access_count bigint, feedback_boost double, superseded_by string, valid_until timestamp, created string"
    entities = spark.createDataFrame(told, schema).withColumn("created_at", F.to_timestamp("created")).drop("created")
    vectors = spark.createDataFrame([(t, i, rng.normal(size=4).tolist()) for t, i in ids], "entity_type string, entity_id string, embedding array<double>")
    tokens = vectors.select("entity_type", "entity_id", F.array("embedding").alias("vectors"))
    edges = spark.createDataFrame([("knowledge_item:k0", "reflection:r0", 0.5)], "source string, target string, weight double")
    return hybrid.Corpus(entities, vectors, tokens, edges)


def test_hybrid_search(spark):
    c = corpus(spark)
    v = [1.0, 0.0, 0.0, 0.0]
    found = {k: [(r.entity_type, r.entity_id) for r in s.orderBy("rank").collect()] for k, s in hybrid.signals(c, "nightly because", v, [v], 4).items()}
    near = [(r.entity_type, r.entity_id) for r in c.vectors.orderBy(F.desc(cosine(F.col("embedding"), F.array(*map(F.lit, v))))).limit(12).collect()]
    assert found["dense"] == near == found["late"] and set(found) == {"fts", "dense", "late", "graph", "cue"}
    assert found["graph"] == [("reflection", "r0")] and [i for _, i in found["cue"]] == ["e5", "e4", "e3", "e2", "e1", "e0"]
    assert "cue" not in hybrid.signals(c, "nightly", v, [v], 4)

    def fails(_):
        raise RuntimeError

    out = hybrid.search(c, "nightly because", lambda _: (v, [v]), AS_OF, 20, hyde=fails)
    got = {r.entity_id: r.score for r in out.collect()}
    assert "k1" not in got and len(got) == 19 and all(a >= b for a, b in zip(list(got.values()), list(got.values())[1:]))
    mine = hybrid.search(c, "nightly because", lambda _: (v, [v]), AS_OF, 20, project="p")
    assert {r.project_id for r in mine.where("entity_type <> 'reflection'").collect()} == {"p"}
    assert hybrid.outside_project(out, "p").where("project_id is not null").count() == 0
    log = hybrid.search_log(out, "q", "causal", None, AS_OF)
    assert hybrid.latest_explanation(log, "q").first().result_ids[0] == next(iter(got)) and hybrid.latest_explanation(log, "z").count() == 0
    assert hybrid.search(hybrid.Corpus(c.entities.limit(0), c.vectors.limit(0), c.tokens.limit(0), c.edges), "nightly because", lambda _: (v, [v]), AS_OF).count() == 0


def test_contexts_and_guides(spark):
    lines = spark.createDataFrame([("p", "core_memories", "1", "x" * 50, "a"), ("p", "project_patterns", "1", "y" * 200, "b"), (None, "global_memories", "1", "z", "c"), ("q", "recent_sessions", "1", "w", "d")], "project_id string, section string, place string, line string, entity_id string")
    projects = spark.createDataFrame([("p",), ("empty",)], "id string")
    out = context.session_context(lines, projects, 140)
    assert rows(out, "project_id", "section") == [("empty", "global_memories"), ("p", "core_memories"), ("p", "global_memories")]
    assert out.where("section = 'global_memories' and project_id = 'p'").first().text == "\n=== GLOBAL MEMORIES ===\nz\n\n"
    body = spark.createDataFrame([("p", "Critical Rules", "rule"), ("p", "Key Procedures", "é" * 200), ("p", "Usage", "never"), ("q", "Usage", "")], "project_id string, heading string, body string")
    text = context.guide(body, "T", 200).first().text
    assert text.startswith("# T\n\n## Critical Rules\n\nrule\n\n## Key Procedures\n\né") and text.endswith("\n...\n") and "never" not in text and len(text.encode()) <= 200


def test_clean_up(spark):
    t = spark.createDataFrame([("a", 0.05, "2025-01-01"), ("b", 0.05, "2025-06-20"), ("c", 0.5, "2025-01-01"), ("d", None, None)], "id string, utility_score double, t string").withColumn("created_at", F.to_timestamp("t"))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "zz")], "source string, target string")
    kept, searches, edges = analytics.retention_run({"x": t}, t.select("id", "created_at"), e, AS_OF)
    assert rows(kept["x"], "id") == [("b",), ("c",), ("d",)] and rows(searches, "id") == [("b",), ("d",)] and rows(edges, "source", "target") == [("b", "c")]
    assert rows(analytics.prunable(t, AS_OF), "id") == [("a",)]


def test_json_is_written(spark):
    df = spark.createDataFrame([('{"a": "1", "k": "old"}',), (None,), ("broken",)], "j string")
    got = [r[0] for r in df.select(X.json_with(F.col("j"), "k", F.lit("new"))).collect()]
    assert got == ['{"a":"1","k":"new"}', '{"k":"new"}', '{"k":"new"}']


def test_known_vectors_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(i):
        made.add(1)
        return [float(i == k) for k in range(4)]

    new = spark.createDataFrame([(str(i), "s", i, c * 9, [float(i == k) for k in range(9)][:4] if i < 3 else [0.5] * 4) for i, c in enumerate("abcdefgh")], "id string, session_id string, pos int, title string, embedding array<double>")
    known = spark.createDataFrame([(i, c * 9) for i, c in enumerate("xyz")], "i int, title string").select("title", embed("i").alias("embedding"))
    assert rows(upkeep.unseen(new, known), "id") == [("3",)] and made.value == 3
