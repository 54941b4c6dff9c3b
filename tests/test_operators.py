import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, clustering, context, entities, fts, graph, lifecycle, retrieval
from siltstone.queries import QUERIES
from siltstone.queries.inputs import edges
from siltstone.sources import adhoc, html, parsers

EDGE = "source string, target string, relation string, weight double, usage_count bigint"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_exploration_keeps_the_first_path(spark):
    e = spark.createDataFrame([("a", "b", "r", 0.9, 1), ("a", "c", "r", 0.5, 1), ("b", "d", "r", 0.1, 1), ("c", "d", "r", 1.0, 1), ("d", "a", "r", 1.0, 1)], EDGE)
    got = {r.node: (r.depth, round(r.score, 3)) for r in graph.explore(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"b": (1, 0.9), "c": (1, 0.5), "d": (2, 0.09)}


def test_causal_chain_stops_at_a_ring(spark):
    e = spark.createDataFrame([("a", "b", "led_to", 0.5, 1), ("b", "a", "led_to", 0.9, 1), ("b", "c", "related", 1.0, 1), ("x", "b", "caused", 0.2, 1)], EDGE)
    starts = spark.createDataFrame([("a",), ("x",)], "node string")
    assert rows(graph.causal_chain(e, starts), "start", "hop", "node") == [("a", 1, "b"), ("x", 1, "b"), ("x", 2, "a")]


def test_causal_chain_takes_the_best_node_it_has_not_met(spark):
    named = ("led_to", "caused", "triggered", "caused_by", "resolved_by", "preceded_by")
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", r, 0.5, 1) for i, r in enumerate(named)] + [("n1", "n0", "caused", 0.9, 1), ("n2", "n9", "fixed_by", 1.0, 1)], EDGE)
    got = rows(graph.causal_chain(e, spark.createDataFrame([("n0",)], "node string"), 6), "hop", "node")
    assert got == [(i + 1, f"n{i + 1}") for i in range(6)]


def test_label_propagation(spark):
    tri = [("a", "b", "r", 1.0, 1), ("b", "c", "r", 1.0, 1), ("a", "c", "r", 1.0, 1), ("x", "y", "r", 1.0, 1)]
    got = {r.node: r.cluster for r in graph.label_propagation(spark.createDataFrame(tri, EDGE)).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["x"] == got["y"] == "x"
    assert graph.propagate([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)]) == {"a": 1, "b": 1, "c": 1}
    comp = {r.node: r.component for r in graph.components(spark.createDataFrame(tri + [("c", "d", "r", 0.1, 1)], EDGE)).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "r", 1.0, 1) for i in range(60)], EDGE)
    assert {r.component for r in graph.components(path).collect()} == {"n000"}


def test_edges_are_merged_and_moved(spark):
    e = spark.createDataFrame([("a", "b", "r", 1.0, 1), ("c", "b", "r", 0.5, 2), ("a", "c", "r", 0.04, 1)], EDGE)
    assert rows(entities.upsert_edges(e, e.limit(1)), "source", "target", "usage_count")[0] == ("a", "b", 2)
    assert rows(graph.edge_decay(e), "source", "target", "weight") == [("a", "b", 0.95), ("c", "b", 0.475)]
    moved = graph.transfer_edges(e, spark.createDataFrame([("a", "c")], "old_id string, new_id string"))
    assert rows(moved, "source", "target", "weight", "usage_count") == [("c", "b", 1.0, 3)]


def test_latest_rows_of_equal_times(spark):
    df = spark.createDataFrame([("p", "f", 1, "a"), ("p", "f", 2, "b"), ("p", "f", 2, "d"), ("p", "f", 2, "c"), ("p", "g", 1, "e")], "project_id string, file_path string, t int, id string")
    for old in ("id < 'c'", "id > 'c'"):
        got = entities.upsert_latest(df.where(old), df.where(f"not {old}"), ["project_id", "file_path"], "t", "id")
        assert rows(got, "file_path", "id") == [("f", "d"), ("g", "e")]


def test_latest_rows_of_all_keys(spark):
    keyed = spark.read.parquet("/root/testdata/sf0.01/git_activity.parquet").where("file_path is not null and project_id is not null and created_at is not null")
    got = QUERIES["upsert_latest"](spark, "/root/testdata/sf0.01")
    assert got.count() == keyed.select("project_id", "file_path").distinct().count()


def test_memories(spark):
    state = spark.createDataFrame([("c", "k", None, "old", 1)], "category string, key string, project_id string, value string, confirmations bigint")
    new = spark.createDataFrame([("c", "k", None, "new", 1), ("c", "k", "p", "other", 2)], "category string, key string, project_id string, value string, seq bigint")
    got = {r.project_id: (r.value, r.confirmations) for r in entities.upsert_memories(state, new).collect()}
    assert got == {None: ("new", 2), "p": ("other", 1)}


def test_click_on_what_was_not_shown_changes_nothing(spark):
    s = spark.createDataFrame([(1, ["a", "b"], []), (2, ["a"], ["a"])], "id bigint, result_ids array<string>, clicked_ids array<string>").withColumn("created_at", F.col("id"))
    got = {r.id: r.clicked_ids for r in entities.click(s, spark.createDataFrame([("a",), ("zz",)], "entity string")).collect()}
    assert got == {1: ["a"], 2: ["a"]}


def test_web_queries(spark):
    q = fts.parse('stale "nightly job" OR cache -cursor')
    assert q.groups == ((("stale",),), (("nightly", "job"), ("cache",))) and q.excluded == (("cursor",),)
    df = spark.createDataFrame([(1, "stale nightly job"), (2, "stale cache cursor"), (3, "nightly job"), (4, "Stale CACHE"), (5, None)], "id bigint, t string")
    assert [r.id for r in fts.search(df, "id", {"A": "t"}, 'stale "nightly job" OR cache -cursor').orderBy("id").collect()] == [1, 4]
    assert fts.search(df, "id", {"A": "t"}, "").count() == 0


def test_an_index_finds_what_a_scan_finds(spark):
    words = ["stale", "nightly", "job", "cache", "cursor"]
    texts = [" ".join(words[(i * k) % 5] for k in range(1, 1 + i % 6)) for i in range(40)]
    df = spark.createDataFrame([(i, t, texts[-i - 1]) for i, t in enumerate(texts)] + [(99, None, "Stale CACHE")], "id bigint, t string, c string")
    indexed = fts.index(df, "id", {"A": "t", "B": "c"})
    for q in ("stale cache", 'nightly OR "job cache"', "stale -cursor", "missing", ""):
        want = {r.id: round(r.score, 9) for r in fts.search(df, "id", {"A": "t", "B": "c"}, q, None).collect()}
        assert {r.id: round(r.score, 9) for r in fts.search_index(indexed, "id", q, None).collect()} == want, q


def test_pairs_of_a_large_group(spark, monkeypatch):
    from siltstone.operators import analytics

    df = spark.createDataFrame([(g, f"i{k:02}") for g in ("a", "b") for k in range(30)] + [("c", "i00"), (None, "i01"), ("c", None)], "g string, i string")
    want = {(r.item_a, r.item_b): (r.together, r.ratio) for r in analytics.coupled_items(df, "i", "g", 2).collect()}
    monkeypatch.setattr(analytics, "GROUP_BLOCK", 4)
    assert {(r.item_a, r.item_b): (r.together, r.ratio) for r in analytics.coupled_items(df, "i", "g", 2).collect()} == want and len(want) == 435


def test_postings_of_all_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id for r in QUERIES["postings"](spark, "/root/testdata/sf0.001").select("doc_id").distinct().collect()}
    assert got == {r.doc_id for r in docs.where("text rlike '[\\\\p{L}\\\\p{N}_]'").collect()}
    assert got & {r.doc_id for r in docs.where("lang = 'tr'").collect()} and got & {r.doc_id for r in docs.where("lang is null").collect()}


def test_fusion(spark):
    sig = lambda *ids: spark.createDataFrame([("k", i, n) for n, i in enumerate(ids)], "entity_type string, entity_id string, rank int")
    got = {r.entity_id: r.score for r in retrieval.fuse({"x": sig("a", "b"), "y": sig("b"), "z": sig("c")}, {"x": 1.0, "z": 0.0}).collect()}
    assert abs(got["a"] - 1 / 61) < 1e-12 and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12 and got["c"] == 0.0


def test_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])], "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in retrieval.knn(df.where("vec_id % 50 = 0"), df, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        sims = u @ u[q]
        want = [i for i in np.argsort(-sims) if i != q][:5]
        assert [got[q][k] for k in range(5)] == want


def test_late_interaction_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 4, 8))
    extra = [(900, None), (901, []), (902, [[1.0, 2.0]]), (903, [m[0, 0].tolist(), [1.0], None])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + extra, "id bigint, vectors array<array<double>>").repartition(5)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    got = {}
    for r in retrieval.late_interaction(df.where("id < 900 and id % 10 = 0"), df, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 6))
    u = m / np.linalg.norm(m, axis=2, keepdims=True)
    cos = {i: v for i, v in enumerate(u)} | {903: u[:1, 0]}
    for q in range(0, 120, 10):
        sims = {i: (u[q] @ v.T).max(axis=1) for i, v in cos.items()}
        scores = {i: float((x.clip(0) if i == 903 else x).sum()) for i, x in sims.items()} | {902: 0.0}
        want = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:5]
        assert [got[q][n] for n in range(5)] == [(i, round(scores[i], 6)) for i in want]


def test_rerank_of_equal_results_is_flat(spark):
    df = spark.createDataFrame([("a", 1.0, "x y"), ("b", 1.0, "x y")], "entity_id string, score double, content string")
    assert [r.final for r in retrieval.rerank(df, "content", retrieval.token_overlap("x")).collect()] == [0.0, 0.0]


def test_greedy_clusters(spark):
    assert clustering.fold_clusters(np.array([[1.0, 0], [0.99, 0.1], [0, 1.0]]), 0.82) == [0, 0, 1]
    df = spark.createDataFrame([(1, i, [1.0, 0.01 * i]) for i in range(4)] + [(1, 9, [0.0, 1.0]), (2, 20, None)], "label int, vec_id bigint, embedding array<double>")
    assert rows(clustering.greedy_clusters(df, "label", ["vec_id"]), "vec_id", "cluster") == [(i, 0) for i in range(4)]


def test_kmeans_tells_groups_apart(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10, i / 100]) for i in range(40)], "vec_id bigint, embedding array<double>")
    got = clustering.best_kmeans(df, most=3).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [20, 20]


def test_markdown_chunks():
    code = "```py\n" + "x = 1\n" * 2000 + "```"
    text = "# A\n\n" + "word " * 6000 + "\n\n" + code + "\n\n- a\n  b\n\n- c\n"
    out = chunking.chunk_markdown(text)
    assert len(out) > 1 and any(code in c for c in out) and all(out[i][-800:] in out[i + 1] for i in range(len(out) - 1))
    assert chunking.chunk_markdown("") == [] and chunking.chunk_markdown("short") == ["short"]
    assert [k for k, _ in chunking.blocks("# h\ntext\nmore\n\n- a\n  b\n\n- c\n```\nx\n")] == ["header", "paragraph", "list", "code"]
    assert "é" * 50_000 in "".join(chunking.hard_split("é" * 50_000))


def test_transcript_chunks():
    text = "".join(f"[USER]: {i} " + "word " * 900 for i in range(40))
    out = chunking.chunk_transcript(text)
    assert len(out) > 3 and all(chunking.tokens(c) <= 8000 + 250 for c in out) and out[0].startswith("[USER]: 0")


def test_sections_that_do_not_fit_are_skipped(spark):
    df = spark.createDataFrame([("c", 1, "a", 60), ("c", 2, "b", 50), ("c", 3, "d", 40), ("c", 4, "e", 10)], "ctx string, priority int, section string, bytes bigint")
    assert rows(context.pack_sections(df, "ctx", 100), "section", "used") == [("a", 60), ("d", 40)]
    assert rows(context.pack_sections(df, "ctx", 100, partial=True), "section", "used") == [("a", 60), ("b", 40)]


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", i) for i in range(6)] + [("k", 100)], "k string, t bigint").select("k", F.timestamp_seconds("t").alias("ts"))
    assert [r.allowed for r in lifecycle.token_bucket(df, "k", "ts", 3, 60.0).orderBy("ts").collect()] == [True, True, True, False, False, False, True]


def test_git_log_and_name_status(spark):
    text = "\x1eabc\x1fAnn\x1f1700000000\x1ffix: it\nM\tsrc/a.rs\nR100\told.rs\tnew.rs\n\x1edef\x1fBob\x1f1700000100\x1fchore\n"
    got = rows(parsers.git_log(spark.createDataFrame([(text,)], "text string")), "commit_hash", "change_type", "file_path")
    assert got == [("abc", "modify", "src/a.rs"), ("abc", "rename", "new.rs")]


def test_transcripts_and_tools(spark):
    lines = ['{"type":"user","message":{"role":"user","content":"hi"}}', '{"type":"tool","content":"x"}', '{"role":"assistant","content":"yo"}', "not json"]
    assert [r.line for r in parsers.transcript_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == ["[USER]: hi", "[ASSISTANT]: yo"]
    t = '[TOOL: read]\nout\ntool_call: edit now\n{"type":"tool_use","name": "run"}\nTool: test'
    assert [r.tool for r in parsers.tool_calls(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("pos").collect()] == ["read", "edit", "run", "test"]


def test_symbols(spark):
    src = "pub struct Foo {\n  a: Bar::X,\n}\nimpl Foo {\n    pub async fn go(&self) -> Baz::T {\n    }\n}\nfn free() {}\nconst N: usize = 1;\n"
    got = parsers.rust_symbols(src)
    assert [(g[0], g[1], g[3], g[4], g[5]) for g in got] == [("Foo", "struct", 1, "public", None), ("Foo", "impl", 4, "private", None), ("go", "function", 5, "public", "Foo"), ("free", "function", 8, "private", None), ("N", "const", 9, "private", None)]
    more = "#[derive(X)]\n// fn no() {}\npub(crate) static S: u8 = 1;\nimpl<T: A> Show for Wide<T> {\n    const K: u8 = 2;\n}\ntype Alias = Foo;\npub trait Can: Sized {\n}\nmod inner;\nconst _: () = ();\n"
    assert [(g[0], g[1], g[4], g[5]) for g in parsers.rust_symbols(more)] == [("S", "const", "crate", None), ("Wide", "impl", "private", None), ("K", "const", "private", "Wide"), ("Alias", "type_alias", "private", None), ("Can", "trait", "public", None)]
    df = parsers.symbols(spark.createDataFrame([("a.rs", src), ("b.rs", None)], "path string, text string"))
    assert rows(parsers.impact(df, "go"), "role", "risk") == [("definition", "low")] and rows(parsers.impact(df, "Baz"), "role", "symbol_name", "risk") == [("caller", "go", "medium")]


def test_html():
    page = "<html><head><title> A &amp; B </title></head><body><nav>no</nav><main><h2>Hi</h2><p>Some <b>bold</b> and <a href='/x'>link</a></p><pre><code class='language-py'>x = 1\n</code></pre><ul><li>a</li></ul><script>no</script></main></body></html>"
    md = html.markdown(page)
    assert html.title(page) == "A & B" and "## Hi" in md and "Some **bold** and [link](/x)" in md and "```py\nx = 1" in md and "- a" in md and "no" not in md.split()
    assert html.markdown("<p>a <b> x </b><em>y </em> <a>bare</a> <a href='/z'></a><img alt='q'></p><svg><text>no</text></svg><iframe>kept</iframe>") == "a **x***y* bare ![q]()\n\nkept"
    assert html.markdown("<ul><li>a<li>b</ul><p>one<p>two") == "- a\n- b\n\none\n\ntwo" and html.markdown("") == "" and html.title("") == ""
    assert html.markdown("<div>" * 5000 + "deep") == "deep"
    assert html.title("<body><h1>Main</h1></body>") == "Main" and html.title("<p>first</p>") == "first" and html.strip_tags("<p>Hello <b>world</b></p>") == "Hello world"
    assert html.decode_entities("&amp; it&#39;s") == "& it's"


@pytest.mark.parametrize("sql", ["DROP TABLE x", "select 1; select 2", "with a as (select 1) delete from a", "update x set y = 1", ""])
def test_guard_refuses(sql):
    with pytest.raises(ValueError):
        adhoc.guarded(sql)


def test_guard_limits():
    assert adhoc.guarded("select 'drop' as x") == "select 'drop' as x LIMIT 100"
    assert adhoc.guarded("SELECT 1 LIMIT 7;") == "SELECT 1 LIMIT 7" and adhoc.guarded("select 1", 9999).endswith("LIMIT 500")


def test_queue(spark):
    q = spark.createDataFrame([("1", "s", "pending", 0), ("2", "s", "done", 0), ("3", "t", "pending", 2)], "id string, session_id string, status string, retry_count int")
    again = spark.createDataFrame([("4", "s")], "id string, session_id string")
    assert rows(lifecycle.enqueue(q, again), "id", "status") == [("1", "cancelled"), ("2", "done"), ("3", "pending"), ("4", "pending")]
    assert rows(lifecycle.retried(q, q.where("id = '3'")), "id", "status") == [("1", "pending"), ("2", "done"), ("3", "failed_permanent")]


def test_queue_items_with_repeated_rows(spark):
    q = spark.createDataFrame([("1", "processing", 0), ("1", "completed", 0), ("2", "pending", 1), ("2", "cancelled", 0), ("3", "other", 0), ("3", "pending", 0)], "id string, status string, retry_count int")
    assert rows(lifecycle.one_state(q), "id", "retry_count", "status") == [("1", 0, "completed"), ("2", 1, "pending"), ("3", 0, "pending")]
    ids = spark.read.parquet("/root/testdata/sf0.01/learning_queue.parquet").select("id").distinct().count()
    assert QUERIES["retry_queue"](spark, "/root/testdata/sf0.01").count() == ids


def test_graph_queries_take_all_edges(spark):
    d = "/root/testdata/sf0.001"
    found = [(r.source, r.target, r.weight) for r in edges(spark, d).collect() if r.source != r.target]
    want = graph.propagate(sorted(found))
    got = {r.node: r.cluster for r in QUERIES["label_propagation"](spark, d).collect()}
    assert got.keys() == want.keys() and len(set(got.values())) == len(set(want.values()))
    assert QUERIES["edge_clusters"](spark, d).agg(F.sum("size")).first()[0] == len(want)
    assert QUERIES["cluster_groups"](spark, d).agg(F.sum("size")).first()[0] == len(want)
    parent = {n: n for n in want}
    for a, b, _ in found * 3:
        low = min(parent[a], parent[b])
        parent = {n: low if p in (parent[a], parent[b]) else p for n, p in parent.items()} if parent[a] != parent[b] else parent
    assert {r.node: r.component for r in QUERIES["graph_components"](spark, d).collect() if r.node in parent} == parent
