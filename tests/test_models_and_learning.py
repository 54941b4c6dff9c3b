import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import learning, models, tree
from siltstone.plans.folding import ordered_fold
from siltstone.queries import QUERIES
from siltstone.sources import ingest


def test_circuit_breaker():
    now = [0.0]
    b = models.CircuitBreaker(2, 60.0, lambda: now[0])
    b.failed()
    assert b.allows()
    b.failed()
    assert not b.allows()
    now[0] = 61.0
    assert b.allows() and not b.allows()
    b.failed()
    assert not b.allows()
    now[0] = 200.0
    assert b.allows()
    b.succeeded()
    assert b.allows() and b.allows()


def test_stand_ins():
    e = models.hashing_embedder(16)(["a b", "a b", "", "c"])
    assert np.allclose(e[0], e[1]) and not e[2].any() and abs(np.linalg.norm(e[3]) - 1) < 1e-9
    assert len(models.token_matrix("one two")) == 2 and models.token_matrix("") == []
    assert models.parsed_json('x ```json\n{"a": [1]}\n```') == {"a": [1]} and models.parsed_json("no") is None
    assert models.flexible_strings(["a", 1, None, ["b", {"c": 2}]]) == ["a", "1", "b", '{"c": 2}']
    assert models.clamped_scores({"a": 2, "b": -1}) == {"a": 1.0, "b": 0.0}
    assert models.expanded_queries("q", lambda q: ["x", " ", "y", "z", "w"]) == ["q", "x", "y", "z"]


def test_learning(spark):
    lost = "We lost 9 minutes to a stale lease in the remote planner of the service."
    text = f"[USER]: {lost}\n[ASSISTANT]: {lost}\nThe nightly job failed again in the staging run of the mirrored queue."
    df = spark.createDataFrame([("s", text), ("empty", ""), ("none", None)], "session_id string, transcript string")
    records, edges, runs = learning.learn(df)
    got = [(r.kind, r.content) for r in records.orderBy("pos").collect()]
    assert [k for k, _ in got].count("episodes") == 3 and {r.session_id for r in records.collect()} == {"s"}
    assert edges.where("relation = 'led_to'").count() == 2 and edges.where("relation = 'produced_by'").count() == len(got)
    assert runs.first().duplicates_skipped == 0
    assert learning.learn(df.limit(0))[0].count() == 0


def test_caps_and_duplicates(spark):
    rows = [("s", "episodes", i, f"Episode number {i % 3} of a run that failed and was then repaired by hand.") for i in range(12)] + [("s", "other", 99, "x" * 60), ("s", "memories", 100, "short")]
    df = spark.createDataFrame(rows, "k string, kind string, pos int, content string")
    assert learning.capped(df, "k").count() == 8 + 1
    assert [r.pos for r in learning.deduplicated(df.where("kind = 'episodes'"), "k").orderBy("pos").collect()] == [0, 1, 2]
    assert learning.gated(df).where("kind = 'memories'").count() == 0


def test_contradictions_are_those_of_brute_force(spark):
    words = ["nightly", "cache", "planner", "lease", "stale", "index", "remote", "rebuild"]
    rng = np.random.default_rng(5)
    rows = [(f"{i:03}", " ".join(rng.choice(words, 3 + i % 3))) for i in range(90)] + [("x1", "rollbacks of migrations"), ("x2", "rollback of migration"), ("x3", "Cache"), ("x4", None), ("x5", "--")]
    df = spark.createDataFrame(rows, "id string, title string")
    new, known = df.where("id in ('x1', 'x3') or id rlike '^[0-9]+[0369]$'"), df.where("id <> 'x1' and id not rlike '[39]$' or id = 'x3'")

    def grams(t):
        return {w[i : i + 3] for x in (t or "").lower().replace("-", " ").split() for w in [f"  {x} "] for i in range(len(w) - 2)}

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    want = set()
    for n in new.collect():
        found = sorted((-alike(grams(n.title), grams(k.title)), k.id) for k in known.collect() if k.id != n.id)
        if found and -found[0][0] > 0.4:
            want.add((found[0][1], n.id))
    got = {(r.old_id, r.new_id) for r in learning.contradictions(new, known, lambda p: p.withColumn("confidence", F.lit(1.0))).collect()}
    assert got == want and ("x2", "x1") in got


def test_tree(spark):
    schema = "entity_type string, entity_id bigint, title string, embedding array<double>"
    few = spark.createDataFrame([("k", i, f"t{i}", [float(i), 1.0]) for i in range(4)], schema)
    assert {r.parent_id for r in tree.build(few, "t").collect()} == {None}
    many = spark.createDataFrame([("k", i, f"t{i:02}", [10.0 * (i % 2), i / 100]) for i in range(30)], schema)
    nodes = tree.build(many, "t", 3)
    assert nodes.where("level = 1").agg(F.sum("children_count")).first()[0] == 30
    parent = nodes.where("id = 'k:0'").first().parent_id
    hits = spark.createDataFrame([(parent, 0), ("k:1", 1)], "id string, rank int")
    got = tree.expand(hits, nodes, 100).collect()
    assert len(got) == 16 and got[-1].entity_id == "1"


def test_registered_trees_are_as_fine_as_the_vectors(spark, tmp_path):
    rows = [(10 * g + i, g, [50.0 * (j == g) + i / 50 for j in range(9)]) for g in range(9) for i in range(10)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["raptor_tree"](spark, str(tmp_path)).where("level = 0").count() == 9
    got = QUERIES["raptor_signal"](spark, str(tmp_path)).collect()
    assert {int(r.entity_id) for r in got} <= set(range(10)) and got


def test_folds_of_a_hot_key_pass_as_a_stream(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id").alias("t")).unionByName(spark.createDataFrame([("b", 1), ("b", None), (None, 2)], "k string, t bigint"))
    got = ordered_fold(df, "k", "t", {"n": T.LongType()}, lambda: 0, lambda n, t: (n + 1, (n + 1,)))
    assert got.where("k = 'hot'").agg(F.max("n"), F.count("*")).first()[:] == (30_000, 30_000) and got.where("k = 'b'").count() == 1 and got.count() == 30_001


def test_ingestion(spark):
    body = "<html><body><main>" + "word " * 40 + "</main></body></html>"
    fetched = spark.createDataFrame([("https://a.example/1", body), ("https://a.example/1", body), ("http://localhost/x", body), ("ftp://a.example", body), ("https://a.example/2", "<p>x</p>"), ("https://a.example/3", body), ("https://a.example/4", None)], "url string, html string")
    known = spark.createDataFrame([("https://a.example/3",), (None,)], "source_url string")
    assert [r.url for r in ingest.pages(fetched, known).collect()] == ["https://a.example/1"]
    rows = spark.createDataFrame([("h1", "fix: x", [("add", "a.rs")]), ("h2", "docs", [("modify", "b.rs"), ("add", "c.rs")])], "commit_hash string, commit_message string, files array<struct<change_type:string,file_path:string>>")
    activity, episodes = ingest.commits(rows, rows.where("commit_hash = 'h1'"))
    assert activity.count() == 2 and [(r.commit_hash, r.severity) for r in episodes.collect()] == [("h2", "low")]
