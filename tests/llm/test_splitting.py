import random

from pyspark.sql import functions as F

from siltstone.llm import splitting as S


def check(text, limit=4000, overlap=200):
    spans = S.spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(e - a <= limit for a, e in spans)
    assert all(c == e - overlap and d > e for (_, e), (c, d) in zip(spans, spans[1:]))
    return spans


def test_any_text_is_covered():
    for text in ("", "a", "a" * 4000, "a" * 4001, "x" * 100_000, "ab " * 40_000, "\n" * 9000, "Hi. " * 3000, "é" * 5000, "👩‍💻" * 4000):
        spans = check(text)
        assert len(spans) >= (1 if len(text) <= 4000 else -(-(len(text) - 200) // 3800))
    rnd = random.Random(1)
    for _ in range(1500):
        check("".join(rnd.choice(["a", "b ", ". ", "\n", "\n\n", " [USER]: ", "\r\n", "é", "word"]) for _ in range(rnd.randint(0, 200))), 60, 10)


def test_cuts_are_at_the_strongest_boundaries():
    turn = "[USER]: " + "word " * 300 + "\n"
    spans = check(turn * 5)
    assert all((turn * 5)[e : e + 7] == "[USER]:" for _, e in spans[:-1])
    paragraph = "Some sentence here. " * 60 + "\n\n"
    assert all((paragraph * 9)[e - 2 : e] == "\n\n" for _, e in check(paragraph * 9)[:-1])
    assert all(("Ten words. " * 900)[e - 1] == " " for _, e in check("Ten words. " * 900)[:-1])


def test_pieces_and_counts(spark):
    rows = [("a", "x" * 9000), ("b", "short"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("piece", F.lit(1))
    got = {}
    for r in S.pieces(df, "t", ["id"]).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert got["b"] == ["short"] and got["d"] == [""] and "c" not in got
    assert got["a"][0] + "".join(p[200:] for p in got["a"][1:]) == "x" * 9000
    assert {r.id: r.n_pieces for r in S.piece_counts(df, "t", ["id"]).collect()} == {"a": 3, "b": 1, "d": 1}


def test_runs_are_judged(spark):
    q = spark.createDataFrame(
        [("q1", "s1", "completed", "y" * 8000), ("q1", "s1", "pending", "y" * 8000), ("q2", "s2", "pending", "z" * 5000), ("q3", "s3", "completed", None), ("q4", "s4", "completed", ""), ("q5", "s5", "completed", "w" * 4000)],
        "id string, session_id string, status string, transcript string",
    )
    r = spark.createDataFrame([("r1", "s1", 2), ("r1", "s1", 2), ("r2", "s1", 3), ("r3", "s2", 0), ("r4", "s3", 0), ("r5", "s4", 0), ("r6", "s5", 0), ("r7", None, 0), ("r8", "s1", None), ("r9", "s5", 1)], "id string, session_id string, chunks_processed int")
    got = sorted(tuple(x) for x in S.oversized_and_miscounted(q, r).collect())
    assert got == [("queue", "q1"), ("queue", "q2"), ("run", "r1"), ("run", "r6")]
    assert S.oversized_and_miscounted(q.limit(0), r.limit(0)).count() == 0


def test_texts_of_one_id_are_kept_apart(spark):
    rows = [("a", "x" * 5000), ("a", "y" * 5000), ("a", "x" * 5000), (None, "z" * 4100), (None, "w" * 10), (None, "w" * 10)]
    df = spark.createDataFrame(rows, "id string, t string")
    cut_up = S.pieces(df, "t", ["id"])
    got = sorted((r.id or "", r.text[0], r.n_chars, r.fits, r.overlaps) for r in S.rebuilt(cut_up, ["id"]).collect())
    assert got == [("", "w", 10, True, True), ("", "z", 4100, True, True), ("a", "x", 5000, True, True), ("a", "y", 5000, True, True)]


def test_runs_are_suspected_by_the_pieces_of_the_heap(spark, monkeypatch):
    q = spark.createDataFrame([("q", "s", "completed", "y" * 8000)], "id string, session_id string, status string, transcript string")
    r = spark.createDataFrame([("r", "s", 2)], "id string, session_id string, chunks_processed int")
    monkeypatch.setattr(S, "piece_counts", lambda items, text, keys, *a: items.select(*keys, F.lit(8000).cast("bigint").alias("n_chars"), F.lit(2).cast("bigint").alias("n_pieces")))
    assert S.oversized_and_miscounted(q, r).where("record_type = 'run'").count() == 0
