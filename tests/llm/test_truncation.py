import random

from pyspark.sql import functions as F

from siltstone.llm import truncation as T

SENTENCES = ["The nightly job failed again because of a stale lease.", "We rebuilt the remote migration after the freeze.", "Nothing in the planner explains why latency fell.", "Remember that the cached parser must be pinned before the collector starts."]


def corpus():
    rnd = random.Random(4)
    sentence = lambda: rnd.choice(SENTENCES).replace(".", "") + "".join(" abcdefghij"[: rnd.randint(4, 10)] for _ in range(rnd.randint(0, 9))) + "."
    rows = [(i, " ".join(sentence() for _ in range(6)), "s1") for i in range(200)]
    rows += [(1000 + i, " ".join(sentence() for _ in range(3)) + "\n- pin the parser in lease.py", "s2") for i in range(40)]
    rows += [(2000 + i, " ".join(sentence() for _ in range(3)) + f"\nFixes #{i}", "s2") for i in range(30)]
    rows += [(3000 + i, " ".join(sentence() for _ in range(3)) + "\n-- \nsent by the relay", "s3") for i in range(30)]
    return rows


def cut(spark, extra):
    df = spark.createDataFrame(corpus() + extra, "doc_id bigint, text string, source string").withColumn("entity_type", F.lit("episode")).withColumn("kind", F.lit("x"))
    return {r[0] for r in T.cut_off(df).collect()}


def test_what_is_cut_off(spark):
    body = " ".join(SENTENCES)
    cases = [
        (1, body + " Remember that the cached par", "s1"), (2, body + " We rebuilt the remote", None), (3, body + " Nothing in the", "s1"), (4, body + " The nightly job […]", "s1"),
        (5, body + " We rebuilt the rem\n-- \nsent by the relay", "s3"), (6, body + "\n```py\nx = 1", "s1"), (7, body + "\n| a | b |\n|---|---|\n| 1", "s1"), (8, body + " The nightly �", "s1"), (9, body + "\n- pin the par", "s2"),
    ]
    fine = [(11, None, "s1"), (12, "", "s1"), (13, "  \n", "s1"), (14, body, None), (15, body + "\nFixes #99", "s2"), (16, body + "\n- pin the parser in lease.py", "s2"), (17, body + "\n```\nx\n```", "s1"), (18, body + ' He said "it works."', "s1")]
    got = cut(spark, [(i + 10_000, t, s) for i, t, s in cases + fine])
    assert {g - 10_000 for g in got} == {c[0] for c in cases}


def test_shares(spark):
    df = spark.createDataFrame(corpus() + [(9000, None, None), (9001, "The nightly job failed again because of a sta", None)], "doc_id bigint, text string, source string").withColumn("entity_type", F.lit(None).cast("string"))
    got = {r.source: (r.records, r.cut_off) for r in T.source_shares(df).collect()}
    assert got[None] == (2, 1) and got["s1"] == (200, 0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string, entity_type string")
    assert T.cut_off(df).count() == 0 and T.source_shares(df).count() == 0


def test_no_word_is_too_long_to_be_known(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    long_word = lambda n: "".join(letters[(i * i + 7 * i) % 26] for i in range(n))
    rows = [(i, f"- the {w} was read\n" + "- it was read\n" * i + "- it is done\n") for i, w in enumerate([long_word(90), long_word(600)] * 60)]
    ends = [(1000 + n, f"- it was read\n- the {long_word(size)[:n]}") for size, n in ((90, 50), (90, 70), (600, 64), (600, 500))]
    df = spark.createDataFrame([(i, t, "en", "s", "note") for i, t in rows + ends], "doc_id bigint, text string, lang string, source string, entity_type string")
    assert {r.doc_id for r in T.cut_off(df).collect()} == {n for n, _ in ends}


def test_last_words_are_whole(spark):
    assert T._Tail("a b " + "x" * 5000, (), None).w1 == "x" * 5000
    assert T._Tail("one two " + "é" * 700 + " end", (), None).words == ["two", "é" * 700, "end"]
    assert T._nodes("ab") == [T._hash("n\ta"), T._hash("n\tab")]
