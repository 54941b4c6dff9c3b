import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import near_duplicates as N


def brute(rows):
    sets = {}
    for kind, i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if i is not None:
            sets[kind, i] = set(zip(w, w[1:], w[2:]))
    out = set()
    for ka, a in sets:
        for kb, b in sets:
            if ka == kb and a < b:
                x, y = sets[ka, a], sets[kb, b]
                if x & y and 5 * len(x & y) >= 3 * len(x | y):
                    out.add((ka, a, b))
    return out


def corpus(seed, n=160):
    rnd, words = random.Random(seed), [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            t = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            text = " ".join(t)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)) ) or "a b"
        texts.append(text)
        rows.append((rnd.choice(["k", "p"]), f"i{i:03}", text if rnd.random() < 0.9 else text.upper() + "!!"))
    return rows + [("k", "null", None), ("k", "empty", ""), ("k", "short", "a b"), ("k", None, "w1 w2 w3 w4"), ("k", "i000", rows[0][2]) if rows[0][0] == "k" else ("p", "i000", rows[0][2])]


@pytest.mark.parametrize("block", [8192, 3])
def test_same_pairs_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_POSTINGS", block)
    rows = corpus(block)
    df = spark.createDataFrame(rows, "kind string, id string, text string").withColumn("sum", F.lit(1))
    got = [tuple(r) for r in N.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_and_links(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("k", f"c{i}", text if i % 2 else text.upper()) for i in range(6)] + [("k", "near", text + " eleven"), ("p", "other", text)]
    members, links = N.similar_classes(spark.createDataFrame(rows, "kind string, id string, text string"))
    classes = {r.id: r.class_id for r in members.collect()}
    assert {classes[f"c{i}"] for i in range(6)} == {"c0"} and classes["near"] == "near" and classes["other"] == "other"
    assert [tuple(r) for r in links.collect()] == [("k", "c0", "near")]


def test_no_rows_and_one_giant_text(spark):
    schema = "kind string, id string, text string"
    assert N.similar_pairs(spark.createDataFrame([], schema)).count() == 0
    giant = " ".join(f"x{i}" for i in range(120_000))
    rows = [("k", "a", giant), ("k", "b", giant + " more words here"), ("k", "c", "small")]
    assert [tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, schema)).collect()] == [("k", "a", "b")]


def test_texts_of_records(spark):
    k = spark.createDataFrame([("a", "T", None), ("b", None, "c")], "id string, title string, content string")
    p = spark.createDataFrame([("z", None)], "id string, content string")
    assert [tuple(r) for r in N.record_texts(k, p).orderBy("id").collect()] == [("knowledge_item", "a", "T "), ("knowledge_item", "b", " c"), ("procedure", "z", "")]


@pytest.mark.parametrize("block", [8192, 5])
def test_a_giant_class_gives_the_pairs_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "CELL_MEMBERS", 7)
    monkeypatch.setattr(N, "BLOCK_POSTINGS", block)
    text = "one two three four five six seven eight nine ten"
    rows = [("k", f"c{i:02}", text) for i in range(40)] + [("k", f"d{i:02}", text + " eleven") for i in range(30)] + [("k", f"e{i}", f"{text} twelve {i}") for i in range(8)] + [("p", "c00", text)]
    df = spark.createDataFrame(rows, "kind string, id string, text string").repartition(5)
    got = [tuple(r) for r in N.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
