import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import alike, entities
from siltstone.operators.entities import promotable
from siltstone.operators.learning import alike_titles
from siltstone.operators.upkeep import promote


def grams(t):
    return {w[i : i + 3] for x in t.lower().replace("-", " ").split() for w in [f"  {x} "] for i in range(len(w) - 2)}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def titles(seed, n):
    """Titles of a few patterns, as those of the tables: nearly all of them share trigrams."""
    words = ["cache", "planner", "lease", "index", "remote", "rebuild", "émigré", "日本語版", "𝒜𝒷𝒸"]
    rng = np.random.default_rng(seed)
    return sorted({str(rng.choice(["how to {} the {} {}", "why {}-{} needs a {}", "{} {} {} " * 9])).format(*rng.choice(words, 3), *["x"] * 24).strip() for _ in range(n)})


def test_alike_titles_are_those_of_brute_force_and_do_not_meet_on_trigrams(spark, monkeypatch):
    monkeypatch.setattr(alike, "LEAST_SIDE", 20)
    new, known = titles(1, 90), titles(2, 110)
    a, b = (spark.createDataFrame([(t,) for t in x + ["--", None]], "t string") for x in (new, known))
    for threshold in (0.0, 0.4, 0.6, 1.0):
        pairs = alike_titles(a, b, threshold)
        assert "gram" not in pairs._jdf.queryExecution().executedPlan().toString()  # a join on trigrams meets nearly all pairs, many times
        assert {(r.a, r.b): r.similarity for r in pairs.collect()} == {(x, y): jaccard(x, y) for x in new for y in known if jaccard(x, y) > threshold}
    assert alike_titles(a.limit(0), b, 0.4).count() == 0 == alike_titles(a, b.limit(0), 0.4).count()


@pytest.mark.parametrize("bits", [64, 4096])
def test_pairs_of_one_table_come_once(spark, monkeypatch, bits):
    monkeypatch.setattr(alike, "LEAST_SIDE", 20)
    held = alike.title_sets(spark.createDataFrame([(t,) for t in titles(3, 150)], "t string"))
    named = {r.n: r.t for r in held.collect()}
    want = sorted(tuple(sorted((x, y))) for x in named.values() for y in named.values() if x < y and jaccard(x, y) > 0.4)
    assert sorted(tuple(sorted((named[r.a], named[r.b]))) for r in alike.alike_pairs(held, None, 0.4).collect()) == want and want
    # In one block, with trigrams beyond those that are counted by bits.
    monkeypatch.setattr(alike, "BITS", bits)
    block = alike._Side(held.select("n", "codes").toArrow())
    got = [(int(x), int(y)) for a, b, _ in alike._alike(block, block, 0.4, True) for x, y in zip(a, b)]
    assert sorted(tuple(sorted((named[x], named[y]))) for x, y in got) == want


def test_titles_of_two_projects_do_not_meet_on_trigrams(spark):
    rows = [("a", "p", "Rebuild the cache"), ("b", "q", "rebuild the caches"), ("c", "p", "--"), ("d", "q", "--"), ("e", "p", "??"), ("f", None, "Rebuild the cache"), ("g", "p", "Rebuild the cache"), ("h", "r", None)]
    got = promotable(spark.createDataFrame(rows, "id string, project_id string, title string"))
    assert "gram" not in got._jdf.queryExecution().executedPlan().toString()
    # What SQL gives: the same title is like itself, even without trigrams.
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2), ("b", 2), ("c", 2), ("d", 2), ("g", 2)]


def test_copies_are_of_titles_that_two_projects_have(spark):
    rows = [(f"{x}{i}", t, "", x) for x, seed in (("p", 4), ("q", 5)) for i, t in enumerate(titles(seed, 60))]
    copies, edges = promote(spark.createDataFrame(rows, "id string, title string, content string, project_id string"))
    assert "gram" not in edges._jdf.queryExecution().executedPlan().toString()
    want = {i for i, t, _, x in rows if any(y != x and jaccard(t, u) > 0.4 or y != x and t == u for _, u, _, y in rows)}
    assert {r.target for r in edges.collect()} == want and copies.count() == len({t for i, t, _, _ in rows if i in want})


@pytest.mark.parametrize("near", [1, 3, 1024])
def test_copies_need_one_like_and_no_list_of_pairs(spark, monkeypatch, near):
    monkeypatch.setattr(entities, "alike_pairs", None)  # before, pairs grew with the square of the titles
    monkeypatch.setattr(alike, "NEAR", near)
    monkeypatch.setattr(alike, "LEAST_SIDE", 20)
    monkeypatch.setattr(alike, "MOST_SIDE", 30)
    rows = [(f"{x}{i}", t, f"c{i}", x) for x, seed in (("p", 4), ("q", 5), ("r", 6)) for i, t in enumerate(titles(seed, 30))]
    rows += [("a", "--", "", "p"), ("b", "--", "", "q"), ("c", "??", "", "p"), ("d", None, "", "p"), ("e", "Quite alone", "", "p"), ("f", "quite alone", "", None), ("g", "zzz zzz", "", "p"), ("h", "zzz: zzz", "", "p")]
    copies, edges = promote(spark.createDataFrame(rows, "id string, title string, content string, project_id string"))
    held = [r for r in rows if r[1] and r[3]]
    like = lambda t, u: t.lower() == u.lower() or bool(grams(t) | grams(u)) and jaccard(t, u) > 0.4
    letters = lambda t: "" if t in ("--", "??") else t.replace(":", "")
    want = {i for i, t, _, x in held if any(y != x and (t == u or like(letters(t), letters(u)) and letters(t)) for _, u, _, y in held)}
    assert {r.target for r in edges.collect()} == want and {"a", "b"} < want and not want & set("cdefgh")
    first = {}
    for i, t, c, _ in sorted(r for r in held if r[0] in want):
        first.setdefault(t.lower(), (t, c))
    assert sorted((r.title, r.content) for r in copies.collect()) == sorted(first.values())


def test_trigrams_of_words_are_those_of_columns(spark):
    some = [*titles(7, 40), "a", "ab ab", "x-y_z  9", "Straße ÇA", "𝒜 𝒜𝒷"]
    held = alike.title_sets(spark.createDataFrame([(t,) for t in some], "t string").withColumn("words", F.array_join(X.letter_words(F.col("t")), " "))).toArrow()
    a, b = alike._Side(held), alike._side(held.column("words"))
    assert (a.size == b.size).all()
    assert all(set(a.codes[a.row == i]) == set(b.codes[b.row == i]) for i in range(len(some)))
