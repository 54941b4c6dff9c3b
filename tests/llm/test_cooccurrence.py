import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import cooccurrence as O


def brute(baskets, min_count, min_lift):
    sets = {}
    for b, i in baskets:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, single, pair = len(sets), Counter(), Counter()
    for s in sets.values():
        single.update(s)
        pair.update(itertools.combinations(sorted(s), 2))
    return {(a, b, c) for (a, b), c in pair.items() if c >= min_count and c * n >= min_lift * single[a] * single[b]}


def rows_of(state):
    return {(r.item_a, r.item_b, r.c) for r in O.associations(state).collect()}


def random_baskets(seed, n=80):
    rnd = random.Random(seed)
    out = [(f"b{i}", f"i{rnd.choice([rnd.randrange(4), rnd.randrange(30)])}") for i in range(n) for _ in range(rnd.randint(1, 9))]
    return out + [("big", f"i{k}") for k in range(30)] + [(None, "i1"), ("b1", None), out[0]]


def test_updates_give_what_a_new_count_gives(spark, tmp_path):
    rows = random_baskets(3)
    df = spark.createDataFrame(rows, "basket string, item string").withColumn("n", F.lit(1))
    state = O.update(O.empty(spark, 3, 1.5), df.where("basket < 'b5' or basket is null"))
    state = O.update(state, df.where("basket >= 'b5'"))
    assert rows_of(state) == brute(rows, 3, 1.5)
    changed = [r for r in rows if r[0] not in ("b1", "b2", "b3")] + [("b2", "i1"), ("b2", "i29"), ("b3", "i3"), ("b3", "i4")]
    state = O.update(state, spark.createDataFrame([("b1", None), ("b2", "i1"), ("b2", "i29"), ("b3", "i3"), ("b3", "i4")], "basket string, item string"))
    assert rows_of(state) == brute(changed, 3, 1.5)
    folder = str(tmp_path / "s")
    O.save(state, folder)
    assert rows_of(O.load(spark, folder)) == brute(changed, 3, 1.5)
    for basket, items in (("b7", []), ("b8", ["i1", "i2"]), ("new", ["i1", "i2", "i3"]), ("big", ["i1"])):
        changed = [r for r in changed if r[0] != basket] + [(basket, i) for i in items]
        state = O.update_saved(spark, folder, spark.createDataFrame([(basket, i) for i in items or [None]], "basket string, item string"))
        assert rows_of(state) == brute(changed, 3, 1.5)
        assert state.n_baskets == len({b for b, i in changed if b is not None and i is not None})
    before = rows_of(state)
    assert rows_of(O.update_saved(spark, folder, spark.createDataFrame([], "basket string, item string"))) == before


def test_a_small_change_writes_few_buckets(spark, tmp_path):
    rows = [(f"b{i}", f"i{i % 50}-{j}") for i in range(400) for j in range(4)]
    state = O.update(O.empty(spark, 2, 1.0), spark.createDataFrame(rows, "basket string, item string"))
    after = O.update(state, spark.createDataFrame([("b1", "i1-0"), ("b1", "i1-1")], "basket string, item string"))
    assert len(after.changed["baskets"]) == 1 and len(after.changed["items"]) <= 2 and len(after.changed["pairs"]) <= 5
    assert rows_of(after) == brute([r for r in rows if r[0] != "b1" or r[1] in ("i1-0", "i1-1")], 2, 1.0)


@pytest.mark.parametrize("block", [1, 4, 128])
def test_large_baskets_are_split(spark, block):
    df = spark.createDataFrame([("b", f"i{k}") for k in range(20)] + [("c", "x")], "basket string, item string")
    got = [(r.item_a, r.item_b) for r in O.basket_pairs(df, block).collect()]
    assert len(got) == len(set(got)) == 190 and all(a < b for a, b in got)


def test_plain_paths(spark):
    paths = [("./a//b.c ", "a/b.c"), ("a\\b\\c", "a/b/c"), ("a/./b/../c", "a/c"), ("../x", "../x"), ("/a/b/", "/a/b"), (" ", None), ("", None), (None, None), (".", None), ("a..b/c.d", "a..b/c.d")]
    df = spark.createDataFrame(paths, "p string, want string")
    assert all(r.got == r.want for r in df.select("want", O.plain_path(F.col("p")).alias("got")).collect())


def test_no_rows(spark):
    state = O.update(O.empty(spark, 2, 1.0), spark.createDataFrame([], "basket string, item string"))
    assert rows_of(state) == set()
