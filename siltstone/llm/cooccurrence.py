"""Items that appear together: an incrementally kept table of pair counts.

The state holds the baskets, the count of every item, the counts of the pairs that can matter and the scores of those that
are frequent, each spread over hash buckets. An update takes the baskets that changed, emits a signed delta for every pair
and item they lost or gained, merges the deltas into the persistent counts, and computes anew the scores they affect. Only
rows that a delta may meet are shuffled, everything else is passed on as it is stored; a saved state has only those buckets
written again that changed. The number of baskets is part of every score, so it isn't stored with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bits import bit_table, bits_for, may_be_in
from siltstone.plans.lineage import cut

#: Items of one cell of a basket; a larger basket is split into cells of pairs of blocks, spread over tasks.
BLOCK_ITEMS = 128

#: Buckets of each table of a new state. A saved state has a file or more for each, so a large table is given more of them.
BUCKETS = 32


def plain_path(path: Column) -> Column:
    """A path with forward slashes and nothing superfluous: no outer white space, empty, '.' or resolvable '..' parts.
    Null for null, blank and empty paths."""
    slashed = F.replace(F.regexp_replace(path, "(?U)^\\s+|\\s+$", ""), F.lit("\\"), F.lit("/"))
    # An array of one lets its element be computed once, however often it is used.
    return F.element_at(F.transform(F.array(slashed), _without_superfluous), 1)


def _without_superfluous(slashed: Column) -> Column:
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    climbs = lambda acc, p: (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    walked = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(climbs(acc, p), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
    )
    root = F.when(slashed.startswith("/"), "/").otherwise("")
    neat = F.when(slashed.rlike("(^|/)(\\.{0,2})(/|$)"), F.concat(root, F.array_join(walked, "/"))).otherwise(slashed)
    return F.when(F.length(neat) > 0, neat)


_PAIR = ["item_a", "item_b"]
_KEYS = {"baskets": ["basket"], "items": ["item"], "pairs": _PAIR, "scores": _PAIR}
_COLUMNS = {
    "baskets": "bucket int, basket string, item string", "items": "bucket int, item string, n bigint",
    "pairs": "bucket int, item_a string, item_b string, c bigint", "scores": "bucket int, item_a string, item_b string, c bigint, a bigint, b bigint",
}


@dataclass(frozen=True)
class PairState:
    """baskets: basket, item. items: item, n. pairs: item_a, item_b, c for item_a < item_b, both eligible. scores: item_a,
    item_b, c, a, b of the pairs with c >= min_count. Each has the bucket of its key. changed: by table, the buckets that
    aren't as they were in the state this one was made from.
    An item is eligible if it is in min_count baskets at least and can still reach min_lift: as c <= min(a, b), a pair
    with c * N >= min_lift * a * b has N >= min_lift * max(a, b). Pairs of other items can't be asked for and aren't kept."""

    baskets: DataFrame
    items: DataFrame
    pairs: DataFrame
    scores: DataFrame
    n_baskets: int
    min_count: int
    min_lift: float
    buckets: int = BUCKETS
    changed: dict[str, list[int]] = field(default_factory=dict)


def empty(spark: SparkSession, min_count: int, min_lift: float, buckets: int = BUCKETS) -> PairState:
    tables = {name: spark.createDataFrame([], columns) for name, columns in _COLUMNS.items()}
    return PairState(**tables, n_baskets=0, min_count=min_count, min_lift=min_lift, buckets=buckets)


_MANIFEST = "generation int, name string, bucket int, version int, n_baskets bigint, min_count int, min_lift double, buckets int"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return rows.join(F.broadcast(rows.agg(F.max("generation").alias("generation"))), "generation")


def _write(state: PairState, folder: str, generation: int, held: list[tuple[str, int, int]]) -> None:
    """Writes the changed buckets as a new version. The manifest comes last: a state is the latest that has one."""
    spark = state.baskets.sparkSession
    for name, buckets in state.changed.items():
        if buckets:
            rows = getattr(state, name).where(F.col("bucket").isin(buckets))
            # What an update passes on comes bucket by bucket from its files; a whole state is brought together once.
            rows = rows if held else rows.repartition("bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/v{generation}")
    now = {(name, bucket): version for name, bucket, version in held} | {(name, bucket): generation for name, buckets in state.changed.items() for bucket in buckets}
    rows = [(generation, name, bucket, version, state.n_baskets, state.min_count, float(state.min_lift), state.buckets) for (name, bucket), version in now.items()]
    rows = rows or [(generation, "", -1, 0, state.n_baskets, state.min_count, float(state.min_lift), state.buckets)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def save(state: PairState, folder: str) -> None:
    """Writes all of a state into a folder that holds none."""
    every = PairState(**{**state.__dict__, "changed": {name: list(range(state.buckets)) for name in _KEYS}})
    _write(every, folder, 0, [])


def load(spark: SparkSession, folder: str) -> PairState:
    """The saved state as of its latest update, read bucket by bucket from the version that holds it. The manifest has a row
    for each table and bucket, whatever the data."""
    rows = _manifest(spark, folder).collect()
    tables = {}
    for name, columns in _COLUMNS.items():
        out = None
        for version in sorted({r.version for r in rows if r.name == name}):
            own = [r.bucket for r in rows if r.name == name and r.version == version]
            each = spark.read.schema(columns).parquet(f"{folder}/{name}/v{version}").where(F.col("bucket").isin(own))
            out = each if out is None else out.unionByName(each)
        tables[name] = spark.createDataFrame([], columns) if out is None else out.select(*(c.split()[0] for c in columns.split(", ")))
    return PairState(**tables, n_baskets=rows[0].n_baskets, min_count=rows[0].min_count, min_lift=rows[0].min_lift, buckets=rows[0].buckets)


def update_saved(spark: SparkSession, folder: str, changed: DataFrame) -> PairState:
    """As update, on a saved state: buckets that nothing changed in are neither read for the merge nor written."""
    held = [(r.name, r.bucket, r.version) for r in _manifest(spark, folder).where("bucket >= 0").collect()]
    generation = _manifest(spark, folder).agg(F.max("generation")).first()[0] + 1
    _write(update(load(spark, folder), changed), folder, generation, held)
    return load(spark, folder)


def _bucketed(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*_KEYS[name]), F.lit(buckets)).cast("int"))


def _met(rows: DataFrame, columns: list[str], keys: DataFrame) -> Column:
    """Whether a row may have one of the keys (distinct, cut), and surely doesn't where this is false."""
    hashes = keys.select(F.xxhash64(*keys.columns).alias("key"))
    bits = bits_for(hashes.count())
    return may_be_in(rows.sparkSession, bit_table(hashes, bits), bits, F.xxhash64(*columns))


def _split(rows: DataFrame, name: str, keys: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows that may have one of the keys, all others, the buckets of the keys); keys: bucket and the table's key columns."""
    own = [r[0] for r in keys.select("bucket").distinct().collect()]
    there = F.col("bucket").isin(own) if own else F.lit(False)
    near = _met(rows, _KEYS[name], keys.select(*_KEYS[name]))
    return rows.where(there).where(near), rows.where(~there).unionByName(rows.where(there).where(~near)), own


def basket_pairs(baskets: DataFrame, block_items: int = BLOCK_ITEMS, keys: Sequence[str] = ("basket",)) -> DataFrame:
    """keys, item_a, item_b with item_a < item_b for distinct rows (keys, item). A basket of n items is cut into
    ceil(n / block_items) hash blocks, and each pair of blocks is a cell of its own, so that no task holds a large basket."""
    sizes = baskets.groupBy(*keys).agg(F.ceil(F.count("*") / block_items).cast("int").alias("blocks")).where("blocks > 1")
    rows = baskets.join(sizes, list(keys), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(*keys, "item", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    a = cells.select(*keys, "lo", "hi", F.col("item").alias("item_a"), F.col("block").alias("block_a"))
    b = cells.select(*keys, "lo", "hi", F.col("item").alias("item_b"), F.col("block").alias("block_b"))
    own = (F.least("block_a", "block_b") == F.col("lo")) & (F.greatest("block_a", "block_b") == F.col("hi"))
    return a.join(b, [*keys, "lo", "hi"]).where((F.col("item_a") < F.col("item_b")) & own).select(*keys, "item_a", "item_b")


def _can_matter(n: Column, n_baskets: int, state: PairState) -> Column:
    return (n >= state.min_count) & (n * F.lit(float(state.min_lift)) <= F.lit(float(n_baskets)))


def _signed_pairs(baskets: DataFrame, items: DataFrame, n_baskets: int, state: PairState, sign: int) -> DataFrame:
    eligible = items.where(_can_matter(F.col("n"), n_baskets, state)).select("item")
    kept = baskets.select("basket", "item").join(eligible, "item", "left_semi")
    return basket_pairs(kept).select(*_PAIR, F.lit(sign).cast("bigint").alias("c"))


def _scored(pairs: DataFrame, items: DataFrame) -> DataFrame:
    a = items.select(F.col("item").alias("item_a"), F.col("n").alias("a"))
    b = items.select(F.col("item").alias("item_b"), F.col("n").alias("b"))
    return pairs.join(a, "item_a").join(b, "item_b").select("bucket", *_PAIR, "c", "a", "b")


def _begun(state: PairState, fresh: DataFrame) -> PairState:
    """The state of all baskets at once: every delta is a gain."""
    n = fresh.select("basket").distinct().count()
    items = cut(_bucketed(fresh.groupBy("item").agg(F.count("*").alias("n")), "items", state.buckets).select("bucket", "item", "n"))
    summed = _signed_pairs(fresh, items, n, state, 1).groupBy(*_PAIR).agg(F.sum("c").alias("c"))
    pairs = cut(_bucketed(summed, "pairs", state.buckets).select("bucket", *_PAIR, "c"))
    scores = cut(_scored(pairs.where(F.col("c") >= state.min_count), items))
    every = {name: list(range(state.buckets)) for name in _KEYS}
    return PairState(fresh, items, pairs, scores, n, state.min_count, state.min_lift, state.buckets, every)


def update(state: PairState, changed: DataFrame) -> PairState:
    """The state after the baskets in `changed` (basket, item) got exactly the items listed there. A basket that is
    listed with a null item only is removed. Null baskets are ignored, repeated rows count once, extra columns don't
    matter, and an empty `changed` leaves the state as it was. Besides the changed baskets, only those are read again that
    hold an item which became eligible or ceased to be."""
    k = state.buckets
    rows = changed.where(F.col("basket").isNotNull()).select("basket", "item").distinct()
    rows = cut(_bucketed(rows, "baskets", k).select("bucket", "basket", "item"))
    fresh = rows.where(F.col("item").isNotNull())
    if not state.n_baskets:
        return _begun(state, fresh)
    touched = cut(rows.select("bucket", "basket").distinct())
    near, far, basket_buckets = _split(state.baskets, "baskets", touched)
    near = cut(near)
    before = near.join(touched.select("basket"), "basket", "left_semi").select("bucket", "basket", "item")
    baskets = far.unionByName(near.join(touched.select("basket"), "basket", "left_anti").select("bucket", "basket", "item")).unionByName(fresh)
    n = state.n_baskets - before.select("basket").distinct().count() + fresh.select("basket").distinct().count()

    # Items: marginal deltas, and which items turned eligible or ceased to be.
    moved = fresh.select("item", F.lit(1).alias("d")).unionByName(before.select("item", F.lit(-1).alias("d"))).groupBy("item").agg(F.sum("d").alias("d")).where("d <> 0")
    moved = cut(_bucketed(moved, "items", k))
    near_items, far_items, item_buckets = _split(state.items, "items", moved)
    both = near_items.select("item", F.col("n").alias("old"), F.col("n").alias("n")).unionByName(moved.select("item", F.lit(0).cast("bigint").alias("old"), F.col("d").alias("n")))
    both = cut(_bucketed(both.groupBy("item").agg(F.sum("old").alias("old"), F.sum("n").alias("n")), "items", k))
    items = far_items.unionByName(both.where("n > 0").select("bucket", "item", "n"))
    was, is_ = (lambda c: _can_matter(F.col(c), state.n_baskets, state)), _can_matter(F.col("n"), n, state)
    turned = cut(both.where(was("old") != is_).select("item").unionByName(far_items.where(was("n") != is_).select("item")))
    again = None
    if not turned.isEmpty():
        holders = state.baskets.where(_met(state.baskets, ["item"], turned)).join(turned, "item", "left_semi").select("bucket", "basket").distinct()
        holders = cut(holders.join(touched.select("basket"), "basket", "left_anti").select("bucket", "basket"))
        again = cut(_split(state.baskets, "baskets", holders)[0].join(holders.select("basket"), "basket", "left_semi").select("bucket", "basket", "item"))

    # Pairs: signed deltas, merged into the counts.
    lost, gained = (before, fresh) if again is None else (before.unionByName(again), fresh.unionByName(again))
    deltas = _signed_pairs(lost, state.items, state.n_baskets, state, -1).unionByName(_signed_pairs(gained, items, n, state, 1))
    deltas = cut(_bucketed(deltas.groupBy(*_PAIR).agg(F.sum("c").alias("c")).where("c <> 0"), "pairs", k).select("bucket", *_PAIR, "c"))
    near_pairs, far_pairs, pair_buckets = _split(state.pairs, "pairs", deltas)
    after = cut(near_pairs.unionByName(deltas).groupBy("bucket", *_PAIR).agg(F.sum("c").alias("c")))
    pairs = far_pairs.unionByName(after.where("c > 0"))

    # Scores: those of pairs whose count or whose items' counts changed.
    named, own = moved.select("item"), state.scores
    affected = _met(own, ["item_a"], named) | _met(own, ["item_b"], named) | _met(own, _PAIR, after.select(*_PAIR))
    marked = own.withColumn("__hit", affected)
    stale = cut(marked.where("__hit").drop("__hit"))
    latest = stale.select("bucket", *_PAIR, "c", F.lit(0).alias("turn")).unionByName(after.select("bucket", *_PAIR, "c", F.lit(1).alias("turn")))
    latest = latest.groupBy("bucket", *_PAIR).agg(F.max(F.struct("turn", "c"))["c"].alias("c")).where(F.col("c") >= state.min_count)
    renewed = cut(_scored(latest, items))
    scores = marked.where("not __hit").drop("__hit").unionByName(renewed)
    score_buckets = [r[0] for r in stale.select("bucket").unionByName(renewed.select("bucket")).distinct().collect()]
    touched_buckets = {"baskets": basket_buckets, "items": item_buckets, "pairs": pair_buckets, "scores": score_buckets}
    return PairState(baskets, items, pairs, scores, n, state.min_count, state.min_lift, k, touched_buckets)


def associations(state: PairState) -> DataFrame:
    """item_a, item_b, c, a, b, lift of the pairs with c >= min_count and c * N >= min_lift * a * b, in whole numbers. A pass
    over the scores, without a shuffle."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    strong = wide("c") * F.lit(state.n_baskets).cast("decimal(19,0)") >= F.lit(str(state.min_lift)).cast("decimal(9,3)") * (wide("a") * wide("b")).cast("decimal(28,0)")
    return state.scores.where(strong).select(*_PAIR, "c", "a", "b", (F.col("c") * state.n_baskets / (F.col("a").cast("double") * F.col("b"))).alias("lift"))


def commit_baskets(git_activity: DataFrame) -> DataFrame:
    """basket, item: the plain paths of each commit; letter case of the hash doesn't matter, rows without a path don't count."""
    rows = git_activity.select(F.lower("commit_hash").alias("basket"), plain_path(F.col("file_path")).alias("item"))
    return rows.where(F.col("item").isNotNull() & F.col("basket").isNotNull())
