"""Decay, pruning, reviews, queues, alerts and weight learning: each job as one pass that gives the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import scores
from siltstone.functions.text import SIGNAL_WEIGHTS
from siltstone.operators.analytics import since
from siltstone.plans.folding import ordered_fold


def memory_decay(items: DataFrame, as_of: str) -> DataFrame:
    """items after decay, boost and pruning, in this order. What wasn't accessed for 7 days (or never, and is as old) loses
    5 % while above 0.1; what was accessed within them gains 10 % up to 1. Items below 0.1 that were created more than 30 days
    ago go, and so do superseded ones that weren't updated for 7. Any table with these columns will do."""
    recent = F.coalesce(since(F.col("last_accessed_at"), as_of, 7, inclusive=True), F.lit(False))
    idle = F.when(F.col("last_accessed_at").isNull(), ~since(F.col("created_at"), as_of, 7, inclusive=True)).otherwise(~recent)
    u = F.col("utility_score")
    decayed = F.when(idle & (u > 0.1), u * 0.95).when(recent, F.least(u * 1.1, F.lit(1.0))).otherwise(u)
    out = items.withColumn("utility_score", decayed)
    pruned = (F.col("utility_score") < 0.1) & ~since(F.col("created_at"), as_of, 30, inclusive=True)
    gone = F.col("superseded_by").isNotNull() & ~since(F.col("updated_at"), as_of, 7, inclusive=True)
    return out.where(~F.coalesce(pruned, F.lit(False)) & ~F.coalesce(gone, F.lit(False)))


def outcome_counts(procedures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """procedures with the outcomes (id, success) added to their counts and the success rate drawn anew."""
    new = outcomes.groupBy("id").agg(F.count_if("success").alias("__s"), F.count_if(~F.col("success")).alias("__f"))
    out = procedures.join(new, "id", "left").withColumns({"times_success": F.col("times_success") + F.coalesce("__s", F.lit(0)), "times_failure": F.col("times_failure") + F.coalesce("__f", F.lit(0))})
    out = out.withColumn("times_used", F.col("times_success") + F.col("times_failure"))
    return out.withColumn("success_rate", scores.wilson_lower(F.col("times_success"), F.col("times_used"))).drop("__s", "__f")


def review(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """items (id, easiness, repetitions, interval) after one review each (id, quality)."""
    rows = items.join(reviews, "id")
    q, e, r, i = F.col("quality"), F.col("easiness"), F.col("repetitions"), F.col("interval")
    return rows.select("id", scores.sm2_easiness(q, e).alias("easiness"), scores.sm2_repetitions(q, r).alias("repetitions"), scores.sm2_interval(q, e, r, i).alias("interval"))


def review_history(reviews: DataFrame, order: list[str]) -> DataFrame:
    """id, easiness, repetitions, interval after all reviews (id, quality) of each item in order, from 2.5, 0, 0. An item's
    reviews are folded inside one row; there are as many as a person gave it."""
    held = reviews.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*order, "quality"))).alias("r"))
    start = F.struct(F.lit(2.5).alias("easiness"), F.lit(0).alias("repetitions"), F.lit(0).alias("interval"))

    def step(acc: Column, x: Column) -> Column:
        q, e, r, i = x["quality"], acc["easiness"], acc["repetitions"], acc["interval"]
        return F.struct(scores.sm2_easiness(q, e).alias("easiness"), scores.sm2_repetitions(q, r).alias("repetitions"), scores.sm2_interval(q, e, r, i).alias("interval"))

    return held.select("id", F.aggregate("r", start, step).alias("s")).select("id", "s.easiness", "s.repetitions", "s.interval")


def due_for_review(items: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    due = items.where((F.col("sr_next_review") <= F.lit(as_of).cast("timestamp")) & F.col("superseded_by").isNull()).orderBy("sr_next_review", "id")
    return due if limit is None else due.limit(limit)


def learn_weights(ctr: DataFrame, old: DataFrame | None = None, at_least: int = 10) -> DataFrame:
    """query_type, signal, weight, samples: the click-through rates (query_type, signal, samples, shows, clicks) of types with
    at least `at_least` clicked searches, scaled by the best signal of the type and mixed with the old weights (query_type,
    signal, weight). Each of the five signals gets a weight: one that brought nothing has a rate of 0. Where a type has no old
    weight the default counts, and types that aren't known have those of a semantic query. A type without any click on an
    attributed result is left as it is and has no row."""
    spark = ctr.sparkSession
    names = tuple(SIGNAL_WEIGHTS["semantic"])
    rates = ctr.groupBy("query_type").agg(
        F.max("samples").alias("samples"),
        *(F.max(F.when(F.col("signal") == n, F.col("clicks") / F.nullif(F.col("shows"), F.lit(0)))).alias(n) for n in names),
    )
    rates = rates.where(F.col("samples") >= at_least).withColumn("best", F.greatest(*(F.coalesce(n, F.lit(0.0)) for n in names)))
    each = rates.where("best > 0").select("query_type", "samples", "best", F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.coalesce(n, F.lit(0.0)))))).alias("signal", "rate"))
    usual = spark.createDataFrame([(t, n, float(x)) for t, ws in SIGNAL_WEIGHTS.items() for n, x in ws.items()], "query_type string, signal string, usual double")
    each = each.join(usual, ["query_type", "signal"], "left")
    fallback = F.coalesce(*(F.when(F.col("signal") == n, F.lit(float(x))) for n, x in SIGNAL_WEIGHTS["semantic"].items()))
    held = F.lit(None).cast("double")
    if old is not None:
        each, held = each.join(old.withColumnRenamed("weight", "held"), ["query_type", "signal"], "left"), F.col("held")
    before = F.coalesce(held, F.col("usual"), fallback)
    return each.select("query_type", "signal", scores.ema(scores.ctr_weight(F.col("rate"), F.col("best")), before).alias("weight"), "samples")


def debounced(queue: DataFrame, as_of: str, cooldown: float = 180.0) -> DataFrame:
    """The queue's pending rows that may run: the newest of each session, if it has waited long enough, oldest first."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("queued_at"), F.desc("id"))
    rows = queue.where("status = 'pending'").withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")
    return rows.where(scores.seconds(F.lit(as_of).cast("timestamp")) - scores.seconds(F.col("queued_at")) > cooldown).orderBy("queued_at", "id")


def enqueue(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """queue with incoming rows added; pending rows of their sessions are cancelled."""
    again = incoming.select("session_id").distinct().withColumn("__again", F.lit(True))
    old = queue.join(again, "session_id", "left").withColumn("status", F.when((F.col("status") == "pending") & F.col("__again").isNotNull(), "cancelled").otherwise(F.col("status"))).drop("__again")
    return old.unionByName(incoming.withColumn("status", F.lit("pending")), allowMissingColumns=True).select(*queue.columns)


MOST_RULES = 10_000

#: States of a queue item from the last to the first that it goes through.
LAST_FIRST = ("failed_permanent", "cancelled", "completed", "processing", "pending")


def one_state(queue: DataFrame) -> DataFrame:
    """id, retry_count, status of each id: of repeated rows the one with the most retries, then the one furthest along; other
    states count for less than these, of them the last by name."""
    place = F.coalesce(*(F.when(F.col("status") == x, F.lit(-n)) for n, x in enumerate(LAST_FIRST)), F.lit(-len(LAST_FIRST)))
    last = F.max(F.struct(F.col("retry_count"), place.alias("place"), F.col("status"))).alias("m")
    return queue.groupBy("id").agg(last).select("id", "m.retry_count", "m.status")


def retried(queue: DataFrame, failed: DataFrame, most: int = 3) -> DataFrame:
    """queue after failures (id): another try, or permanently failed after `most`."""
    hit = failed.select("id").distinct().withColumn("__hit", F.lit(True))
    out = queue.join(hit, "id", "left").withColumn("retry_count", F.when(F.col("__hit").isNotNull(), F.col("retry_count") + 1).otherwise(F.col("retry_count")))
    return out.withColumn("status", F.when(F.col("__hit").isNull(), F.col("status")).when(F.col("retry_count") >= most, "failed_permanent").otherwise("pending")).drop("__hit")


def sessions_of(events: DataFrame, by: str, time: str, gap: float) -> DataFrame:
    """by, session_no, n, first, last: runs of events with less than `gap` seconds between them."""
    w = Window.partitionBy(by).orderBy(time)
    rows = events.select(by, F.col(time).alias("t"), F.lag(time).over(w).alias("before"))
    rows = rows.withColumn("new", F.when(F.col("before").isNull() | (scores.seconds(F.col("t")) - scores.seconds(F.col("before")) >= gap), 1).otherwise(0))
    rows = rows.withColumn("session_no", F.sum("new").over(Window.partitionBy(by).orderBy("t")))
    return rows.groupBy(by, "session_no").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def windows(events: DataFrame, time: str, by: list[str], length: str, slide: str | None = None) -> DataFrame:
    """start, by, n: counts in tumbling or sliding windows."""
    return events.groupBy(F.window(time, length, slide).alias("w") if slide else F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def alerts(logs: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """rule, n: rules (name, threshold, window_secs, filter_level, filter_target, filter_pattern, last_triggered_at) whose
    count of matching logs in the trailing window reaches the threshold, unless they were triggered within it. Rules are
    written by people, so they are few, and up to MOST_RULES of them are sent to all tasks; a rule that filters nothing matches all."""
    now = scores.seconds(F.lit(as_of).cast("timestamp"))
    few = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    l, r = logs.alias("l"), F.broadcast(rules.alias("r")) if few else rules.alias("r")
    asked = lambda rule, cond: F.col(rule).isNull() | cond
    fits = (scores.seconds(F.col("l.timestamp")) > now - F.col("r.window_secs")) & (scores.seconds(F.col("l.timestamp")) <= now)
    fits = fits & asked("r.filter_level", F.col("l.level") == F.col("r.filter_level")) & asked("r.filter_target", F.col("l.target").startswith(F.col("r.filter_target"))) & asked("r.filter_pattern", F.rlike(F.col("l.message"), F.col("r.filter_pattern")))
    counts = l.join(r, fits).groupBy("r.name", "r.threshold", "r.window_secs", "r.last_triggered_at").agg(F.count("*").alias("n"))
    quiet = F.col("last_triggered_at").isNull() | (now - scores.seconds(F.col("last_triggered_at")) >= F.col("window_secs"))
    return counts.where((F.col("n") >= F.col("threshold")) & quiet).select(F.col("name").alias("rule"), "n")


def token_bucket(requests: DataFrame, by: str, time: str, capacity: float = 60, window: float = 60.0) -> DataFrame:
    """by, time, allowed: requests of each key in order against a bucket that refills evenly. A key's requests pass as a
    stream; only its bucket is held."""

    def step(state: tuple, t) -> tuple:
        tokens, last = state
        if last is not None:
            tokens = min(capacity, tokens + (t - last).total_seconds() * capacity / window)
        ok = tokens >= 1
        return (tokens - ok, t), (ok,)

    return ordered_fold(requests, by, time, {"allowed": T.BooleanType()}, lambda: (capacity, None), step)


def cooled_down(rows: DataFrame, by: str, time: str, seconds: float = 30.0) -> DataFrame:
    """by, time of the rows that come at least `seconds` after the last one of their key that was let through."""

    def step(last, t) -> tuple:
        ok = last == 0 or (t - last).total_seconds() >= seconds
        return (t, ()) if ok else (last, None)

    return ordered_fold(rows, by, time, {}, lambda: 0, step)
