"""Relational analytics: aggregations over activity, searches, sessions, logs and runs.

Every operator takes and gives DataFrames, aggregates before it shuffles wherever the aggregate allows it, and breaks ties
so that results are the same on every run. Null keys form no group unless said otherwise; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Items of a group that meet in one cell.
GROUP_BLOCK = 256


def since(column: Column, as_of: str, days: float, inclusive: bool = False) -> Column:
    """Whether a time lies in the last `days` days before as_of."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    return column >= start if inclusive else column > start


def hot_items(rows: DataFrame, item: str, group: str, added: str, removed: str, limit: int | None = 20) -> DataFrame:
    """item, groups (distinct), added, removed, churn: what changes in most groups, then most."""
    out = rows.where(F.col(item).isNotNull()).groupBy(item).agg(
        F.count_distinct(group).alias("groups"),
        F.sum(F.coalesce(F.col(added), F.lit(0))).alias("added"), F.sum(F.coalesce(F.col(removed), F.lit(0))).alias("removed"),
    )
    out = out.withColumn("churn", F.col("added") + F.col("removed"))
    return out if limit is None else out.orderBy(F.desc("groups"), F.desc("churn"), item).limit(limit)


def coupled_items(rows: DataFrame, item: str, group: str, min_together: int = 3, limit: int | None = None) -> DataFrame:
    """item_a < item_b, together, ratio (together by groups of item_a): items that share at least min_together groups.
    Items of fewer groups can't be in a pair and leave before pairs are formed. A group of many items is cut into blocks of
    GROUP_BLOCK by hash, and each pair of blocks is a cell of its own, so that no task holds the pairs of a large group."""
    members = rows.where(F.col(item).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    totals = members.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)
    kept = members.join(totals.select("i"), "i", "left_semi")
    blocks = kept.groupBy("g").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = kept.join(blocks, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "i", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a = cells.select("g", "lo", "hi", F.col("i").alias("item_a"), F.col("own").alias("own_a"))
    b = cells.select("g", "lo", "hi", F.col("i").alias("item_b"), F.col("own").alias("own_b"))
    once = (F.least("own_a", "own_b") == F.col("lo")) & (F.greatest("own_a", "own_b") == F.col("hi"))
    pairs = a.join(b, ["g", "lo", "hi"]).where((F.col("item_a") < F.col("item_b")) & once).groupBy("item_a", "item_b").agg(F.count("*").alias("together")).where(F.col("together") >= min_together)
    out = pairs.join(totals.withColumnRenamed("i", "item_a"), "item_a").select("item_a", "item_b", "together", (F.col("together") / F.col("n")).alias("ratio"))
    return out if limit is None else out.orderBy(F.desc("together"), F.desc("ratio"), "item_a", "item_b").limit(limit)


def ctr_feedback(searches: DataFrame) -> DataFrame:
    """entity, shown, clicked, boost of a search log (result_ids, clicked_ids): how often each result shown was clicked,
    1 at most. Clicks on what was never shown don't count."""
    shown = searches.select(F.explode("result_ids").alias("entity")).groupBy("entity").agg(F.count("*").alias("shown"))
    clicked = searches.select(F.explode("clicked_ids").alias("entity")).groupBy("entity").agg(F.count("*").alias("clicked"))
    joined = shown.join(clicked, "entity", "left").withColumn("clicked", F.coalesce("clicked", F.lit(0)))
    return joined.withColumn("boost", F.least(F.col("clicked") / F.col("shown"), F.lit(1.0)))


def apply_feedback(items: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    """items with the boost of feedback where there is one, their own otherwise."""
    rates = feedback.select(F.col("entity").alias(key), F.col("boost").alias("__boost"))
    return items.join(rates, key, "left").withColumn("feedback_boost", F.coalesce(F.col("__boost").cast("float"), F.col("feedback_boost"))).drop("__boost")


def search_totals(searches: DataFrame) -> DataFrame:
    """One row: searches, with_clicks, click_rate, avg_results. Searches without results don't count in the average."""
    clicked = F.size("clicked_ids") > 0
    return searches.agg(
        F.count("*").alias("searches"), F.count_if(clicked).alias("with_clicks"),
        (F.count_if(clicked) / F.nullif(F.count("*"), F.lit(0))).alias("click_rate"), F.avg(F.nullif(F.size("result_ids"), F.lit(0))).alias("avg_results"),
    )


def searches_by_type(searches: DataFrame) -> DataFrame:
    return searches.groupBy(F.coalesce("query_type", F.lit("unknown")).alias("query_type")).agg(F.count("*").alias("searches"), F.count_if(F.size("clicked_ids") > 0).alias("with_clicks"))


def top_queries(searches: DataFrame, limit: int = 10) -> DataFrame:
    return searches.groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "query").limit(limit)


def signal_clicks(searches: DataFrame) -> DataFrame:
    """signal, clicks, share: which signals had brought the results that were clicked; a result of two signals counts for both."""
    hits = searches.select("signal_sources", F.explode("clicked_ids").alias("entity")).select(F.explode(F.element_at("signal_sources", F.col("entity"))).alias("signal"))
    counts = hits.groupBy("signal").agg(F.count("*").alias("clicks"))
    return counts.withColumn("share", F.col("clicks") / F.sum("clicks").over(Window.partitionBy(F.lit(0))))


def signal_ctr(searches: DataFrame, as_of: str, days: float = 7) -> DataFrame:
    """query_type, signal, samples, shows, clicks, ctr over the attributed results of searches of the last `days` days that
    have a type, an attribution and a click; samples are the searches of the type. A click on what the attribution doesn't
    list credits no signal."""
    clicked = F.col("query_type").isNotNull() & (F.size("signal_sources") > 0) & (F.size("clicked_ids") > 0)
    used = searches.where(clicked & since(F.col("created_at"), as_of, days)).select("query_type", "clicked_ids", "signal_sources")
    samples = used.groupBy("query_type").agg(F.count("*").alias("samples"))
    rows = used.select("query_type", "clicked_ids", F.explode("signal_sources").alias("entity", "signals"))
    again = F.size(F.filter("clicked_ids", lambda c: c == F.col("entity"))).cast("bigint")
    each = rows.select("query_type", F.explode("signals").alias("signal"), again.alias("hits"))
    counts = each.groupBy("query_type", "signal").agg(F.count("*").alias("shows"), F.sum("hits").alias("clicks"))
    return counts.join(samples, "query_type").select("query_type", "signal", "samples", "shows", "clicks", (F.col("clicks") / F.col("shows")).alias("ctr"))


def knowledge_gaps(searches: DataFrame, at_least: int = 2, limit: int = 10) -> DataFrame:
    """query, searches: what is searched repeatedly and never clicked."""
    grouped = searches.groupBy("query").agg(F.count("*").alias("searches"), F.sum(F.size("clicked_ids")).alias("clicks"))
    return grouped.where((F.col("searches") >= at_least) & (F.col("clicks") == 0)).orderBy(F.desc("searches"), "query").limit(limit).select("query", "searches")


def score_trends(rows: DataFrame, time: str, scores: list[str]) -> DataFrame:
    """day, n and the average of each score a day, by day."""
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"), *(F.avg(s).alias(f"avg_{s}") for s in scores))


def learning_analytics(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row over the learning_runs of the last `days` days: extraction and duplicate rates, totals by kind and averages; 0
    where there are no runs. A run with a null count has no extraction rate and a duplicate rate of 0."""
    kinds = ("patterns", "episodes", "procedures", "memories")
    extracted = sum((F.col(f"{k}_extracted") for k in kinds[1:]), F.col(f"{kinds[0]}_extracted"))
    seen = extracted + F.col("duplicates_skipped")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return runs.where(since(F.col("created_at"), as_of, days, inclusive=True)).agg(
        F.count("*").alias("runs"), zero(F.avg(extracted)).alias("avg_extracted"),
        zero(F.avg(F.when(seen > 0, F.col("duplicates_skipped") / seen).otherwise(0.0))).alias("avg_duplicate_rate"),
        *(F.coalesce(F.sum(f"{k}_extracted"), F.lit(0)).alias(k) for k in kinds),
        zero(F.avg("duration_ms")).alias("avg_duration_ms"), zero(F.avg("chunks_processed")).alias("avg_chunks"),
    )


def context_usage(injections: DataFrame) -> DataFrame:
    """One row over context injections: how much of what was injected was referred to, as a ratio of averages."""
    return injections.agg(
        F.count("*").alias("injections"), F.avg(F.nullif(F.size("injected_entity_ids"), F.lit(0))).alias("avg_injected"),
        F.avg(F.nullif(F.size("referenced_entity_ids"), F.lit(0))).alias("avg_referenced"),
    ).withColumn("usage_rate", F.coalesce(F.col("avg_referenced") / F.col("avg_injected"), F.lit(0.0)))


def top_elements(rows: DataFrame, array: str, limit: int = 10) -> DataFrame:
    """element, n: the most frequent elements of an array column."""
    return rows.select(F.explode(array).alias("element")).groupBy("element").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "element").limit(limit)


def topic_health(items: DataFrame, as_of: str, limit: int = 1000) -> DataFrame:
    """topic, items, freshness, confidence, stale, overall, worst first: the topic is the first tag, else the kind. Of the
    `limit` latest updated items those that aren't superseded count; freshness goes by the whole days since the last access,
    or since creation where there was none."""
    current = items.orderBy(F.desc("updated_at"), "id", F.desc("access_count")).limit(limit).where(F.col("superseded_by").isNull())
    last = F.coalesce("last_accessed_at", "created_at")
    days = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last)) / F.lit(86_400_000_000))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    confidence = unit(F.log1p(F.col("access_count").cast("double")) / 5 + F.coalesce(F.col("feedback_boost").cast("double"), F.lit(0.0)))
    rows = current.select(F.coalesce(F.try_element_at("tags", F.lit(1)), "kind").alias("topic"), unit(1 - days / 30.0).alias("f"), confidence.alias("c"), (F.col("utility_score") < 0.3).alias("s"))
    out = rows.groupBy("topic").agg(F.count("*").alias("items"), F.avg("f").alias("freshness"), F.avg("c").alias("confidence"), F.count_if("s").alias("stale"))
    overall = 0.4 * F.col("freshness") + 0.4 * F.col("confidence") + 0.2 * (1 - F.col("stale") / F.col("items"))
    return out.withColumn("overall", overall).orderBy("overall", "topic")


def project_health(projects: DataFrame, items: DataFrame, procedures: DataFrame, episodes: DataFrame, memories: DataFrame, searches: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """project_id, dimension, score, status, overall: six scores of each project (column id) and their mean. freshness: the
    share of current items accessed in 30 days, 0 without items; procedures: the average success of current procedures used
    three times, 1 without any; episodes: those of 7 days by 3; memories: all by 5; search: the share of the searches of 7 days
    with a click, 1 without searches; learning: the runs of 7 days by 2, whatever their project. A score of 0.7 is healthy, one
    of 0.4 a warning, less is critical."""
    of = lambda rows: rows.where("project_id is not null").groupBy("project_id")
    week = since(F.col("created_at"), as_of, 7)
    fresh = of(items.where("superseded_by is null")).agg((F.count_if(since(F.col("last_accessed_at"), as_of, 30)) / F.count("*")).alias("freshness"))
    success = of(procedures.where("superseded_by is null and times_used >= 3")).agg(F.avg("success_rate").alias("procedures"))
    told = of(episodes.where(week)).agg((F.count("*") / 3.0).alias("episodes"))
    known = of(memories).agg((F.count("*") / 5.0).alias("memories"))
    found = of(searches.where(week)).agg((F.count_if(F.size("clicked_ids") > 0) / F.count("*")).alias("search"))
    learnt = runs.where(week).agg((F.count("*") / 2.0).alias("learning"))
    out = projects.select(F.col("id").alias("project_id")).distinct()
    for part in (fresh, success, told, known, found):
        out = out.join(part, "project_id", "left")
    out = out.crossJoin(F.broadcast(learnt))  # a single row
    absent = {"freshness": 0.0, "procedures": 1.0, "episodes": 0.0, "memories": 0.0, "search": 1.0, "learning": 0.0}
    unit = lambda c, none: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(none))))
    out = out.withColumns({c: unit(F.col(c), none) for c, none in absent.items()})
    out = out.withColumn("overall", sum((F.col(c) for c in absent), F.lit(0.0)) / len(absent))
    each = out.select("project_id", "overall", F.explode(F.create_map(*(x for c in absent for x in (F.lit(c), F.col(c))))).alias("dimension", "score"))
    status = F.when(F.col("score") >= 0.7, "healthy").when(F.col("score") >= 0.4, "warning").otherwise("critical")
    return each.select("project_id", "dimension", "score", status.alias("status"), "overall")


def tag_counts(*tables: DataFrame) -> DataFrame:
    """tag, n over the tags of several tables, most frequent first."""
    tags = None
    for t in tables:
        each = t.select(F.explode("tags").alias("tag"))
        tags = each if tags is None else tags.unionByName(each)
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def rename_tag(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with one tag renamed; a record that has both keeps the first."""
    renamed = F.array_distinct(F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t)))
    return rows.withColumn("tags", F.when(F.array_contains("tags", old), renamed).otherwise(F.col("tags")))


def merge_tags(rows: DataFrame, sources: list[str], target: str) -> DataFrame:
    merged = F.array_distinct(F.transform("tags", lambda t: F.when(t.isin(*sources), F.lit(target)).otherwise(t)))
    return rows.withColumn("tags", F.when(F.arrays_overlap("tags", F.array(*map(F.lit, sources))), merged).otherwise(F.col("tags")))


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def logs_matching(logs: DataFrame, level: str | None = None, target: str | None = None, pattern: str | None = None) -> DataFrame:
    """Logs of a level, of targets with a prefix, with messages that match a pattern; what isn't given isn't asked for."""
    out = logs if level is None else logs.where(F.col("level") == level)
    out = out if target is None else out.where(F.col("target").startswith(target))
    return out if pattern is None else out.where(F.col("message").rlike(pattern))


def error_groups(logs: DataFrame) -> DataFrame:
    """fingerprint, title, target, event_count, first_seen, last_seen of warnings and errors. Every log counts once, however
    often it is looked at."""
    from siltstone.functions.text import fingerprint

    bad = logs.where(F.upper("level").isin("ERROR", "WARN")).withColumn("fingerprint", fingerprint(F.col("target"), F.col("message")))
    return bad.groupBy("fingerprint").agg(
        F.left(F.min("message"), F.lit(200)).alias("title"), F.min("target").alias("target"), F.count("*").alias("event_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def prunable(rows: DataFrame, as_of: str, utility: float = 0.1, days: int = 30) -> DataFrame:
    """rows (utility_score, created_at) that a clean-up takes: of little utility and created more than `days` days ago."""
    return rows.where((F.col("utility_score") < utility) & ~since(F.col("created_at"), as_of, days, inclusive=True))


def retention_preview(tables: dict[str, DataFrame], searches: DataFrame, as_of: str) -> DataFrame:
    """candidate, n: how many rows of each table a clean-up would prune, and how many searches older than 30 days."""
    out = searches.where(~since(F.col("created_at"), as_of, 30, inclusive=True)).agg(F.count("*").alias("n")).select(F.lit("search_queries").alias("candidate"), "n")
    for name, rows in tables.items():
        out = out.unionByName(prunable(rows, as_of).agg(F.count("*").alias("n")).select(F.lit(name).alias("candidate"), "n"))
    return out


def retention_run(tables: dict[str, DataFrame], searches: DataFrame, edges: DataFrame, as_of: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables, searches, edges) after a clean-up: what prunable lists is gone, searches of 30 days are kept, and edges with
    an end (source, target) that is in none of the tables (column id) any longer go too. Rows with null scores or times stay."""
    old = lambda c: F.coalesce(~since(F.col(c), as_of, 30, inclusive=True), F.lit(False))
    kept = {name: rows.where(~(F.coalesce(F.col("utility_score") < 0.1, F.lit(False)) & old("created_at"))) for name, rows in tables.items()}
    ids = None
    for rows in kept.values():
        each = rows.select("id")
        ids = each if ids is None else ids.unionByName(each)
    ids = ids.where("id is not null").distinct()
    both = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, searches.where(~old("created_at")), both.select(*edges.columns)


def log_retention(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """logs of the last `days` days; those without a time go."""
    return logs.where(since(F.col("timestamp"), as_of, days, inclusive=True))


def ngrams(rows: DataFrame, by: list[str], order: list[str], item: str, sizes: tuple[int, ...] = (3, 4, 5), at_least: int = 2) -> DataFrame:
    """gram, size, n: runs of items in a row, within the groups of `by` in the order of `order`, that occur repeatedly.
    Leads over a sorted group need only the longest run in memory."""
    w = Window.partitionBy(*by).orderBy(*order)
    wide = rows.select(*[F.lead(item, k).over(w).alias(f"x{k}") for k in range(max(sizes))])
    grams = F.array(*[F.when(F.col(f"x{s - 1}").isNotNull(), F.concat_ws(" ", *[f"x{k}" for k in range(s)])) for s in sizes])
    each = wide.select(F.posexplode(grams).alias("i", "gram")).where("gram is not null").select("gram", F.element_at(F.array(*map(F.lit, sizes)), F.col("i") + 1).alias("size"))
    return each.groupBy("gram", "size").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def consecutive_pairs(rows: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """by, source, target: each item and the next of its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.select(*by, F.col(item).alias("source"), F.lead(item).over(w).alias("target")).where("target is not null")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. The rank stops early: no group is held, and hot keys are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
