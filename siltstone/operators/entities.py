"""Keyed tables: listings, upserts, supersession and other changes. A change gives the new state of a table as a DataFrame;
where rows are keyed, one shuffle by the key does it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.alike import alike_pairs, title_sets
from siltstone.plans.lineage import cut


def listed(rows: DataFrame, equal: dict[str, object] | None = None, tag: str | None = None, order: list[Column] | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """rows with the given values (a value of None asks for nothing), with a tag, in an order, a page of them."""
    out = rows
    for name, value in (equal or {}).items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if order:
        out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def by_ids(rows: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """rows of the listed ids; the list comes from the caller and is pushed into the scan."""
    return rows.where(F.col(key).isin(*ids)) if ids else rows.where(F.lit(False))


def in_range(rows: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Both ends included."""
    return rows.where(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def needing_embedding(rows: DataFrame, limit: int = 50) -> DataFrame:
    return rows.where("needs_embedding").orderBy("created_at", "id").limit(limit)


def mark_embedded(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    hit = done.select(key).distinct().withColumn("__done", F.lit(True))
    return rows.join(hit, key, "left").withColumn("needs_embedding", F.col("needs_embedding") & F.col("__done").isNull()).drop("__done")


def overlapping(rows: DataFrame, array: str, values: list[str]) -> DataFrame:
    """rows whose array shares a value; an empty list asks for nothing."""
    return rows.where(F.arrays_overlap(F.col(array), F.array(*map(F.lit, values)))) if values else rows


def cue_search(rows: DataFrame, cues: dict[str, list[str]], limit: int | None = None) -> DataFrame:
    """rows that share a value in each array that is asked for, newest first."""
    out = rows
    for array, values in cues.items():
        out = overlapping(out, array, values)
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def update_coalesce(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the values of changes where those aren't null; a changed row needs a new embedding."""
    named = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key), F.lit(True).alias("__hit"))
    out = rows.join(named, key, "left")
    out = out.withColumns({c: F.coalesce(f"__{c}", c) for c in changes.columns if c != key})
    if "needs_embedding" in rows.columns:
        out = out.withColumn("needs_embedding", F.col("needs_embedding") | F.col("__hit").isNotNull())
    return out.select(*rows.columns)


def upsert_memories(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """category, key, project_id, value, confirmations: a later value replaces an earlier one and adds a confirmation. A
    memory without project has its own key. incoming has a seq that orders its rows; equal keys are folded in one pass."""
    keys = ["category", "key", "project_id"]
    rows = state.select(*keys, "value", F.col("confirmations").cast("bigint").alias("c"), F.lit(-1).cast("bigint").alias("seq"))
    rows = rows.unionByName(incoming.select(*keys, "value", F.lit(1).cast("bigint").alias("c"), F.col("seq").cast("bigint").alias("seq")))
    return rows.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.sum("c").alias("confirmations"))


def upsert_edges(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """source, target, relation, weight, usage_count: an edge that comes again keeps the larger weight and counts a use."""
    rows = state.select("source", "target", "relation", "weight", "usage_count").unionByName(incoming.select("source", "target", "relation", "weight", F.lit(1).cast("bigint").alias("usage_count")))
    return rows.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"), F.sum("usage_count").alias("usage_count"))


def upsert_latest(state: DataFrame, incoming: DataFrame, keys: list[str], seq: str, *ties: str) -> DataFrame:
    """The latest row of each key, of equal ones that with the largest ties; keys that hold a null never meet, so all their
    rows stay."""
    from siltstone.operators.analytics import latest_per_key

    rows = state.unionByName(incoming)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return latest_per_key(rows.where(whole), keys, [F.desc(seq), *map(F.desc, ties)]).unionByName(rows.where(~whole))


def get_or_create(state: DataFrame, incoming: DataFrame, key: str = "name", fill: str = "path") -> DataFrame:
    """state with the new keys of incoming; a value that was missing is filled in, one that is there stays."""
    new = incoming.groupBy(key).agg(F.min(fill).alias("__fill"))
    return state.select(key, fill).join(new, key, "full").select(key, F.coalesce(fill, "__fill").alias(fill))


def delete_entities(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def delete_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges that touch none of the ids (column id)."""
    gone = ids.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")


def supersede(rows: DataFrame, replaced: DataFrame, as_of: str) -> DataFrame:
    """rows with old_id of replaced (old_id, new_id, reason) closed: superseded_by, valid_until and, where there is one, the reason."""
    pairs = replaced.groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("__new"), F.max("reason").alias("__reason"))
    out = rows.join(pairs, "id", "left").withColumn("superseded_by", F.coalesce("__new", "superseded_by"))
    out = out.withColumn("valid_until", F.when(F.col("__new").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("valid_until")))
    if "invalidation_reason" in rows.columns:
        out = out.withColumn("invalidation_reason", F.coalesce("__reason", "invalidation_reason"))
    return out.select(*rows.columns)


def is_stale(superseded_by: Column, valid_until: Column, as_of: str) -> Column:
    return superseded_by.isNotNull() | F.coalesce(F.lit(as_of).cast("timestamp") > valid_until, F.lit(False))


def orphan_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with an end that is no entity (column id). Both ends are looked up by key; the ids are shuffled once."""
    ids = entities.select("id").where("id is not null").distinct()
    lost_source = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return lost_source.unionByName(kept.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))


def entity_types(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """id, entity_type: the first of the tables, in their order, that has the id."""
    known = None
    for place, (name, table) in enumerate(tables.items()):
        each = table.select("id").distinct().select("id", F.lit(place).alias("place"), F.lit(name).alias("entity_type"))
        known = each if known is None else known.unionByName(each)
    return ids.select("id").distinct().join(known, "id").groupBy("id").agg(F.min_by("entity_type", "place").alias("entity_type"))


def click(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """searches with each click (entity) added to the newest search that showed the entity and hasn't it clicked yet."""
    rows = searches.select("id", "created_at", F.explode("result_ids").alias("entity"), "clicked_ids").where(~F.array_contains("clicked_ids", F.col("entity")))
    w = Window.partitionBy("entity").orderBy(F.desc("created_at"), F.desc("id"))
    newest = rows.join(clicks.select("entity").distinct(), "entity", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    more = newest.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("__more"))
    out = searches.join(more, "id", "left")
    return out.withColumn("clicked_ids", F.when(F.col("__more").isNull(), F.col("clicked_ids")).otherwise(F.concat("clicked_ids", "__more"))).drop("__more")


def children_of(rows: DataFrame, parents: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """rows whose parent is still there: what a cascading delete leaves."""
    return rows.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def similar_titles(rows: DataFrame, title: str, threshold: float, limit: int = 5) -> DataFrame:
    """id, title, similarity of the titles most alike one title, above the threshold."""
    from siltstone.functions.text import trigram_similarity

    out = rows.select("id", "title", trigram_similarity(F.col("title"), F.lit(title)).alias("similarity")).where(F.col("similarity") > threshold)
    return out.orderBy(F.desc("similarity"), "id").limit(limit)


def promotable(rows: DataFrame, threshold: float = 0.4, min_projects: int = 2) -> DataFrame:
    """id, projects: records whose title, by its trigrams, is like that of records of at least min_projects projects in all.
    Of records with the same title each is like the others, even where it has no trigrams."""
    base = rows.where("project_id is not null and title is not null").select("id", "project_id", F.lower("title").alias("t"))
    held = title_sets(base.select("t").distinct())
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = alike_pairs(held, None, threshold).select(F.explode(both).alias("x")).select("x.a", "x.b")
    projects = cut(base.select("t", "project_id").distinct().join(held.select("n", "t"), "t", "left"))
    near = pairs.join(projects.select(F.col("n").alias("b"), "project_id"), "b").select(F.col("a").alias("n"), "project_id")
    near = near.distinct().join(held.select("n", "t"), "n").select("t", "project_id")
    reach = near.unionByName(projects.select("t", "project_id")).groupBy("t").agg(F.count_distinct("project_id").alias("projects")).where(F.col("projects") >= min_projects)
    return base.join(reach, "t").select("id", "projects").distinct()
