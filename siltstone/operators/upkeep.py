"""Upkeep of the knowledge base: embeddings that are due, duplicates, consolidation of clusters, promotion to all projects, and
what is learned of tools and outcomes. Models are plug-in functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import clustering, entities, graph
from siltstone.operators.alike import alike_elsewhere
from siltstone.operators.learning import alike_titles
from siltstone.plans.lineage import cut

MOST_PROCEDURES, MOST_SEQUENCES = 50, 5
STATE_BYTES = 32_000


def backfill(rows: DataFrame, embed: Callable[[Column], Column], text: Column, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(vectors, rows): the first `limit` rows that need an embedding get one (id, embedding), and are marked; a row whose text
    gives no vector stays due."""
    due = cut(entities.needing_embedding(rows, limit).select("id", embed(text).alias("embedding")))
    done = due.where("embedding is not null")
    return done, entities.mark_embedded(rows, done)


def unseen(new: DataFrame, known: DataFrame, titles: float = 0.4, cosine: float = 0.85) -> DataFrame:
    """new records (id, session_id, pos, title, embedding) that duplicate nothing: no known title (title, embedding) is like
    theirs by trigrams, no known vector is near theirs, and in their session no record before them that was kept is. A session
    gives some thirty records at most, so each is folded as a whole; records without a vector are compared by title only."""
    low = new.withColumn("t", F.lower("title"))
    alike = alike_titles(low.select("t"), known.select(F.lower("title").alias("t")), titles).select(F.col("a").alias("t")).distinct()
    fresh = cut(low.join(alike, "t", "left_anti").drop("t"))
    # Every block of new vectors reads all known ones, which a model may have to make: they are made once.
    numbered = cut(known.select(F.concat(F.lit("known-"), F.monotonically_increasing_id().cast("string")).alias("id"), "embedding"))
    far = cut(clustering.dedup_against(fresh, numbered, cosine))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, ids = [], []
        for row in pdf.sort_values(["pos", "id"]).itertuples():
            if row.embedding is not None:
                v = np.asarray(row.embedding, dtype=np.float64)
                size = np.linalg.norm(v)
                if size and any(len(k) == len(v) and float(k @ v) / size > cosine for k in kept):
                    continue
                if size:
                    kept.append(v / size)
            ids.append(row.id)
        return pd.DataFrame({"id": pd.Series(ids, dtype=object)})

    first = far.select("id", "session_id", "pos", "embedding").groupBy("session_id").applyInPandas(fold, "id string")
    return far.join(first, "id", "left_semi")


def first_of_cluster(members: DataFrame) -> DataFrame:
    """A stand-in for a model that merges: title of the smallest id, contents of all members, each once, in the order of ids."""
    held = F.array_sort(F.collect_list(F.struct("id", "title", "content")))
    rows = members.groupBy("project_id", "cluster").agg(held.alias("m"))
    return rows.select("project_id", "cluster", F.element_at("m", 1)["title"].alias("title"), F.array_join(F.array_distinct(F.transform("m", lambda x: x["content"])), "\n\n").alias("content"))


def consolidate(items: DataFrame, edges: DataFrame, merge: Callable[[DataFrame], DataFrame] = first_of_cluster, threshold: float = 0.82) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, replaced, edges) of items (id, title, content, project_id, superseded_by, updated_at, embedding): of each project,
    and of the items without one, the latest 500 are clustered greedily; a cluster of three at least becomes a new item (id,
    project_id, title, content), its members (old_id, new_id, reason) are superseded and their edges go over to it."""
    scoped = items.where("superseded_by is null").withColumn("scope", F.coalesce("project_id", F.lit("\x00")))
    scoped = scoped.withColumn("age", -F.unix_micros("updated_at"))
    labels = cut(clustering.greedy_clusters(scoped, "scope", ["age", "id"], key="id", threshold=threshold))
    members = cut(scoped.join(labels, ["scope", "id"]))
    own = F.left(F.sha2(F.concat_ws("|", F.lit("merged"), F.coalesce("project_id", F.lit("")), F.col("cluster").cast("string")), 256), F.lit(26))
    merged = merge(members).withColumn("id", own)
    named = F.left(F.sha2(F.concat_ws("|", F.lit("merged"), F.coalesce("project_id", F.lit("")), F.col("cluster").cast("string")), 256), F.lit(26))
    replaced = members.select(F.col("id").alias("old_id"), named.alias("new_id"), F.lit("consolidated").alias("reason"))
    return merged.select("id", "project_id", "title", "content"), replaced, graph.transfer_edges(edges, replaced)


def promote(items: DataFrame, title_like: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(copies, edges): of the items (id, title, content, project_id) whose title has its like in two projects at least, a copy
    that belongs to all (id, title, content, kind), one for each title, and a derived_from edge to each item it stands for."""
    rows = items.where("project_id is not null and title is not null").withColumn("t", F.lower("title"))
    projects = rows.groupBy("t").agg(F.min("project_id").alias("p"), F.max("project_id").alias("q"))
    titles = cut(projects.select("t", F.when(F.col("p") == F.col("q"), F.col("p")).alias("owner")))
    ready = titles.where("owner is null").select("t").unionByName(alike_elsewhere(titles, title_like))
    rows = rows.join(cut(ready), "t", "left_semi")
    new_id = F.left(F.sha2(F.concat(F.lit("global|"), F.col("t")), 256), F.lit(26))
    # Contents are apart from titles, so that they aren't read where nobody asks for them.
    first = F.min(F.struct("id", "title"))["title"].alias("title"), F.min_by("content", F.struct("id", "title", "content")).alias("content")
    copies = rows.groupBy("t").agg(*first).select(new_id.alias("id"), "title", "content", F.lit("pattern").alias("kind"))
    edges = rows.select(new_id.alias("source"), F.col("id").alias("target"), F.lit("derived_from").alias("relation"), F.lit(1.0).alias("weight")).distinct()
    return copies, edges


def tool_sequences(calls: DataFrame, key: str, sizes: tuple[int, ...] = (3, 4, 5), at_least: int = 2) -> DataFrame:
    """key, title, content, steps, n of the runs of tools (key, pos, tool) that a transcript repeats, the five most frequent of
    each, of equal ones the longest, then by name."""
    w = Window.partitionBy(key).orderBy("pos")
    wide = calls.select(key, F.array(*[F.lead("tool", k).over(w) for k in range(max(sizes))]).alias("x"))
    grams = F.array(*[F.slice("x", 1, s) for s in sizes])
    each = wide.select(key, F.explode(grams).alias("steps")).where(F.forall("steps", lambda t: t.isNotNull()))
    counts = each.groupBy(key, "steps").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    first = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.size("steps")), F.array_join("steps", "\x1f"))
    top = counts.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= MOST_SEQUENCES)
    named = F.array_join("steps", " → ")
    content = F.concat(F.lit("Sequence of "), F.size("steps").cast("string"), F.lit(" tools used "), F.col("n").cast("string"), F.lit(" times: "), named)
    return top.select(key, F.concat(F.lit("Tool sequence: "), named).alias("title"), content.alias("content"), "steps", "n")


def valid_outcomes(reported: DataFrame, procedures: DataFrame, project: str) -> DataFrame:
    """reported (id, success) of procedures that the model was shown: the latest fifty of the project. Others it made up."""
    shown = procedures.where(F.col("project_id") == project).orderBy(F.desc("updated_at"), "id").limit(MOST_PROCEDURES)
    return reported.join(shown.select("id"), "id", "left_semi")


def entity_edges(found: DataFrame, kinds: tuple[str, ...], most: int = 20) -> DataFrame:
    """source, target, target_type, relation, weight of what a session mentions (session_id, pos, name, entity_type): the first
    `most` of a session, of known types and with a name."""
    w = Window.partitionBy("session_id").orderBy("pos")
    first = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    good = first.where(F.col("entity_type").isin(*kinds) & (F.trim("name") != ""))
    return good.select(F.col("session_id").alias("source"), F.col("name").alias("target"), F.col("entity_type").alias("target_type"), F.lit("mentions").alias("relation"), F.lit(1.0).alias("weight")).distinct()


def last_part(text: Column, most_bytes: int = STATE_BYTES) -> Column:
    """The last bytes of a transcript, from a whole character on: what the state of a session is drawn from."""
    raw = F.encode(text, "UTF-8")
    out = F.lit(None).cast("string")
    for less in (3, 2, 1, 0):
        part = F.substring(raw, F.octet_length(text) - (most_bytes - less) + 1, F.lit(most_bytes))
        out = F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")).otherwise(out)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(out)
