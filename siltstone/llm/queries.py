"""The training-data queries, each over the whole of its tables. SQL that DuckDB can run in reasonable time is in sql.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import conversations, cooccurrence, near_duplicates, packing, personal_data, splitting, tokenizing, truncation
from siltstone.plans.lineage import ensure_checkpoint_dir
from siltstone.sources.tables import table

MIN_COUNT, MIN_LIFT = 4, 3


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.left_out(table(spark, sf_dir, "session_messages"))


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_turns(table(spark, sf_dir, "session_messages"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.record_texts(table(spark, sf_dir, "knowledge_items"), table(spark, sf_dir, "procedures"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(_records(spark, sf_dir)).withColumnRenamed("kind", "entity_type")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates.similar_classes(_records(spark, sf_dir))
    ends = links.select("kind", F.col("class_a").alias("class_id")).unionByName(links.select("kind", F.col("class_b").alias("class_id")))
    counts = ends.groupBy("kind", "class_id").agg(F.count("*").alias("links"))
    return members.join(counts, ["kind", "class_id"], "left").select(F.col("kind").alias("entity_type"), "id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_and_miscounted(table(spark, sf_dir, "learning_queue"), table(spark, sf_dir, "learning_runs"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "learning_queue"), "transcript", ["id"])


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transcript put together again from its pieces, by its digest, and whether they fit and overlap."""
    out = splitting.rebuilt(p3_pieces(spark, sf_dir), ["id"])
    return out.select("id", "n_chars", "fits", "overlaps", F.md5("text").alias("md5"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.col("item_a").alias("file_a"), F.col("item_b").alias("file_b"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.record_texts(table(spark, sf_dir, "learning_queue"), table(spark, sf_dir, "session_messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found_types(_texts(spark, sf_dir), table(spark, sf_dir, "name_roster"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redacted(_texts(spark, sf_dir), table(spark, sf_dir, "name_roster"))


def _history(spark: SparkSession, sf_dir: str, until: str) -> tuple[DataFrame, DataFrame]:
    """The commits seen until a time, and all of every commit that got rows since, as a change."""
    rows = table(spark, sf_dir, "git_activity")
    early = F.coalesce(F.col("created_at") < F.lit(until).cast("timestamp"), F.lit(False))
    late = cooccurrence.commit_baskets(rows.where(~early)).select("basket").distinct()
    return cooccurrence.commit_baskets(rows.where(early)), cooccurrence.commit_baskets(rows).join(late, "basket", "left_semi")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits up to December make the table, those since are merged into it."""
    old, changed = _history(spark, sf_dir, "2025-12-01")
    state = cooccurrence.update(cooccurrence.empty(spark, MIN_COUNT, MIN_LIFT), old)
    return _pairs(cooccurrence.associations(cooccurrence.update(state, changed)))


def p5_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, but the table of April is saved in the shared folder, and the update is one of the saved table."""
    old, changed = _history(spark, sf_dir, "2025-04-01")
    folder = f"{ensure_checkpoint_dir(spark)}/pairs-{uuid.uuid4().hex}"
    cooccurrence.save(cooccurrence.update(cooccurrence.empty(spark, MIN_COUNT, MIN_LIFT), old), folder)
    return _pairs(cooccurrence.associations(cooccurrence.update_saved(spark, folder, changed)))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.token_ids(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack(tokenizing.token_counts(documents), items_known=documents.count())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_off(table(spark, sf_dir, "documents"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.source_shares(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_turns, p2_found, p2_classes, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_redacted, p5_found, p5_update, p6_ids, p7_containers, p8_found, p8_sources)
}
