"""A tree of clusters over records with vectors: leaves are records, parents are clusters with a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.clustering import best_kmeans

FLAT_BELOW = 10


def build(items: DataFrame, tree_id: str, most_clusters: int | None = None) -> DataFrame:
    """tree_id, id, level, parent_id, entity_type, entity_id, summary, children_count of items (entity_type, entity_id, title,
    embedding). Fewer than ten items have no parents. A parent's summary is that of its smallest titles; a model may write it anew."""
    flat = items.where("embedding is not null").count() < FLAT_BELOW
    rows = items.where("embedding is not null").withColumn("cluster", F.lit(None).cast("int")) if flat else best_kmeans(items, most=most_clusters)
    parent = F.when(F.col("cluster").isNotNull(), F.concat(F.lit(f"{tree_id}/"), F.col("cluster").cast("string")))
    leaves = rows.select(
        F.lit(tree_id).alias("tree_id"), F.concat_ws(":", "entity_type", "entity_id").alias("id"), F.lit(0).alias("level"), parent.alias("parent_id"),
        "entity_type", F.col("entity_id").cast("string").alias("entity_id"), F.lit(None).cast("string").alias("summary"), F.lit(0).cast("bigint").alias("children_count"),
    )
    if flat:
        return leaves
    first = rows.groupBy("cluster").agg(F.min("title").alias("a"), F.max("title").alias("b"), F.count("*").alias("n"))
    parents = first.select(
        F.lit(tree_id).alias("tree_id"), F.concat(F.lit(f"{tree_id}/"), F.col("cluster").cast("string")).alias("id"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"),
        F.lit("raptor_node").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), F.concat_ws("; ", "a", "b").alias("summary"), F.col("n").alias("children_count"),
    )
    return leaves.unionByName(parents)


def expand(hits: DataFrame, tree: DataFrame, limit: int) -> DataFrame:
    """entity_type, entity_id, rank of the leaves under hits (id, rank), each by its first hit; a hit leaf stands for itself."""
    below = tree.select("id", "parent_id", "entity_type", "entity_id", "level")
    own = hits.join(below.where("level = 0"), "id").select("entity_type", "entity_id", "rank")
    under = hits.join(below.where("level = 0").select(F.col("parent_id").alias("id"), "entity_type", "entity_id"), "id").select("entity_type", "entity_id", "rank")
    best = own.unionByName(under).groupBy("entity_type", "entity_id").agg(F.min("rank").alias("rank"))
    return best.orderBy("rank", "entity_type", "entity_id").limit(limit)
