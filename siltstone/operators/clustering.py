"""Clustering and deduplication by vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans(rows: DataFrame, k: int, vector: str = "embedding", seed: int = 1, rounds: int = 20) -> DataFrame:
    """rows with cluster, by the distributed k-means of MLlib with a fixed seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.where(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("__v")


def silhouette(clustered: DataFrame, vector: str = "embedding") -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = clustered.withColumn("__v", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    return ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(data)


def best_kmeans(rows: DataFrame, vector: str = "embedding", most: int | None = None) -> DataFrame:
    """rows clustered by the k from 2 to the root of their number (or `most`) with the best silhouette; fewer than ten rows
    are one cluster. Every k is tried over all rows."""
    n = rows.where(F.col(vector).isNotNull()).count()
    if n < 10:
        return rows.where(F.col(vector).isNotNull()).withColumn("cluster", F.lit(0))
    top = min(most or n, int(np.ceil(np.sqrt(n))))
    tried = {k: silhouette(kmeans(rows, k, vector), vector) for k in range(2, max(3, top + 1))}
    return kmeans(rows, max(tried, key=lambda k: (tried[k], -k)), vector)


def fold_clusters(vectors: np.ndarray, threshold: float) -> list[int]:
    """One pass: a vector joins the first cluster whose running mean has a cosine of the threshold at least, else opens one."""
    sums, counts, out = [], [], []
    for v in vectors:
        size = np.linalg.norm(v)
        for c, s in enumerate(sums):
            scale = np.linalg.norm(s) * size
            if scale > 0 and float(s @ v) / scale >= threshold:
                sums[c] = s + v
                counts[c] += 1
                out.append(c)
                break
        else:
            sums.append(v.astype(np.float64))
            counts.append(1)
            out.append(len(sums) - 1)
    return out


def greedy_clusters(rows: DataFrame, scope: str, order: list[str], key: str = "vec_id", vector: str = "embedding", threshold: float = 0.82, at_least: int = 3, most: int = 500) -> DataFrame:
    """scope, key, cluster of clusters with at_least members. Order decides, so each scope is folded as a whole; the first
    `most` of each scope take part, which is the operator's own limit and bounds its groups."""
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(*order)
    held = rows.where(F.col(vector).isNotNull()).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).select(scope, key, vector, "__rn")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        labels = fold_clusters(np.array(pdf[vector].tolist(), dtype=np.float64), threshold)
        return pdf.assign(cluster=labels)[[scope, key, "cluster"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    labelled = held.groupBy(scope).applyInPandas(run, f"{scope} {kinds[scope]}, {key} {kinds[key]}, cluster int")
    sizes = labelled.groupBy(scope, "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return labelled.join(sizes.select(scope, "cluster"), [scope, "cluster"])


def dedup_against(new: DataFrame, known: DataFrame, threshold: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Rows of new without a near match in known. new is a batch; known is scanned once."""
    from siltstone.operators.retrieval import knn

    near = knn(new, known, 1, key, vector, include_self=True).where(F.col("score") > threshold).select(F.col("query_id").alias(key))
    return new.join(near, key, "left_anti")
