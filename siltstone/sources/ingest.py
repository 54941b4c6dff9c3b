"""Taking in pages and commits that were fetched elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_private_url
from siltstone.sources.html import pages_to_markdown

#: Bytes of a page that are read, and that must come out of it.
MOST_BYTES, LEAST_BYTES = 500 * 1024, 100


def pages(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """url, title, content of fetched pages (url, html) over http or https from public hosts, whose url isn't known (source_url)
    yet; of a url that comes twice, one page. Larger pages and those that say too little drop out."""
    fit = fetched.where(F.col("url").rlike("^https?://") & ~is_private_url(F.col("url")) & (F.octet_length("html") <= MOST_BYTES))
    new = fit.groupBy("url").agg(F.min("html").alias("html")).join(known.select(F.col("source_url").alias("url")).where("url is not null").distinct(), "url", "left_anti")
    return pages_to_markdown(new, "url", "html").where(F.octet_length("markdown") >= LEAST_BYTES).select("url", "title", F.col("markdown").alias("content"))


def commits(incoming: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(activity, episodes) of incoming commits (commit_hash, commit_message, files: array of change_type, file_path) that aren't
    known by their hash: a row for each file, and an episode for each commit."""
    from siltstone.functions.text import classify_severity

    new = incoming.join(known.select("commit_hash").distinct(), "commit_hash", "left_anti").dropDuplicates(["commit_hash"])
    activity = new.select("commit_hash", "commit_message", F.explode("files").alias("f")).select("commit_hash", "commit_message", "f.change_type", "f.file_path")
    episodes = new.select("commit_hash", F.col("commit_message").alias("title"), F.lit("git_commit").alias("kind"), classify_severity(F.col("commit_message")).alias("severity"), F.transform("files", lambda f: f["file_path"]).alias("related_files"))
    return activity, episodes


def store_vectors(points: DataFrame, path: str) -> None:
    """Writes the latest vector of each entity (entity_type, entity_id, embedding, updated_at), by type."""
    from siltstone.operators.analytics import latest_per_key

    latest_per_key(points, ["entity_type", "entity_id"], [F.desc("updated_at")]).write.mode("overwrite").partitionBy("entity_type").parquet(path)
