"""Learning from transcripts: chunks, extraction, gates, deduplication, new records and their edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as X
from siltstone.operators.alike import alike_pairs, title_sets
from siltstone.operators.chunking import chunk_transcript
from siltstone.operators.models import keyword_extractor
from siltstone.plans.lineage import cut

#: Records of each kind that a transcript may give, and bytes of it that are read.
MOST = {"patterns": 8, "episodes": 8, "procedures": 4, "memories": 8}
MOST_ENTITIES = 20
READ_BYTES = 512 * 1024


def extracted(transcripts: DataFrame, key: str, text: str, extractor: Callable[[str], dict] = keyword_extractor) -> DataFrame:
    """key, kind, pos, content: what the extractor finds in each chunk, in order. The extractor runs on the workers."""
    schema = T.StructType([transcripts.select(key).schema[0], T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                pos = 0
                for chunk in chunk_transcript(t.encode("utf-8", "replace")[:READ_BYTES].decode("utf-8", "ignore")):
                    for kind, found in extractor(chunk).items():
                        for content in found:
                            rows.append((k, kind, pos, content))
                            pos += 1
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=schema.names)

    return transcripts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, schema)


def capped(found: DataFrame, key: str) -> DataFrame:
    """The first records of each kind a transcript may give."""
    limits = F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv])
    w = Window.partitionBy(key, "kind").orderBy("pos")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.coalesce(limits[F.col("kind")], F.lit(0))).drop("__n")


def gated(found: DataFrame) -> DataFrame:
    """Records that say enough: memories ten bytes, others fifty."""
    least = F.when(F.col("kind") == "memories", 10).otherwise(50)
    return found.where(F.octet_length(F.trim("content")) >= least)


def deduplicated(found: DataFrame, key: str) -> DataFrame:
    """Records of a transcript whose words, in order, didn't come before in it and kind."""
    words = F.sha2(F.array_join(F.filter(F.split(F.lower("content"), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), " "), 256)
    w = Window.partitionBy(key, "kind", "__h").orderBy("pos")
    return found.withColumn("__h", words).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__h", "__n")


def learn(transcripts: DataFrame, key: str = "session_id", text: str = "transcript") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, edges, runs) of transcripts: records key, kind, pos, content, domain, id; edges from records to their session
    and from each episode to the next (led_to); one run for each transcript with its counts, skipped duplicates included."""
    found = cut(gated(capped(extracted(transcripts, key, text), key)))
    records = cut(deduplicated(found, key).withColumn("domain", X.detect_domain(F.col("content"))).withColumn("id", F.left(F.sha2(F.concat_ws("|", key, "kind", F.col("pos").cast("string")), 256), F.lit(16))))
    produced = records.select(F.col("id").alias("source"), F.col(key).cast("string").alias("target"), F.lit("produced_by").alias("relation"), F.lit(1.0).alias("weight"))
    w = Window.partitionBy(key).orderBy("pos")
    steps = records.where("kind = 'episodes'").select(F.col("id").alias("source"), F.lead("id").over(w).alias("target"), F.lit("led_to").alias("relation"), F.lit(1.0).alias("weight")).where("target is not null")
    kept = records.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_extracted") for k in MOST))
    runs = found.groupBy(key).agg(F.count("*").alias("__all")).join(kept, key, "left")
    total = sum((F.col(f"{k}_extracted") for k in MOST), F.lit(0))
    return records, produced.unionByName(steps), runs.withColumn("duplicates_skipped", F.col("__all") - total).drop("__all")


def alike_titles(new: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of all titles of new and known (column t) whose trigrams have a Jaccard similarity above the threshold."""
    fresh, held = (title_sets(x.select("t").distinct()) for x in (new, known))
    named = lambda sets, name, of: sets.select(F.col("n").alias(name), F.col("t").alias(of))
    pairs = alike_pairs(fresh, held, threshold).withColumnsRenamed({"a": "na", "b": "nb"})
    return pairs.join(named(fresh, "na", "a"), "na").join(named(held, "nb", "b"), "nb").select("a", "b", "similarity")


def contradictions(new: DataFrame, known: DataFrame, judge: Callable[[DataFrame], DataFrame], threshold: float = 0.4, sure: float = 0.8) -> DataFrame:
    """old_id, new_id of known records (id, title) that a new one (id, title) contradicts: of all known titles, the most alike
    above the threshold goes to the judge, who adds a confidence; of equals, that of the smallest id. Of each new title the two
    best known records are kept, since only one of them can be the new record itself."""
    fresh = new.select(F.col("id").alias("new_id"), F.col("title").alias("new_title"), F.lower("title").alias("a"))
    held = known.groupBy(F.lower("title").alias("b"), F.col("id").alias("old_id")).agg(F.min("title").alias("old_title"))
    two = held.withColumn("__n", F.row_number().over(Window.partitionBy("b").orderBy("old_id"))).where("__n <= 2").drop("__n")
    pairs = alike_titles(fresh.select(F.col("a").alias("t")), held.select(F.col("b").alias("t")), threshold).join(two, "b")
    pairs = pairs.groupBy("a", "old_id").agg(F.max(F.struct("similarity", "old_title")).alias("m")).select("a", "old_id", "m.*")
    near = Window.partitionBy("a").orderBy(F.desc("similarity"), "old_id")
    near = pairs.withColumn("__n", F.row_number().over(near)).where("__n <= 2").drop("__n")
    rows = fresh.join(near, "a").where("new_id <> old_id").select("new_id", "old_id", "new_title", "old_title", "similarity")
    best = Window.partitionBy("new_id").orderBy(F.desc("similarity"), "old_id", "new_title")
    top = rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return judge(top).where(F.col("confidence") >= sure).select("old_id", "new_id")
