from time import sleep

from pyspark.sql import functions as F

from siltstone.queries.inputs import logs
from siltstone.sources.tables import table
from siltstone.streaming import jobs
from tests.conftest import SMALL


def replay(spark, tmp_path, df, name, files=4):
    """The rows of df as a stream of files that are written one after the other, in the order of time."""
    src = str(tmp_path / name)
    time = "timestamp" if "timestamp" in df.columns else "ts"
    second = F.unix_micros(time)
    ends = df.agg(F.percentile(second, [k / files for k in range(1, files)]).alias("q")).first()["q"]
    part = sum((F.when(second > F.lit(int(e)), 1).otherwise(0) for e in ends), F.lit(0))
    for k in range(files):
        df.where(part == k).coalesce(1).write.mode("append").parquet(src)
        sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_windows_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = logs(spark, SMALL).where("level <> 'INFO'")
    flush = spark.createDataFrame([("ERROR", "flush", "end")], "level string, target string, message string").select(F.lit("2030-01-01").cast("timestamp").alias("timestamp"), "level", "target", "message")
    got = drained(jobs.error_windows(replay(spark, tmp_path, rows.unionByName(flush), "logs"), late="40 days", length="1 day"), tmp_path, "windows")
    want = jobs.error_windows(rows, length="1 day")
    assert got.where("target <> 'flush'").exceptAll(want).count() == 0 and want.exceptAll(got.where("target <> 'flush'")).count() == 0


def test_rate_limit_of_a_stream(spark, tmp_path):
    from siltstone.operators.lifecycle import token_bucket

    rows = table(spark, SMALL, "events").select("user_id", "ts")
    got = drained(jobs.rate_limited(replay(spark, tmp_path, rows, "requests"), "user_id", "ts", 3, 86400.0, idle="40 days"), tmp_path, "limited")
    want = token_bucket(rows, "user_id", "ts", 3, 86400.0)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_cooldown_of_a_stream(spark, tmp_path):
    from siltstone.operators.lifecycle import cooled_down

    rows = table(spark, SMALL, "events").select("user_id", "ts")
    got = drained(jobs.cooled_down(replay(spark, tmp_path, rows, "seen"), "user_id", "ts", 43200.0, idle="40 days"), tmp_path, "cooled")
    want = cooled_down(rows, "user_id", "ts", 43200.0)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_sessions_of_a_stream(spark, tmp_path):
    rows = table(spark, SMALL, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts")
    flush = spark.range(1).select(F.lit("flush").alias("session_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"))
    stream = replay(spark, tmp_path, rows.unionByName(flush), "queue").withColumnRenamed("ts", "queued_at")
    got = drained(jobs.debounced_sessions(stream, "1 day", "40 days"), tmp_path, "sessions").where("session_id <> 'flush'")
    want = jobs.debounced_sessions(rows.withColumnRenamed("ts", "queued_at"), "1 day")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_log_sink_is_idempotent(spark, tmp_path):
    stream = replay(spark, tmp_path, logs(spark, SMALL), "tolog")
    q = jobs.sink_logs(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == logs(spark, SMALL).count()
