"""Cutting lineage in iterative plans, so that a lost executor costs a re-read and not a recomputation of every round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One is set only where none is and the master is local, as in tests;
    a machine-local folder on a cluster would lose the files along with the machine, hence the error there."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint of df."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
