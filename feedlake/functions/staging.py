"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without that setting (tests) gets a
    temporary one; on a cluster a missing setting is an error, because executors can't see each other's disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="feedlake-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, for what is read more than once; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
