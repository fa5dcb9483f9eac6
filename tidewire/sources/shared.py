"""The folder that driver and executors share: where lineage is cut, and where tables go that another job reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session without one gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut in the shared folder, so that numbers of partitions stay what they were."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def own_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
