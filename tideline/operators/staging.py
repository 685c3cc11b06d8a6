"""Written stages: a result that several branches of a plan use is computed once and read back from shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder of our own will do in local mode, as in tests; on a cluster, whose machines could not see it, RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tideline-stages-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back. It cuts the lineage: a lost executor costs what comes after the stage."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared storage through Hadoop's file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_stages(spark: SparkSession) -> None:
    """Deletes all stages of this application; results that still read them are gone with them. To be called when a job's output is written."""
    drop_folder(spark, shared_folder(spark))
