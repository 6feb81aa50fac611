"""Stage tables: results that later steps read more than once.

A stage is written to the shared folder named by spark.checkpoint.dir and read back.
That cuts the lineage, survives the loss of executors and keeps the plans small.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from hybridq.session import checkpoint_root


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; Spark creates it when something is written there."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more, through Spark's file systems."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = checkpoint_root(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(conf).delete(path, True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file systems; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that are no longer referenced.

    The cleaner follows the driver's garbage collection, which may come late in a long job.
    """
    gc.collect()
    spark._jvm.System.gc()
