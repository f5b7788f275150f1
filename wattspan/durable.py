"""Tables that cut lineage and outlive any executor.

Training reads one feature matrix several times and scoring runs Python
workers; both results are written once as Parquet to the shared folder named by
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and
not a recomputation, and later scans stay columnar.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: that of ``spark.checkpoint.dir`` or, where it is unset, of
    ``SparkContext.setCheckpointDir``. The library never picks a folder by itself."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/") + "/wattspan"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path as its own object."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder the library wrote; a missing one is no error."""
    system, where = file_system(spark, path)
    system.delete(where, True)
