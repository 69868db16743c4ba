"""Tables between steps: written once, so that a long analysis is neither planned nor run again for each use."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset, under the warehouse on a local
    master. A cluster without a shared folder is refused: its executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/_kindred-tables/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by sort and merge. Compressed files and derived texts look small to the planner, which
    would broadcast them through the driver and keep to that as they grow."""
    return df.hint("merge")
