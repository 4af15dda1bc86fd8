"""Tables for the length of a session, in a folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the warehouse where that is unset; a cluster whose warehouse is a local folder has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root


def shared_place(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder; deleted when the driver ends."""
    path = f"{shared_root(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """The frame written and read back: what is read several times is computed once, and losing an executor loses none of it."""
    path = shared_place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._place = path
    return table


def released(*tables: DataFrame) -> None:
    """Deletes tables that settled() returned and nothing reads any more. Shuffle files of finished queries go too: Spark
    removes them when the driver collects garbage, which a driver with little to do might not for hours."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._place)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()
