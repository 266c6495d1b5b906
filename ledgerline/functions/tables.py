"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors, and show their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table at most this large, as written, may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it may be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ledgerline/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again."""
    path, schema = new_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._settled_path = path
    return out


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a settled table of a checked size; larger ones keep the shuffle join."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_path)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return F.broadcast(df) if fs.getContentSummary(path).getLength() <= limit else df
