"""Cutting lineage between the rounds of an iteration and where a plan is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Sides of a join up to this many bytes (as counted by `sized`) are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where that is unset, a new one, in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: what reads it prunes columns and knows its size, and executors
    may be lost.  The table stays until the folder is cleared, as the result is lazy."""
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a broadcast table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * (32 if isinstance(kind.elementType, (T.StringType, T.StructType)) else 8) + 16
    return F.lit(16)


def apart(table: DataFrame) -> DataFrame:
    """table marked for a sort-merge join, for sides that may have as many rows as the events.  Unmarked ones are broadcast by Spark if the
    size of their files, by the share of the columns that are read, looks small: packed columns of millions of rows do."""
    return table.hint("merge")


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """table (cut, so counting is cheap) marked for broadcast if its values take at most limit bytes, apart beyond."""
    row = sum((_width(f.name, f.dataType) for f in table.schema.fields), F.lit(16)).cast("long")
    return F.broadcast(table) if (table.agg(F.sum(row)).first()[0] or 0) <= limit else apart(table)
