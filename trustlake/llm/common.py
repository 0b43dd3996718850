"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Sides of a join up to this many bytes (as counted by `sized`) are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one, in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors.  The shuffle files of
    what is written go when the driver collects its garbage, which is asked for here, so that they don't add up over the stages."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads again."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a broadcast table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes_of(x, kind.elementType)), F.lit(8).cast("long"))
        return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("long") * 8 + 16
    return F.lit(8).cast("long")


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """table (staged, so counting is cheap) marked for broadcast if all its values take at most limit bytes, unmarked (shuffle join)
    beyond."""
    row = sum((_bytes_of(F.col(f.name), f.dataType) for f in table.schema.fields), F.lit(16).cast("long"))
    total = table.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(table) if total <= limit else table


def whole_text(column="text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs less columns named like those that an operator adds: the operator's own replace them."""
    return docs.drop(*[c for c in docs.columns if c.lower() in names])


def sampled(rows: DataFrame, by: str, n: int, salt: int) -> DataFrame:
    """by, text, h, copies: for each value of column `by` the n distinct texts (column text, no nulls) with the smallest hashes h, whatever
    number of rows (copies) each has.  Only hashes are shuffled before the texts are fetched."""
    hashed = rows.select(F.col(by).alias("by"), "text", F.xxhash64("text", F.lit(salt)).alias("h"))
    nth = F.row_number().over(Window.partitionBy("by").orderBy("h"))
    least = staged(hashed.groupBy("by", "h").agg(F.count(F.lit(1)).alias("copies")).withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth"))
    return hashed.join(sized(least), ["by", "h"]).groupBy("by", "h").agg(F.min("text").alias("text"), F.first("copies").alias("copies"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all strings of a column without nulls, one after another; where each begins, and their end), uncopied."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, held = column.buffers()
    bounds = np.frombuffer(places, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def give_back() -> None:
    """Free memory goes back to the system, as Python workers are used again by other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows at most, so that a task's Python objects are of few texts at a time; at the end, free
    memory is given back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    give_back()
