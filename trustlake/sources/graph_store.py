"""Graph tables kept in versions: a commit rewrites only the buckets that it touches, and readers follow a pointer.

A table is dealt to buckets by a hash of its key.  Commit v writes its buckets to <table>/v<v>/bucket=<k> and then the pointer
pointer/v<v>, a table of (table, bucket, version) for all buckets.  The pointer counts once its _SUCCESS is there, so a reader sees all
of a commit or nothing, and a commit that is run again replaces what it wrote before.  Versions that neither the newest pointer nor the
one before it names are removed after a commit; a reader that is two commits late reads again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns that a table's rows are merged by.
KEYS = {"nodes": ("node_id",), "edges": ("src_id", "edge_type", "dst_id", "cloud_provider")}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets: fixed for the life of a store; a bucket's rows are read and written by one commit."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def _children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(path))] if self._exists(path) else []

    def versions(self) -> list[int]:
        """The commits that are complete, oldest first."""
        return sorted(int(n[1:]) for n in self._children(f"{self.path}/pointer") if n.startswith("v") and self._exists(f"{self.path}/pointer/{n}/_SUCCESS"))

    def _pointer(self, below: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> version, as of the newest commit (before commit `below`)."""
        known = [v for v in self.versions() if below is None or v < below]
        if not known:
            return {}
        return {(r["table"], r["bucket"]): r["version"] for r in self.spark.read.parquet(f"{self.path}/pointer/v{known[-1]}").collect()}  # a row a bucket

    def _read(self, table: str, pointer: dict[tuple[str, int], int], buckets: set[int] | None = None) -> DataFrame | None:
        parts = [f"{self.path}/{table}/v{v}/bucket={k}" for (t, k), v in sorted(pointer.items()) if t == table and (buckets is None or k in buckets)]
        return self.spark.read.parquet(*parts) if parts else None

    def read(self, table: str) -> DataFrame | None:
        """The newest version of a table, or None if it was never written."""
        return self._read(table, self._pointer())

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], merge: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None, version: int | None = None) -> int:
        """Merges rows into the tables (without merge: replaces them) as commit `version` (by default the next one)."""
        version = version if version is not None else (self.versions() or [-1])[-1] + 1
        pointer = self._pointer(version)
        for table, rows in tables.items():
            fresh = f"{self.path}/{table}/v{version}-new"
            rows.withColumn("bucket", self._bucket(table)).write.mode("overwrite").partitionBy("bucket").parquet(fresh)
            touched = {int(n.split("=")[1]) for n in self._children(fresh) if n.startswith("bucket=")}
            new = self.spark.read.schema(rows.schema).parquet(*[f"{fresh}/bucket={k}" for k in sorted(touched)]) if touched else None
            old = self._read(table, pointer, touched) if merge else None
            if new is not None:
                whole = merge[table](old.select(*rows.columns), new) if old is not None else new
                whole.withColumn("bucket", self._bucket(table)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/v{version}")
            if not merge:
                pointer = {at: v for at, v in pointer.items() if at[0] != table}
            pointer |= {(table, k): version for k in touched}
            self._fs.delete(self._at(fresh), True)
        rows = self.spark.createDataFrame([(t, k, v) for (t, k), v in pointer.items()], "table string, bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pointer/v{version}")
        self._clear()
        return version

    def _clear(self) -> None:
        """Removes what neither of the two newest commits names."""
        keep = self.versions()[-2:]
        named = {(r["table"], r["version"], r["bucket"]) for v in keep for r in self.spark.read.parquet(f"{self.path}/pointer/v{v}").collect()}
        for table in KEYS:
            for v in [n for n in self._children(f"{self.path}/{table}") if n.startswith("v") and n[1:].isdigit() and int(n[1:]) <= keep[-1]]:
                buckets = [n for n in self._children(f"{self.path}/{table}/{v}") if n.startswith("bucket=")]
                gone = [n for n in buckets if (table, int(v[1:]), int(n.split("=")[1])) not in named]
                for n in gone if len(gone) < len(buckets) else [""]:
                    self._fs.delete(self._at(f"{self.path}/{table}/{v}/{n}".rstrip("/")), True)
        for n in self._children(f"{self.path}/pointer"):
            if n.startswith("v") and n[1:].isdigit() and int(n[1:]) < keep[0]:
                self._fs.delete(self._at(f"{self.path}/pointer/{n}"), True)


def write_graph(spark: SparkSession, tables: dict[str, DataFrame], path: str, buckets: int = 64) -> int:
    """nodes and edges as a new version of the store under path; the number of the commit."""
    return GraphStore(spark, path, buckets).commit(tables)


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    store = GraphStore(spark, path)
    return {t: d for t in KEYS if (d := store.read(t)) is not None}
