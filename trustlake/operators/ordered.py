"""Computations along each key's order (_late, _us, event_ord), whatever share of the rows one key holds.

A key of at most BOUND rows is one chunk.  Hotter ones are dealt to chunks by ranges of (key, order), so a chunk has about BOUND rows
even where timestamps tie; a chunk's result is then completed by what the key's earlier chunks carry into it, a row a chunk.  event_ord
names a row: results that are computed on few columns are joined back by it, so wide rows are not moved per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .lineage import apart, cut, sized

ORDER = ("_late", "_us", "event_ord")
#: Rows of a key above which it is dealt to chunks.
BOUND = 2_000_000
_END = 1 << 62


def prepared(df: DataFrame) -> DataFrame:
    """df with the columns of the order: rows without a timestamp come last."""
    return df.withColumns({"_late": F.col("ts").isNull().cast("int"), "_us": F.unix_micros("ts")})


#: What hot_keys says of a key: found once, it serves all computations along it.
Hot = tuple[DataFrame | None, int]


def hot_keys(df: DataFrame, key: str, bound: int | None = None) -> Hot:
    """(the keys of more than bound rows, at most rows / bound of them, or None; how many chunks they get)."""
    bound = bound or BOUND
    hot = cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound))
    rows = hot.agg(F.sum("_n")).first()[0]
    return (sized(hot.select(key)), max(2, -(-2 * rows // bound))) if rows else (None, 0)


def chunked(df: DataFrame, key: str, known: Hot | None = None) -> tuple[DataFrame, bool]:
    """(df, prepared, with _chunk: 0, or from 1 on for the ranges of hot keys; whether there are any)."""
    hot, n = known or hot_keys(df, key)
    if hot is None:
        return df.withColumn("_chunk", F.lit(0)), False
    ranges = df.join(hot, key, "left_semi").repartitionByRange(n, key, *ORDER).withColumn("_chunk", F.spark_partition_id() + 1)
    return df.join(hot, key, "left_anti").withColumn("_chunk", F.lit(0)).unionByName(cut(ranges)), True


def along(key: str) -> WindowSpec:
    return Window.partitionBy(key, "_chunk").orderBy(*ORDER)


def carried(df: DataFrame, key: str, ends: dict[str, Column], before: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """df (chunked) with what comes before each chunk of a hot key: ends are aggregates of a chunk, before takes their columns over the
    key's earlier chunks.  Null for other rows and in a key's first chunk."""
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.filter("_chunk > 0").groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in ends.items()])  # a row a chunk
    return df.join(sized(cut(parts.select(key, "_chunk", *[f(earlier).alias(n) for n, f in before.items()]))), [key, "_chunk"], "left")


def running_sum(df: DataFrame, key: str, column: str, out: str, known: Hot | None = None) -> DataFrame:
    """df (prepared) with the sum of an integer column over the key's rows up to and with each row."""
    d, hot = chunked(df, key, known)
    total = F.sum(column).over(along(key).rowsBetween(Window.unboundedPreceding, 0))
    if hot:
        d = carried(d, key, {"_sum": F.sum(column)}, {"_sum": lambda w: F.sum("_sum").over(w)})
        total = total + F.coalesce("_sum", F.lit(0))
    return d.withColumn(out, total).drop("_chunk", "_sum")


def first_of(df: DataFrame, keys: tuple[str, ...], out: str) -> DataFrame:
    """df (prepared) with out: 1 in the first row of each combination of keys, else 0.  An aggregate with partial results finds it."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*ORDER)).alias("_f")).select(F.col("_f.event_ord").alias("event_ord"), F.lit(1).alias(out))
    return df.join(sized(cut(first)), "event_ord", "left").fillna(0, [out])


def sliding_counts(df: DataFrame, key: str, flags: dict[str, str], minutes: int, late_counts_all: bool = False, known: Hot | None = None) -> DataFrame:
    """df (prepared) with, for each (result, flag column of 0 and 1), how many rows of the key have the flag in the last `minutes`, up to
    and with this row in row order.  Rows without a timestamp count 0, or all before them.

    It is the running sum at the row less that before the window: a RANGE frame alone would also count later rows with the same time."""
    hot, n = known or hot_keys(df, key)
    cold = _window_counts(df if hot is None else df.join(hot, key, "left_anti"), key, flags, minutes)
    if hot is None:
        found = cold
    else:
        warm = df.join(hot, key, "left_semi")
        found = cold.unionByName(warm.join(apart(_prefix_counts(warm, key, flags, minutes, n)), "event_ord"))
    return found if late_counts_all else found.withColumns({out: F.when(F.col("_late") == 1, 0).otherwise(F.col(out)) for out in flags})


def _window_counts(df: DataFrame, key: str, flags: dict[str, str], minutes: int) -> DataFrame:
    d = df.withColumn("_at", F.coalesce("_us", F.lit(_END)))
    rows = Window.partitionBy(key).orderBy("_at", "event_ord").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, -(minutes * 60_000_000 + 1))
    gone = lambda flag: F.when(F.col("_late") == 1, F.lit(0)).otherwise(F.coalesce(F.sum(flag).over(before), F.lit(0)))
    return d.withColumns({out: F.sum(flag).over(rows) - gone(flag) for out, flag in flags.items()}).drop("_at")


def _prefix_counts(df: DataFrame, key: str, flags: dict[str, str], minutes: int, n: int) -> DataFrame:
    """event_ord and the counts, for hot keys: each row also probes the running sum where its window begins, so that any number of rows
    in a window costs the same; both kinds are dealt to ranges together, and one aggregate takes the difference."""
    own = df.select(key, F.coalesce("_us", F.lit(_END)).alias("_at"), F.lit(1).alias("_kind"), "event_ord", *[F.col(f).cast("long").alias(o) for o, f in flags.items()])
    probes = df.filter("_late = 0").select(key, (F.col("_us") - minutes * 60_000_000).alias("_at"), F.lit(0).alias("_kind"), "event_ord", *[F.lit(0).cast("long").alias(o) for o in flags])
    order = ("_at", "_kind", "event_ord")
    d = cut(own.unionByName(probes).repartitionByRange(2 * n, key, *order).withColumn("_chunk", F.spark_partition_id() + 1))
    upto = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = carried(d, key, {f"_before_{o}": F.sum(o) for o in flags}, {f"_before_{o}": lambda w, o=o: F.sum(f"_before_{o}").over(w) for o in flags})
    sign = F.when(F.col("_kind") == 1, 1).otherwise(-1)
    d = d.select("event_ord", *[(sign * (F.sum(o).over(upto) + F.coalesce(f"_before_{o}", F.lit(0)))).alias(o) for o in flags])
    return d.groupBy("event_ord").agg(*[F.sum(o).alias(o) for o in flags])


def ordinal(df: DataFrame, by: Column, order: tuple[str, ...], out: str, buckets: int = 256) -> DataFrame:
    """df with out: how many rows come before it in the order, whose first column is or goes along with the number `by` (nulls last).

    It is the row's place within a range of `by` plus the rows of the ranges below, so no window spans all rows."""
    edges = df.agg(F.percentile_approx(by, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("_edges"))  # one row
    part = F.when(by.isNull(), buckets).otherwise(F.size(F.filter("_edges", lambda e: e < by)))
    d = df.crossJoin(F.broadcast(edges)).withColumn("_part", part).drop("_edges")
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(F.collect_list(F.struct("_part", "n")).alias("_parts"))  # one row, an entry a range
    before = F.aggregate(F.filter("_parts", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return d.withColumn("_nth", nth).crossJoin(F.broadcast(parts)).withColumn(out, F.col("_nth") - 1 + before).drop("_part", "_parts", "_nth")


# Exponential means.  m <- (1 - alpha) m + alpha x is an affine map of m, and maps compose: a chunk is scanned into one map per row.


def compose(a: np.ndarray, b: np.ndarray) -> None:
    """In place: each map x -> a x + b after all maps before it, by doubling spans.  b may have several rows, for several constants."""
    step = 1
    while step < len(a) and a[step:].any():
        b[..., step:] += a[step:] * b[..., :-step]
        a[step:] *= a[:-step]
        step *= 2


class FoldScan:
    """Scans sorted batches of (key, chunk, value).  With c and w, the mean and variance carried into a row's run, the row's mean is
    a c + b and its variance g w + p + q c + r c^2; a, g, q and r are 0 where a run starts a key, as its first value is its first mean."""

    def __init__(self, alpha: float):
        self.alpha, self.keep = alpha, 1.0 - alpha
        self.last, self.state = None, None

    def batch(self, keys: pa.Array, chunks: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Rows a, b, g, p, q, r."""
        n, al, keep = len(x), self.alpha, self.keep
        starts = np.ones(n, bool)
        if n > 1:
            starts[1:] = np.asarray(pa.compute.not_equal(keys[1:], keys[:-1])) | (chunks[1:] != chunks[:-1])
        head = (keys[0].as_py(), int(chunks[0]))
        starts[0] = head != self.last
        opens = starts & (chunks == 0)
        a, b = np.where(opens, 0.0, keep), np.where(opens, x, al * x)
        # A run of a hot key's chunk starts anew with an unknown carry: nothing before it takes part.
        unknown = starts & (chunks > 0)
        if self.state is not None and not starts[0]:
            b[0] += a[0] * self.state[1]
            a[0] *= self.state[0]
        self._scan(a, b[None], unknown)
        d = x - b
        g, more = np.where(opens, 0.0, keep), np.stack([al * d * d, -2 * al * d * a, al * a * a])
        if self.state is not None and not starts[0]:
            more[:, 0] += g[0] * self.state[3:]
            g[0] *= self.state[2]
        self._scan(g, more, unknown)
        out = np.stack([a, b, g, *more])
        self.last, self.state = (keys[n - 1].as_py(), int(chunks[n - 1])), out[:, -1].copy()
        return out

    @staticmethod
    def _scan(a: np.ndarray, b: np.ndarray, unknown: np.ndarray) -> None:
        bounds = [0, *np.flatnonzero(unknown), len(a)]
        for i, j in zip(bounds, bounds[1:]):
            compose(a[i:j], b[:, i:j])


def exponential(df: DataFrame, key: str, value: str, alpha: float = 0.2, known: Hot | None = None) -> DataFrame:
    """event_ord, mean, variance of each row (prepared) whose value is no null: the exponential mean of the key's values up to the row,
    from the first value on, and that of the squared distances to it, from 0 on."""
    d, hot = chunked(df.select(key, *ORDER, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL"), key, known)
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = FoldScan(alpha)
        for batch in batches:
            if batch.num_rows:
                found = folds.batch(batch.column("_k"), batch.column("_chunk").to_numpy(), batch.column("_x").to_numpy())
                columns = [*batch.columns, *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *"abgpqr"])

    d = d.select(F.col(key).alias("_k"), "_chunk", *ORDER, "_x").repartition("_k", "_chunk").sortWithinPartitions("_k", "_chunk", *ORDER)
    d = d.mapInArrow(scan, f"_k {kind}, _chunk int, _late int, _us long, event_ord long, _x double, " + ", ".join(f"{c} double" for c in "abgpqr"))
    if not hot:
        return d.select("event_ord", F.col("b").alias("mean"), F.col("p").alias("variance"))
    d = cut(d)
    ends = d.filter("_chunk > 0").groupBy("_k", "_chunk").agg(F.max_by(F.struct(*"abgpqr"), F.struct(*ORDER)).alias("end"), F.min_by("_x", F.struct(*ORDER)).alias("first"))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        out, rows = [], rows.sort_values("_chunk")  # a row a chunk
        c, w = rows["first"].iloc[0], 0.0  # a mean before the first value that equals it gives the same first mean
        for r in rows.itertuples():
            out.append((r._1, r._2, c, w))
            a, b, g, p, q, s = (r.end[x] for x in "abgpqr")
            c, w = a * c + b, g * w + p + q * c + s * c * c
        return pd.DataFrame(out, columns=["_k", "_chunk", "c", "w"])

    into = sized(cut(ends.groupBy("_k").applyInPandas(carry, f"_k {kind}, _chunk int, c double, w double")))
    d = d.join(into, ["_k", "_chunk"], "left").fillna(0.0, ["c", "w"])
    return d.select("event_ord", F.expr("a * c + b").alias("mean"), F.expr("g * w + p + q * c + r * c * c").alias("variance"))
