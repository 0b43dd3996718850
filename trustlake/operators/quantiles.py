"""Exact quantiles, of a whole column or per group, without gathering values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut, sized


def _matches(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_{c}"]) for c in by], F.lit(True))


def quantiles(df: DataFrame, value: Column, shares: tuple[float, ...], by: tuple[str, ...] = (), buckets: int = 256) -> DataFrame:
    """q (and by): the quantiles of value (nulls are left out) at the shares, linear between order statistics; a row a group that has
    values, or, without by, one row, null if there are none.

    The column is written once and read from there.  Values are dealt to ranges by approximate edges of their group; within a range, a
    running sum over the distinct values gives their ordinals, and the counts of whole ranges below are added.  Only the order statistics
    that are asked for are picked, so a group's values are in as many tasks as it has ranges."""
    own = cut(df.select(*by, value.cast("double").alias("v")).filter("v IS NOT NULL"))
    marks = F.percentile_approx("v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("_edges")
    edges = own.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(marks)
    edges = sized(cut(edges)) if by else F.broadcast(edges)  # one row
    dealt = own.join(edges, _matches(own, edges, by)) if by else own.crossJoin(edges)
    held = cut(dealt.select(*by, "v", F.size(F.filter("_edges", lambda e: e < F.col("v"))).alias("r")).groupBy(*by, "r", "v").agg(F.count(F.lit(1)).alias("n")))
    sums = held.groupBy(*by, "r").agg(F.sum("n").alias("m")).groupBy(*[F.col(c).alias(f"_{c}") for c in by])
    whole = sums.agg(F.collect_list(F.struct("r", "m")).alias("all"), F.sum("m").alias("total"))  # an entry a range
    whole = sized(cut(whole)) if by else F.broadcast(whole)  # one row
    before = F.aggregate(F.filter("all", lambda s: s["r"] < F.col("r")), F.lit(0).cast("long"), lambda a, s: a + s["m"])
    upto = F.sum("n").over(Window.partitionBy(*by, "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = held.withColumn("upto", upto)
    ranked = ranked.join(whole, _matches(ranked, whole, by)) if by else ranked.crossJoin(whole)
    ranked = ranked.select(*by, "v", (F.col("upto") + before).alias("upto"), "total")
    at = lambda p: F.lit(p) * (F.col("total") - 1)
    found = ranked.groupBy(*by).agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("upto") > F.floor(at(p)), F.col("v"))).alias(f"low{i}") for i, p in enumerate(shares)],
        *[F.min(F.when(F.col("upto") > F.ceil(at(p)), F.col("v"))).alias(f"high{i}") for i, p in enumerate(shares)],
    )
    part = lambda p: at(p) - F.floor(at(p))
    return found.select(*by, F.array(*[(1 - part(p)) * F.col(f"low{i}") + part(p) * F.col(f"high{i}") for i, p in enumerate(shares)]).alias("q"))


def with_quantiles(stats: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """stats (a row a group) with q of its group, null where it has no values."""
    if not by:
        return stats.crossJoin(F.broadcast(found))  # one row each
    named = found.withColumnsRenamed({c: f"_{c}" for c in by})
    return stats.join(named, _matches(stats, named, by), "left").drop(*[f"_{c}" for c in by])
