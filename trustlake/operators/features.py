"""Ordered per-key features.  Order is (ts, event_ord) everywhere, so results do not depend on partitioning or input order.

Keys that are null are grouped as 'unknown'; rows without a timestamp come last and have no window features.  Each key's features are
computed on the columns that they need and joined to the events by event_ord, so wide rows are shuffled once for all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .lineage import apart
from .ordered import Hot, along, carried, chunked, exponential, first_of, hot_keys, prepared, running_sum, sliding_counts


def _slim(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return prepared(df.select("event_ord", "ts", F.coalesce(key, F.lit("unknown")).alias(key), *columns))


def _joined(df: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda d, p: d.join(apart(p), "event_ord", "left"), parts, df)


def _geo(df: DataFrame, minutes: int, known: Hot) -> DataFrame:
    d, hot = chunked(_slim(df, "principal_id", "geo"), "principal_id", known)
    w = along("principal_id")
    last, before = F.lag("geo").over(w), F.last("_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if hot:
        ends = {"_geo": F.max_by("geo", F.struct("_late", "_us", "event_ord")), "_until": F.max("_us")}
        d = carried(d, "principal_id", ends, {"_geo": lambda w: F.last("_geo").over(w), "_until": lambda w: F.max("_until").over(w)})
        last, before = F.when(F.row_number().over(w) == 1, F.col("_geo")).otherwise(last), F.coalesce(before, F.col("_until"))
    d = d.withColumns({"_last": last, "_before": before}).withColumn("f_geo_switch", F.when(F.col("_last") != F.col("geo"), 1).otherwise(0))
    fast = (F.col("f_geo_switch") == 1) & (F.col("_us") - F.col("_before") <= minutes * 60_000_000)
    return d.select("event_ord", "f_geo_switch", F.when(fast, 1).otherwise(0).alias("f_fast_geo_switch"))


def _drift(df: DataFrame, alpha: float, known: Hot) -> DataFrame:
    return exponential(_slim(df, "device_id", "posture_score"), "device_id", "posture_score", alpha, known).select("event_ord", F.col("mean").alias("_posture_mean"))


def _with_drift(df: DataFrame) -> DataFrame:
    return df.withColumn("f_posture_drift", F.abs(F.col("posture_score") - F.col("_posture_mean"))).drop("_posture_mean")


def _spike(df: DataFrame, alpha: float, known: Hot) -> DataFrame:
    found = exponential(_slim(df, "principal_id", "bytes_out"), "principal_id", "bytes_out", alpha, known)
    return found.select("event_ord", F.col("mean").alias("_bytes_mean"), F.col("variance").alias("_bytes_var"))


def _with_spike(df: DataFrame) -> DataFrame:
    score = (F.col("bytes_out") - F.col("_bytes_mean")) / (F.sqrt(F.greatest(F.col("_bytes_var"), F.lit(0.0))) + 1e-6)
    return df.withColumn("f_bytes_spike_score", score).drop("_bytes_mean", "_bytes_var")


def _hops(df: DataFrame, known: Hot) -> DataFrame:
    d = first_of(_slim(df, "session_id", F.coalesce("cloud_provider", F.lit("unknown")).alias("cloud_provider")), ("session_id", "cloud_provider"), "_first")
    return running_sum(d, "session_id", "_first", "_clouds", known).select("event_ord", (F.col("_clouds") - 1).alias("g_cross_cloud_hops_session"))


def _new_resource(df: DataFrame, minutes: int, known: Hot) -> DataFrame:
    real = ~F.lower(F.coalesce("resource_id", F.lit(""))).isin("", "nan", "none", "unknown")
    d = first_of(_slim(df, "principal_id", "resource_id"), ("principal_id", "resource_id"), "_first")
    d = d.withColumn("g_is_new_resource_edge", F.when(real & (F.col("_first") == 1), 1).otherwise(0))
    d = sliding_counts(d, "principal_id", {"g_new_resource_count_win": "g_is_new_resource_edge"}, minutes, known=known)
    rate = F.col("g_new_resource_count_win") / F.lit(float(max(1, minutes)))
    return d.select("event_ord", "g_is_new_resource_edge", "g_new_resource_count_win", rate.alias("g_new_resource_rate_win"))


def _hot(df: DataFrame, key: str, bound: int | None) -> Hot:
    return hot_keys(df.select(F.coalesce(key, F.lit("unknown")).alias(key)), key, bound)


def geo_features(df: DataFrame, minutes: int = 60, bound: int | None = None) -> DataFrame:
    """f_geo_switch: the principal's geo differs from its last one; f_fast_geo_switch: and its last timestamp is at most `minutes` old."""
    return _joined(df, _geo(df, minutes, _hot(df, "principal_id", bound)))


def posture_drift(df: DataFrame, alpha: float = 0.2, bound: int | None = None) -> DataFrame:
    """f_posture_drift: distance of the posture to the device's exponential mean, which holds it already; null without a posture."""
    return _with_drift(_joined(df, _drift(df, alpha, _hot(df, "device_id", bound))))


def bytes_spike(df: DataFrame, alpha: float = 0.2, bound: int | None = None) -> DataFrame:
    """f_bytes_spike_score: bytes less the principal's exponential mean, over the root of the exponential variance (from 0); null without
    bytes."""
    return _with_spike(_joined(df, _spike(df, alpha, _hot(df, "principal_id", bound))))


def session_hops(df: DataFrame, bound: int | None = None) -> DataFrame:
    """g_cross_cloud_hops_session: distinct clouds of the session so far, less one."""
    return _joined(df, _hops(df, _hot(df, "session_id", bound)))


def new_resource(df: DataFrame, minutes: int = 30, bound: int | None = None) -> DataFrame:
    """g_is_new_resource_edge: the principal's first touch of a resource; g_new_resource_count_win: such touches in the last `minutes`;
    g_new_resource_rate_win: per minute."""
    return _joined(df, _new_resource(df, minutes, _hot(df, "principal_id", bound)))


def row_features(df: DataFrame) -> DataFrame:
    denied = F.when(F.col("access_result") == "deny", 1.0).otherwise(0.0)
    failed = F.coalesce(F.col("raw_login_failures_5m").try_cast("double"), denied) if "raw_login_failures_5m" in df.columns else denied
    return df.withColumns({
        "f_token_scope_width": S.scope_width(F.col("token_scope")), "f_bytes_out_log1p": F.log1p("bytes_out"), "f_is_privileged_role": S.is_privileged(F.col("role")),
        "f_token_age": S.number(F.col("token_age")), "f_failed_logins_5m": failed,
    })


def feature_table(df: DataFrame, graph: DataFrame | None = None, minutes: int = 30, alpha: float = 0.2, bound: int | None = None) -> DataFrame:
    """df with all f_* and g_* columns; graph: principal_id, g_shortest_to_sensitive_hops, g_blast_radius_sensitive_k."""
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("principal_id", "device_id", "session_id", "cloud_provider")})
    own, device, session = (_hot(df, c, bound) for c in ("principal_id", "device_id", "session_id"))
    parts = [_geo(df, 60, own), _spike(df, alpha, own), _new_resource(df, minutes, own), _drift(df, alpha, device), _hops(df, session)]
    out = _with_spike(_with_drift(_joined(row_features(df), *parts)))
    missing: dict[str, Column] = {"g_shortest_to_sensitive_hops": F.lit(-1), "g_blast_radius_sensitive_k": F.lit(0)}
    if graph is None:
        return out.withColumns(missing)
    return out.join(graph, "principal_id", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in missing.items()})
