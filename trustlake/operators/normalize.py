"""Raw access logs to one telemetry schema: every column by the first source that is present, with a default otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalars as S
from .lineage import cut
from .quantiles import quantiles

#: The columns of unified telemetry, in order.
UNIFIED = (
    "ts principal_id principal_type role mfa_used action api operation resource_id resource_type resource_sensitivity cloud_provider tenant_id region ip geo "
    "device_id posture_score workload_id session_id token_id token_scope token_age access_result latency_ms bytes_out label_attack attack_type"
).split()
#: Source columns that are passed on as raw_*.
RAW = (
    "login_failures_5m api_calls_5m time_anomaly privilege_escalation prev_cloud cross_cloud_hop device_os auth_method risk_truth device_compliance "
    "login_success_count anomaly_score user_agent country cloud_account access_granted"
).split()


def normalize(df: DataFrame) -> DataFrame:
    """The unified columns, event_ord, and raw_* columns.  Which source a column has is decided on the names when the plan is built."""
    has = set(df.columns)

    def source(*names: str, default: str | None = "unknown") -> Column:
        found = next((n for n in names if n in has), None)
        value = F.col(found).cast("string") if found else F.lit(None).cast("string")
        return value if default is None else F.coalesce(value, F.lit(default))

    ts = S.parse_timestamp(F.col("ts" if "ts" in has else "timestamp")) if has & {"ts", "timestamp"} else F.lit(None).cast("timestamp")
    cloud, principal, session = S.known(source("cloud_provider", "cloud", default=None)), source("principal_id", "user_id"), source("session_id")
    action = S.known(source("action", default=None))
    kind = source("resource_type")
    nbytes = S.number(source("bytes_out", default=None))
    posture = S.posture(source("posture_score", "device_compliance", default=None))
    if "access_result" in has:
        result = S.known(source("access_result", default=None))
    elif "access_granted" in has:
        result = F.when(F.col("access_granted").try_cast("int") == 1, "permit").otherwise("deny")
    else:
        result = F.lit("unknown")
    label = F.coalesce(source("label_attack", "label_malicious", default=None).try_cast("int"), F.lit(0))
    latency = S.number(F.col("latency_ms").cast("string")) if "latency_ms" in has else S.derived_latency(ts, nbytes, principal, action)
    columns = {
        "ts": ts, "principal_id": principal, "principal_type": source("principal_type", default="user"), "role": source("role"),
        "mfa_used": S.to_bool01(source("mfa_used", default=None)), "action": action,
        "api": source("api", default=None) if "api" in has else F.lower(F.concat_ws(":", kind, action)),
        "operation": S.known(source("operation", default=None)) if "operation" in has else action,
        "resource_id": source("resource_id"), "resource_type": kind, "resource_sensitivity": source("resource_sensitivity"), "cloud_provider": cloud,
        "tenant_id": source("tenant_id", "cloud_account", "tenant"), "region": source("region"),
        "ip": source("ip") if "ip" in has else S.synthetic_ipv4(principal, cloud, session), "geo": source("geo", "country"), "device_id": source("device_id"),
        "posture_score": posture, "workload_id": source("workload_id") if "workload_id" in has else S.workload_id(principal, cloud), "session_id": session,
        "token_id": source("token_id") if "token_id" in has else S.token_id(principal, session), "token_scope": source("token_scope"),
        "token_age": S.number(source("token_age", "token_age_s", default=None)), "access_result": result, "latency_ms": latency, "bytes_out": nbytes,
        "label_attack": label, "attack_type": source("attack_type", default="none"),
    }
    raw = [F.col(c) for c in df.columns if c.startswith("raw_")] + [F.col(c).alias(f"raw_{c}") for c in RAW if c in has and f"raw_{c}" not in has]
    return df.select(*[F.col(c) for c in ("event_ord",) if c in has], *[columns[c].alias(c) for c in UNIFIED], *raw)


def validate_schema(df: DataFrame) -> DataFrame:
    """One row: ok, missing (unified columns that df lacks, in order)."""
    missing = [c for c in UNIFIED if c not in df.columns]
    return df.sparkSession.range(1).select(F.lit(not missing).alias("ok"), F.array(*map(F.lit, missing)).cast("array<string>").alias("missing"))


#: Columns that hold an event's time, the first present counts.
TIMES = ("ts", "timestamp", "event_time", "time")


def parse_times(df: DataFrame, out: str = "parsed_ts") -> DataFrame:
    """df with the event's time, from the first of TIMES that it has (null without one).

    How a column is read is decided once for all of it: if any value is a date text, all are read as such; else numbers are epoch
    milliseconds where their median is above 10**12, seconds otherwise."""
    name = next((c for c in TIMES if c in df.columns), None)
    if name is None:
        return df.withColumn(out, F.lit(None).cast("timestamp"))
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.DateType)):
        return df.withColumn(out, F.col(name).cast("timestamp"))
    text = F.col(name).cast("string")
    value = text.try_cast("double")
    date = F.when(value.isNull(), F.try_to_timestamp(text))
    seen = cut(df.select(date.isNotNull().alias("is_date"), value.alias("v")))
    how = seen.agg(F.coalesce(F.max("is_date"), F.lit(False)).alias("_dates")).crossJoin(F.broadcast(quantiles(seen, F.col("v"), (0.5,)).select((F.col("q")[0] > 1e12).alias("_ms"))))
    epoch = F.when(F.col("_ms"), F.timestamp_millis(value.cast("long"))).otherwise(F.timestamp_seconds(value))
    return df.crossJoin(F.broadcast(how)).withColumn(out, F.when(F.col("_dates"), date).otherwise(epoch)).drop("_dates", "_ms")  # one row
