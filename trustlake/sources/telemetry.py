"""Telemetry from the event tables, and readers and writers of the formats that logs, features and metrics come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The raw columns of an access log that the normalizer understands, as the driver tables yield them.
_SELECT = """
SELECT event_id AS event_ord, CAST(ts AS TIMESTAMP) AS ts, concat('u_', p) AS principal_id, CASE WHEN p % 5 = 0 THEN 'service' ELSE 'user' END AS principal_type,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'admin' WHEN 'BUILDING' THEN 'service' WHEN 'FURNITURE' THEN 'engineer'
    WHEN 'AUTOMOBILE' THEN 'contractor' ELSE 'employee' END AS role,
  CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS mfa_used,
  CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'list' WHEN 'purchase' THEN 'download' WHEN 'signup' THEN 'login' ELSE 'delete' END AS action,
  concat('r_', res) AS resource_id, CASE WHEN res % 2 = 0 THEN 'bucket' ELSE 'table' END AS resource_type,
  CASE WHEN res % 24 < 2 THEN 'CRITICAL' WHEN res % 24 < 6 THEN 'HIGH' WHEN res % 24 < 14 THEN 'MED' ELSE 'LOW' END AS resource_sensitivity,
  cloud AS cloud_provider, concat(cloud, '-t', k % 2) AS tenant_id, concat(cloud, '-r', user_id % 3) AS region,
  concat('G', (user_id + k) % 4) AS geo, concat('d_', user_id % 40) AS device_id,
  CAST((k * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS posture_score,
  concat('s_', p, '_', {day}) AS session_id,
  CASE k % 5 WHEN 0 THEN 'WIDE' WHEN 1 THEN 'MEDIUM' ELSE 'NARROW' END AS token_scope, CAST(k * 60 AS DOUBLE) AS token_age,
  CASE WHEN event_type = 'error' THEN 'deny' WHEN k % 10 = 3 THEN 'restrict' ELSE 'permit' END AS access_result,
  CAST(value * 1000 AS DOUBLE) AS bytes_out,
  CASE WHEN event_type = 'error' THEN k % 13 ELSE 0 END AS raw_login_failures_5m, (k * 7) % 130 AS raw_api_calls_5m,
  CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS raw_time_anomaly, CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS raw_privilege_escalation,
  CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS raw_cross_cloud_hop,
  CASE WHEN event_type = 'error' AND k >= 70 THEN 1 ELSE 0 END AS label_attack,
  CASE WHEN event_type = 'error' AND k >= 70 THEN 'exfil' ELSE 'none' END AS attack_type
FROM (SELECT *, p * 6 + (event_id * 7 + k) % 8 AS res, CASE k % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS cloud
  FROM (SELECT e.*, c.c_mktsegment, CAST({k} AS INT) AS k, user_id % 15 AS p FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey) a) b
"""

#: The same view for DuckDB.
DUCKDB = _SELECT.format(day="strftime(ts, '%Y%m%d')", k="json_extract_string(props, '$.k')", events="events", customer="customer")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per access event, in the columns of an access log."""
    query = _SELECT.format(day="date_format(ts, 'yyyyMMdd')", k="get_json_object(props, '$.k')", events="{events}", customer="{customer}")
    return spark.sql(query, events=spark.read.parquet(f"{sf_dir}/events.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A raw log CSV with a header; types are inferred only if no schema is given (that costs a pass over the data)."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def scan_features(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Features: Parquet if the name says so, else CSV."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else scan_csv(spark, path, schema)


EXECUTION_SCHEMA = "intent_id string, action_index int, provider string, action_type string, description string, parameters map<string,string>, started_at double, finished_at double, latency_s double, status string, detect_ts double, stage string, effective_decision string"


def scan_action_log(spark: SparkSession, path: str, corrupt: str = "fail") -> DataFrame:
    """Executed actions, one JSON object a line; blank lines give no row.  A line that is no such object raises an error, or, with corrupt
    = "keep", gives a row that has only corrupt_line, its text."""
    if corrupt == "fail":
        return spark.read.schema(EXECUTION_SCHEMA).option("mode", "FAILFAST").json(path)
    schema = f"{EXECUTION_SCHEMA}, corrupt_line string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_line").json(path)


def scan_rollout_kpis(spark: SparkSession, path: str) -> DataFrame:
    """stage, metric, value of a JSON object of stages with KPI objects; what is missing gives no row."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,map<string,double>>")
    return text.select(F.explode(parsed).alias("stage", "kpis")).select("stage", F.explode("kpis").alias("metric", "value"))


#: Seconds that an engine needs for an event.
ENGINE_DELAY = {"baseline_static": 0.6, "baseline_siem": 1.5, "baseline_raac_iforest": 0.4, "baseline_per_cloud_brains": 0.55, "unified": 0.2}


def lookup(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    """A constant dimension table, of a size fixed in code."""
    return spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in values.items()], schema)


def latency_profiles(spark: SparkSession) -> DataFrame:
    return lookup(spark, ENGINE_DELAY, "engine string, processing_delay_s double")


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are joined by ';', as CSV has none."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    """Parquet, partitioned by the event's date."""
    df.withColumn("event_date", F.to_date("ts")).write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
