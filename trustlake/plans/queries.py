"""One named query per operator, over the telemetry view of the driver's tables, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import features, graph, metrics, models, normalize, policy, rules
from ..operators.lineage import apart, cut, folder
from ..sources import telemetry as T
from ..sources.graph_store import GraphStore
from ..streaming import features as streamed, jobs
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers a function under name; doubles are those of the SQL's columns to round (Spark's are all rounded)."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracles.text(sql, doubles.split())
        return f

    return register


def tele(spark, sf_dir):
    return T.telemetry(spark, sf_dir)


def uni(spark, sf_dir):
    return normalize.normalize(tele(spark, sf_dir))


def feats(spark, sf_dir, d=None):
    d = cut(uni(spark, sf_dir)) if d is None else d
    e, n = cut(graph.edges(graph.edge_events(d))), cut(graph.nodes(graph.node_events(d)))
    return features.feature_table(d, graph.static_features(e, n))


def s_anom():
    """A stand-in anomaly for queries of formulas that take one as given."""
    return (F.col("event_ord") * 37 % 97 + F.lit(0.5)) / F.lit(97.1)


#: Thresholds that split the fixture's risks into all four decisions.
SPLIT = {"allow": 0.58, "stepup": 0.62, "restrict": 0.66, "deny": 0.68}


def scored(spark, sf_dir, d=None):
    d = feats(spark, sf_dir, d).withColumn("s_anom", s_anom())
    return rules.fused(rules.unified_graph_score(rules.unified_rule_score(d)), **SPLIT)


def raac(spark, sf_dir, d=None):
    return rules.raac_fuse(rules.raac_context(uni(spark, sf_dir) if d is None else d).withColumn("s_anom", s_anom()))


def tuned(spark, sf_dir, d=None):
    d = cut((scored(spark, sf_dir) if d is None else d).select("event_ord", "ts", *normalize.UNIFIED[1:], "risk", "confidence", "decision", "rationale_tags"))
    return policy.with_tuned(d, policy.tuned_thresholds(d))


def intents(spark, sf_dir):
    return policy.intents(tuned(spark, sf_dir), "decision_tuned")


def staged(spark, sf_dir):
    return cut(policy.staged_events(cut(intents(spark, sf_dir))))


def graph_tables(spark, sf_dir):
    d = cut(uni(spark, sf_dir))
    return cut(graph.nodes(graph.node_events(d))), cut(graph.edges(graph.edge_events(d)))


def engines(spark, sf_dir, d=None, unified=None):
    """The decisions of all engines, with each one's plan of actions, cross-cloud mark and blast radius (null where it has none)."""
    d = cut(uni(spark, sf_dir)) if d is None else d
    keep = ["event_ord", "principal_id", "session_id", "cloud_provider", "label_attack", "decision", "action_list", "is_cross_cloud", "blast_size"]
    parts = {
        "baseline_static": rules.static_rules(d), "baseline_siem": rules.siem_score(d), "baseline_raac_iforest": raac(spark, sf_dir, d),
        "unified": scored(spark, sf_dir, d) if unified is None else unified,
    }
    out = None
    for name, part in parts.items():
        part = policy.intents(metrics.marked(part).withColumn("blast_size", metrics.blast_size(part.columns)))
        part = part.withColumnRenamed("_crossed", "is_cross_cloud").select(F.lit(name).alias("engine"), *keep)
        out = part if out is None else out.unionByName(part)
    return out


ts_text = lambda: F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
joined = lambda c: F.array_join(c, ";").alias(c)


# Sources and sinks: the telemetry goes out in each format and is read again.


@query("scan_raw_csv", "SELECT cloud_provider, count(*) AS n, sum(bytes_out) AS bytes, count(DISTINCT principal_id) AS n_principals FROM tele GROUP BY 1", "bytes")
def scan_raw_csv(spark, sf_dir):
    d, path = tele(spark, sf_dir), folder(spark, "csv")
    T.write_csv(d, path)
    return T.scan_csv(spark, path, d.schema).groupBy("cloud_provider").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("bytes"), F.count_distinct("principal_id").alias("n_principals"))


@query("scan_features", "SELECT resource_type, count(*) AS n, avg(f_bytes_out_log1p) AS mean_log FROM (SELECT resource_type, ln(1 + bytes_out) AS f_bytes_out_log1p FROM tele) GROUP BY 1", "mean_log")
def scan_features(spark, sf_dir):
    path = folder(spark, "features") + ".parquet"
    T.write_features(features.row_features(tele(spark, sf_dir)), path)
    return T.scan_features(spark, path).groupBy("resource_type").agg(F.count(F.lit(1)).alias("n"), F.avg("f_bytes_out_log1p").alias("mean_log"))


@query("scan_latency_profiles", f"SELECT engine, {oracles._case('engine', oracles.ENGINE_DELAY)} AS processing_delay_s, count(*) AS n_flagged FROM (SELECT 'baseline_static' AS engine, decision FROM static UNION ALL SELECT 'baseline_siem', decision FROM siem UNION ALL SELECT 'baseline_raac_iforest', decision FROM raac) WHERE decision <> 'allow' GROUP BY engine", "processing_delay_s")
def scan_latency_profiles(spark, sf_dir):
    d = cut(uni(spark, sf_dir))
    parts = {"baseline_static": rules.static_rules(d), "baseline_siem": rules.siem_score(d), "baseline_raac_iforest": raac(spark, sf_dir, d)}
    flagged = [p.filter("decision <> 'allow'").select(F.lit(name).alias("engine")) for name, p in parts.items()]
    counts = flagged[0].unionByName(flagged[1]).unionByName(flagged[2]).groupBy("engine").agg(F.count(F.lit(1)).alias("n_flagged"))
    return counts.join(F.broadcast(T.latency_profiles(spark)), "engine").select("engine", "processing_delay_s", "n_flagged")  # five rows


# Normalization.


@query("normalize_unified", f"SELECT event_ord, {TS}, principal_id, principal_type, role, mfa_used, action, api, operation, resource_id, resource_type, resource_sensitivity, cloud_provider, tenant_id, region, {oracles.IP} AS ip, geo, device_id, posture_score, workload_id, session_id, token_id, token_scope, token_age, access_result, latency_ms, bytes_out, label_attack, attack_type FROM uni", "posture_score token_age latency_ms bytes_out")
def normalize_unified(spark, sf_dir):
    return uni(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).select("event_ord", *normalize.UNIFIED)


@query("raw_passthrough", "SELECT event_ord, raw_login_failures_5m, raw_api_calls_5m, raw_time_anomaly, raw_privilege_escalation, raw_cross_cloud_hop FROM tele")
def raw_passthrough(spark, sf_dir):
    return uni(spark, sf_dir).select("event_ord", *[c for c in T.telemetry(spark, sf_dir).columns if c.startswith("raw_")])


@query("validate_schema", "SELECT FALSE AS ok, 'api;operation;ip;workload_id;token_id;latency_ms' AS missing, count(*) AS n_rows, count(*) FILTER (ts IS NULL OR principal_id IS NULL) AS n_unusable FROM tele")
def validate_schema(spark, sf_dir):
    d = tele(spark, sf_dir)
    seen = d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ts").isNull() | F.col("principal_id").isNull()).alias("n_unusable"))
    return normalize.validate_schema(d).crossJoin(F.broadcast(seen)).select("ok", joined("missing"), "n_rows", "n_unusable")  # one row each


#: name: (input expression over telemetry, in words of both engines; Spark's function; DuckDB's text of `v`)
SCALARS = {
    "parse_timestamp": ("CASE event_ord % 3 WHEN 0 THEN CAST(DATE '2024-01-01' AS VARCHAR(30)) WHEN 1 THEN 'bad' ELSE '2024-02-03 04:05:06.789' END", lambda c: F.date_format(S.parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"), "strftime(date_trunc('second', TRY_CAST(v AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S')"),
    "norm_cloud": ("CASE event_ord % 3 WHEN 0 THEN upper(cloud_provider) WHEN 1 THEN concat(' ', cloud_provider, ' ') END", S.known, "coalesce(lower(trim(v)), 'unknown')"),
    "to_bool01": ("CASE event_ord % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN '2' WHEN 2 THEN 'no' WHEN 3 THEN 't' WHEN 4 THEN '0.5' END", S.to_bool01, "CASE WHEN lower(trim(v)) IN ('1', 'true', 't', 'yes', 'y') OR TRY_CAST(v AS DOUBLE) >= 1 THEN 1 ELSE 0 END"),
    "posture_from_compliance": ("CASE event_ord % 8 WHEN 0 THEN 'compliant' WHEN 1 THEN 'no' WHEN 2 THEN '0.8' WHEN 3 THEN '80' WHEN 4 THEN '150' WHEN 5 THEN 'x' WHEN 6 THEN '-1' END", S.posture, "CASE WHEN TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 1 THEN TRY_CAST(v AS DOUBLE) WHEN TRY_CAST(v AS DOUBLE) > 1 AND TRY_CAST(v AS DOUBLE) <= 100 THEN TRY_CAST(v AS DOUBLE) / 100 WHEN lower(v) IN ('compliant', 'true', 'yes') THEN 0.9 WHEN lower(v) IN ('noncompliant', 'non-compliant', 'false', 'no') THEN 0.2 ELSE CAST(0.5 AS DOUBLE) END"),
    "normalize_action": ("CASE WHEN event_ord % 4 = 0 THEN NULL ELSE concat(' ', upper(action)) END", S.known, "coalesce(lower(trim(v)), 'unknown')"),
    "derive_api": ("concat(upper(resource_type), ':', action)", F.lower, "lower(v)"),
    "stable_hash_int": ("concat(principal_id, '|', session_id)", lambda c: S.stable_hash(c), "CAST('0x' || substr(sha256(v), 1, 12) AS BIGINT) % 2147483647"),
    "token_id": ("concat(principal_id, '|', session_id)", lambda c: S.token_id(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), "'tok_' || lpad(CAST(CAST('0x' || substr(sha256(v), 1, 12) AS BIGINT) % 10000000000 AS VARCHAR), 10, '0')"),
    "workload_id": ("concat(principal_id, '|', cloud_provider)", lambda c: S.workload_id(F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)), "'wk_' || lpad(CAST(CAST('0x' || substr(sha256(v), 1, 12) AS BIGINT) % 100000000 AS VARCHAR), 8, '0')"),
    "synthetic_ipv4": ("concat(principal_id, '|', cloud_provider)", lambda c: S.synthetic_ipv4(c), "(WITH h AS (SELECT CAST('0x' || substr(sha256(v), 1, 12) AS BIGINT) % 16777216 AS h) SELECT '10.' || (1 + (h // 65536) % 254) || '.' || (1 + (h // 256 % 256) % 254) || '.' || (1 + (h % 256) % 254) FROM h)"),
    "access_result": ("CASE event_ord % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END", lambda c: F.when(c.try_cast("int") == 1, "permit").otherwise("deny"), "CASE WHEN v = '1' THEN 'permit' ELSE 'deny' END"),
    "numeric_defaults": ("CASE event_ord % 3 WHEN 0 THEN '12.5' WHEN 1 THEN 'x' END", lambda c: S.number(c), "coalesce(TRY_CAST(v AS DOUBLE), CAST(0 AS DOUBLE))"),
    "token_scope_width": ("CASE event_ord % 6 WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'a, b' WHEN 2 THEN 'none' WHEN 3 THEN 'a;b' WHEN 4 THEN token_scope END", S.scope_width, "CASE WHEN v IS NULL OR lower(v) IN ('', 'none', 'nan', 'null') THEN 0 WHEN v LIKE '%|%' THEN len(string_split(v, '|')) WHEN v LIKE '%,%' THEN len(string_split(v, ',')) WHEN v LIKE '%;%' THEN len(string_split(v, ';')) ELSE 1 END"),
    "is_privileged_role": ("CASE event_ord % 3 WHEN 0 THEN 'DB-Owner' WHEN 1 THEN role END", S.is_privileged, "CASE WHEN regexp_matches(lower(v), 'admin|owner|root|superuser|priv|security|sudo') THEN 1 ELSE 0 END"),
    "sens_score": ("CASE event_ord % 4 WHEN 0 THEN 'Secret' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN resource_sensitivity END", S.sensitivity_score, "CAST(CASE WHEN lower(v) IN ('critical', 'secret') THEN 1.0 WHEN lower(v) = 'high' THEN 0.75 WHEN lower(v) IN ('medium', 'med') THEN 0.45 WHEN lower(v) = 'low' THEN 0.15 ELSE 0.25 END AS DOUBLE)"),
    "parse_tags": ("CASE event_ord % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN '[''x'', ''y'']' WHEN 2 THEN 'p;q;' WHEN 3 THEN 'one' END", lambda c: F.array_join(S.parse_tags(c), "+"), "array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(v, ''), '[\\[\\]''\"]', '', 'g'), '[;|,]'), lambda x: trim(x)), lambda x: x <> ''), '+')"),
    "parse_mixed_ts": ("CASE event_ord % 4 WHEN 0 THEN '1704067200' WHEN 1 THEN '1704067200000' WHEN 2 THEN '2024-03-01 10:00:00' ELSE 'bad' END", lambda c: F.date_format(S.mixed_timestamp(c), "yyyy-MM-dd HH:mm:ss"), "strftime(CASE WHEN TRY_CAST(v AS DOUBLE) > 1e12 THEN epoch_ms(TRY_CAST(v AS BIGINT)) WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN epoch_ms(TRY_CAST(v AS BIGINT) * 1000) ELSE TRY_CAST(v AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S')"),
    "stable_unit_hash": ("session_id", S.unit_hash, oracles.unit("v")),
    "to_decision": ("CASE event_ord % 6 WHEN 0 THEN 'Permit' WHEN 1 THEN 'step-up' WHEN 2 THEN 'block' WHEN 3 THEN 'restrict' WHEN 4 THEN 'other' END", S.to_decision, "CASE WHEN lower(v) IN ('stepup', 'step-up', 'step_up', 'mfa') THEN 'stepup' WHEN lower(v) = 'restrict' THEN 'restrict' WHEN lower(v) IN ('deny', 'block') THEN 'deny' ELSE 'allow' END"),
    "decision_severity": ("CASE event_ord % 5 WHEN 0 THEN 'stepup' WHEN 1 THEN 'Restrict' WHEN 2 THEN 'block' WHEN 3 THEN 'deny' END", S.severity, "CASE lower(v) WHEN 'stepup' THEN 1 WHEN 'restrict' THEN 2 WHEN 'block' THEN 3 WHEN 'deny' THEN 3 ELSE 0 END"),
    "norm_vocab": ("CASE event_ord % 4 WHEN 0 THEN 'medium' WHEN 1 THEN ' high' WHEN 2 THEN resource_sensitivity END", S.sensitivity_level, "CASE WHEN upper(trim(v)) IN ('LOW', 'MED', 'HIGH', 'CRITICAL') THEN upper(trim(v)) ELSE 'LOW' END"),
}
for _name, (_input, _spark, _duck) in SCALARS.items():
    _double = _name in ("posture_from_compliance", "numeric_defaults", "sens_score", "stable_unit_hash")
    query(_name, f"SELECT event_ord, {_duck} AS value FROM (SELECT event_ord, {_input} AS v FROM tele)", "value" if _double else "")(
        lambda spark, sf_dir, i=_input, f=_spark: tele(spark, sf_dir).select("event_ord", F.expr(i).cast("string").alias("v")).select("event_ord", f(F.col("v")).alias("value"))
    )


@query("alias_resolution", "SELECT event_ord, tenant_id, geo, principal_id FROM tele")
def alias_resolution(spark, sf_dir):
    d = tele(spark, sf_dir).withColumnsRenamed({"tenant_id": "cloud_account", "geo": "country", "principal_id": "user_id", "cloud_provider": "cloud"})
    return normalize.normalize(d).select("event_ord", "tenant_id", "geo", "principal_id")


@query("derive_api", "SELECT event_ord, lower(resource_type || ':' || action) AS value FROM tele")
def derive_api(spark, sf_dir):
    return normalize.normalize(tele(spark, sf_dir).withColumn("resource_type", F.upper("resource_type"))).select("event_ord", F.col("api").alias("value"))


@query("access_result", "SELECT event_ord, CASE event_ord % 3 WHEN 0 THEN 'permit' ELSE 'deny' END AS value FROM tele")
def access_result(spark, sf_dir):
    """A log that says whether access was granted: 1, 0 or nothing."""
    granted = F.when(F.col("event_ord") % 3 == 0, "1").when(F.col("event_ord") % 3 == 1, "0")
    return normalize.normalize(tele(spark, sf_dir).drop("access_result").withColumn("access_granted", granted)).select("event_ord", F.col("access_result").alias("value"))


_MS = "CASE WHEN event_ord % 5 < 3 THEN epoch_us(ts) // 1000 WHEN event_ord % 5 = 3 THEN epoch_us(ts) // 1000000 END"


@query("parse_mixed_ts_column", f"SELECT event_ord, 'epoch' AS kind, strftime(epoch_ms({_MS}), '%Y-%m-%d %H:%M:%S') AS parsed FROM tele UNION ALL SELECT event_ord, 'iso', CASE WHEN event_ord % 5 = 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END FROM tele")
def parse_mixed_ts_column(spark, sf_dir):
    """A column of milliseconds and, fewer, seconds is read as milliseconds; one with any date text only by its date texts."""
    d, ms, i = cut(tele(spark, sf_dir).select("event_ord", "ts")), F.unix_millis("ts"), F.col("event_ord") % 5
    number = F.when(i < 3, ms.cast("string")).when(i == 3, F.floor(ms / 1000).cast("string"))
    text = F.when(i == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(number)
    out = None
    for kind, c in (("epoch", number), ("iso", text)):
        part = normalize.parse_times(d.select("event_ord", c.alias("event_time"))).select("event_ord", F.lit(kind).alias("kind"), F.date_format("parsed_ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"))
        out = part if out is None else out.unionByName(part)
    return out


@query("derived_latency_ms", "SELECT event_ord, latency_ms FROM uni", "latency_ms")
def derived_latency_ms(spark, sf_dir):
    return uni(spark, sf_dir).select("event_ord", "latency_ms")


@query("bytes_log1p", "SELECT event_ord, f_bytes_out_log1p, f_failed_logins_5m FROM (SELECT event_ord, ln(1 + bytes_out) AS f_bytes_out_log1p, CAST(raw_login_failures_5m AS DOUBLE) AS f_failed_logins_5m FROM tele)", "f_bytes_out_log1p")
def bytes_log1p(spark, sf_dir):
    return features.row_features(tele(spark, sf_dir)).select("event_ord", "f_bytes_out_log1p", "f_failed_logins_5m")


@query("failed_logins", "SELECT event_ord, CASE WHEN access_result = 'deny' THEN CAST(1 AS DOUBLE) ELSE 0 END AS f_failed_logins_5m FROM tele")
def failed_logins(spark, sf_dir):
    return features.row_features(tele(spark, sf_dir).drop("raw_login_failures_5m")).select("event_ord", "f_failed_logins_5m")


# Filters.


@query("filter_incremental", "SELECT event_ord FROM uni WHERE ts > (SELECT s1 FROM starts)")
def filter_incremental(spark, sf_dir):
    d = uni(spark, sf_dir)
    return d.crossJoin(F.broadcast(policy.stage_starts(d).select("s1"))).filter("ts > s1").select("event_ord")


@query("filter_benign_train", "SELECT event_ord FROM uni WHERE label_attack = 0 OR (SELECT count(*) FILTER (label_attack = 0) < greatest(200, 0.1 * count(*)) FROM uni)")
def filter_benign_train(spark, sf_dir):
    return models.benign(uni(spark, sf_dir), 200).select("event_ord")


@query("filter_enforced", "SELECT event_ord, stage FROM st WHERE enforced")
def filter_enforced(spark, sf_dir):
    return staged(spark, sf_dir).filter("enforced").select("event_ord", "stage")


@query("filter_non_allow", "SELECT event_ord, decision FROM static WHERE decision <> 'allow'")
def filter_non_allow(spark, sf_dir):
    return rules.static_rules(uni(spark, sf_dir)).filter("decision <> 'allow'").select("event_ord", "decision")


@query("filter_non_allow_all", "SELECT event_ord, decision FROM static WHERE decision <> 'allow'")
def filter_non_allow_all(spark, sf_dir):
    return rules.static_rules(uni(spark, sf_dir)).filter("decision <> 'allow'").select("event_ord", "decision")


@query("filter_scope", "SELECT event_ord FROM uni WHERE lower(cloud_provider) = 'aws' AND tenant_id = 'aws-t1' AND region = 'aws-r2'")
def filter_scope(spark, sf_dir):
    return uni(spark, sf_dir).filter("lower(cloud_provider) = 'aws' AND tenant_id = 'aws-t1' AND region = 'aws-r2'").select("event_ord")


@query("canary_cohort", f"SELECT event_ord FROM uni WHERE {oracles.unit('session_id')} < 0.05")
def canary_cohort(spark, sf_dir):
    return uni(spark, sf_dir).filter(S.unit_hash(F.col("session_id")) < 0.05).select("event_ord")


@query("edges_from_src", "SELECT edge_key, event_count FROM edges WHERE src_id = 'principal:u_3' AND edge_type = 'accessed'")
def edges_from_src(spark, sf_dir):
    return graph_tables(spark, sf_dir)[1].filter("src_id = 'principal:u_3' AND edge_type = 'accessed'").select("edge_key", "event_count")


@query("operational_edges", "SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('accessed', 'data-read', 'called-api', 'token-issued', 'assumed-role') GROUP BY 1")
def operational_edges(spark, sf_dir):
    return graph_tables(spark, sf_dir)[1].filter(F.col("edge_type").isin(*graph.OPERATIONAL)).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


# Graph.


@query("graph_nodes", "SELECT event_ord, node_id, node_type FROM nodeev")
def graph_nodes(spark, sf_dir):
    return graph.node_events(uni(spark, sf_dir)).select("event_ord", "node_id", "node_type")


@query("graph_edge_events", "SELECT event_ord, edge_type, src_id, dst_id, sensitivity, bytes_out FROM edgeev", "bytes_out")
def graph_edge_events(spark, sf_dir):
    return graph.edge_events(uni(spark, sf_dir)).select("event_ord", "edge_type", "src_id", "dst_id", "sensitivity", "bytes_out")


SEEN = "strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen"
seen = lambda: [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")]
EDGE_COUNTS = ["event_count", "permit_count", "deny_count", "restrict_count", "attack_count", "bytes_out_sum"]


@query("nodes_upsert", f"SELECT node_id, node_type, {SEEN}, sensitivity FROM nodes")
def nodes_upsert(spark, sf_dir):
    return graph.nodes(graph.node_events(uni(spark, sf_dir))).select("node_id", "node_type", *seen(), "sensitivity")


@query("edges_agg", f"SELECT edge_key, {', '.join(EDGE_COUNTS)}, {SEEN} FROM edges", "bytes_out_sum")
def edges_agg(spark, sf_dir):
    return graph.edges(graph.edge_events(uni(spark, sf_dir))).select("edge_key", *EDGE_COUNTS, *seen())


@query("graph_stats", "SELECT 'nodes' AS name, count(*) AS n_rows FROM nodes UNION ALL SELECT 'edge_events', count(*) FROM edgeev UNION ALL SELECT 'edges_agg', count(*) FROM edges")
def graph_stats(spark, sf_dir):
    n, e = graph_tables(spark, sf_dir)
    return graph.stats(n, graph.edge_events(uni(spark, sf_dir)), e)


@query("graph_sink", f"SELECT 'nodes' AS name, node_id AS id, NULL::BIGINT AS event_count, {SEEN} FROM nodes UNION ALL SELECT 'edges', edge_key, event_count, {SEEN} FROM edges")
def graph_sink(spark, sf_dir):
    """The graph is written as versions in two commits and read back by their pointer."""
    d, path = cut(uni(spark, sf_dir)), folder(spark, "graph")
    store = GraphStore(spark, path, 16)
    for half in (0, 1):
        part = d.filter(F.col("event_ord") % 2 == half)
        store.commit({"nodes": graph.nodes(graph.node_events(part)), "edges": graph.edges(graph.edge_events(part))}, {"nodes": graph.merge_nodes, "edges": graph.merge_edges})
    n, e = store.read("nodes"), store.read("edges")
    n = n.select(F.lit("nodes").alias("name"), F.col("node_id").alias("id"), F.lit(None).cast("long").alias("event_count"), *seen())
    return n.unionByName(e.select(F.lit("edges").alias("name"), F.col("edge_key").alias("id"), "event_count", *seen()))


@query("edge_key", "SELECT edge_key, src_id, dst_id FROM edges")
def edge_key(spark, sf_dir):
    return graph_tables(spark, sf_dir)[1].select(graph.edge_key().alias("edge_key"), "src_id", "dst_id")


@query("sensitive_nodes", "SELECT node_id FROM sens")
def sensitive_nodes(spark, sf_dir):
    return graph.sensitive_nodes(graph_tables(spark, sf_dir)[0])


@query("undirected_neighbors", "SELECT a, b FROM near")
def undirected_neighbors(spark, sf_dir):
    return graph.neighbors(graph_tables(spark, sf_dir)[1])


def _hops(limit):
    def run(spark, sf_dir):
        n, e = graph_tables(spark, sf_dir)
        return graph.hops_to_sensitive(e, graph.sensitive_nodes(n), limit)

    return run


query("shortest_to_sensitive", "SELECT node, hops FROM d6")(_hops(6))
query("shortest_to_sensitive_2", "SELECT node, hops FROM d2")(_hops(2))


def _blast(k):
    def run(spark, sf_dir):
        n, e = graph_tables(spark, sf_dir)
        return graph.blast_radius(e, graph.sensitive_nodes(n), n.filter("node_type = 'principal'").select(F.col("node_id").alias("node")), k)

    return run


for _k in (1, 3):
    query(f"blast_radius_{_k}", f"SELECT p.node, (SELECT count(DISTINCT goal) FROM r{_k} WHERE r{_k}.node = p.node AND goal <> p.node) AS blast FROM principals p")(_blast(_k))


@query("static_graph_features", "SELECT principal_id, g_shortest_to_sensitive_hops, g_blast_radius_sensitive_k FROM gfeat")
def static_graph_features(spark, sf_dir):
    n, e = graph_tables(spark, sf_dir)
    return graph.static_features(e, n)


def paths(spark, sf_dir):
    n, e = graph_tables(spark, sf_dir)
    starts = n.filter("node_type = 'principal'").select(F.col("node_id").alias("node"))
    return graph.shortest_paths(e, starts, graph.sensitive_nodes(n).withColumnRenamed("node_id", "node"))


@query("shortest_path_nodes", "SELECT node AS start, hops FROM principals JOIN back6 USING (node)")
def shortest_path_nodes(spark, sf_dir):
    return paths(spark, sf_dir).select("start", "hops")


@query("shortest_path_nodes_6", "SELECT start, hops, goal, path FROM walk")
def shortest_path_nodes_6(spark, sf_dir):
    return paths(spark, sf_dir).select("start", "hops", "goal", F.array_join("path", ">").alias("path"))


@query("cross_cloud_pivots", "SELECT src_id AS principal, array_to_string(list_sort(list(DISTINCT cloud_provider)), ';') AS clouds, count(DISTINCT CASE WHEN dst_id LIKE 'resource:%' THEN dst_id END) AS n_resources, count(DISTINCT CASE WHEN dst_id LIKE 'tenant:%' THEN dst_id END) AS n_tenants FROM edges WHERE edge_type IN ('accessed', 'connected-to') AND src_id LIKE 'principal:%' GROUP BY 1")
def cross_cloud_pivots(spark, sf_dir):
    return graph.pivots(graph_tables(spark, sf_dir)[1]).withColumn("clouds", F.array_join("clouds", ";"))


@query("top_risky_edges", "SELECT edge_key, round(deny_count + 2 * attack_count + ln(1 + bytes_out_sum / 1e6), 6) AS score FROM edges ORDER BY score DESC, edge_key LIMIT 20", "score")
def top_risky_edges(spark, sf_dir):
    return graph.top_risky(graph_tables(spark, sf_dir)[1]).select("edge_key", "score")


@query("top_risky_operational_edges", "SELECT edge_key, round(attack_count * 10 + deny_count + bytes_out_sum / 1e6, 6) AS score FROM edges WHERE edge_type IN ('accessed', 'data-read', 'called-api', 'token-issued', 'assumed-role') ORDER BY score DESC, edge_key LIMIT 10", "score")
def top_risky_operational_edges(spark, sf_dir):
    return graph.top_risky_operational(graph_tables(spark, sf_dir)[1]).select("edge_key", "score")


@query("graph_incremental", f"SELECT edge_key, {', '.join(EDGE_COUNTS)}, {SEEN} FROM edges", "bytes_out_sum")
def graph_incremental(spark, sf_dir):
    d = uni(spark, sf_dir)
    split = d.crossJoin(F.broadcast(policy.stage_starts(d).select("s1")))
    early = split.filter("ts < s1").drop("s1")
    n, e = cut(graph.nodes(graph.node_events(early))), cut(graph.edges(graph.edge_events(early)))
    return graph.incremental(n, e, d)[1].select("edge_key", *EDGE_COUNTS, *seen())


# Ordered features.


@query("geo_switch", "SELECT event_ord, f_geo_switch FROM geo2")
def geo_switch(spark, sf_dir):
    return features.geo_features(uni(spark, sf_dir)).select("event_ord", "f_geo_switch")


@query("fast_geo_switch", "SELECT event_ord, f_fast_geo_switch FROM geo2")
def fast_geo_switch(spark, sf_dir):
    return features.geo_features(uni(spark, sf_dir)).select("event_ord", "f_fast_geo_switch")


@query("posture_drift", "SELECT event_ord, f_posture_drift FROM folds", "f_posture_drift")
def posture_drift(spark, sf_dir):
    return features.posture_drift(uni(spark, sf_dir)).select("event_ord", "f_posture_drift")


@query("bytes_spike_score", "SELECT event_ord, f_bytes_spike_score FROM spike", "f_bytes_spike_score")
def bytes_spike_score(spark, sf_dir):
    return features.bytes_spike(uni(spark, sf_dir)).select("event_ord", "f_bytes_spike_score")


@query("cross_cloud_hops", "SELECT event_ord, g_cross_cloud_hops_session FROM feat0")
def cross_cloud_hops(spark, sf_dir):
    return features.session_hops(uni(spark, sf_dir)).select("event_ord", "g_cross_cloud_hops_session")


@query("new_resource_edge", "SELECT event_ord, g_is_new_resource_edge FROM firsts")
def new_resource_edge(spark, sf_dir):
    return features.new_resource(uni(spark, sf_dir)).select("event_ord", "g_is_new_resource_edge")


@query("new_resource_count_win", "SELECT event_ord, g_new_resource_count_win FROM feat0")
def new_resource_count_win(spark, sf_dir):
    return features.new_resource(uni(spark, sf_dir)).select("event_ord", "g_new_resource_count_win")


@query("new_resource_rate_win", "SELECT event_ord, g_new_resource_count_win / 30.0 AS g_new_resource_rate_win FROM feat0", "g_new_resource_rate_win")
def new_resource_rate_win(spark, sf_dir):
    return features.new_resource(uni(spark, sf_dir)).select("event_ord", "g_new_resource_rate_win")


@query("siem_correlation_window", f"SELECT event_ord, {', '.join(rules.SIEM_COUNTS)} FROM siemwin")
def siem_correlation_window(spark, sf_dir):
    return rules.siem_windows(uni(spark, sf_dir)).select("event_ord", *rules.SIEM_COUNTS)


FEATURES = "f_token_age f_failed_logins_5m f_fast_geo_switch f_geo_switch f_posture_drift f_bytes_spike_score f_bytes_out_log1p f_is_privileged_role f_token_scope_width g_cross_cloud_hops_session g_is_new_resource_edge g_new_resource_count_win g_new_resource_rate_win g_shortest_to_sensitive_hops g_blast_radius_sensitive_k".split()


@query("feature_table", f"SELECT event_ord, principal_id, label_attack, {', '.join(FEATURES)} FROM feat", "f_token_age f_posture_drift f_bytes_spike_score f_bytes_out_log1p g_new_resource_rate_win")
def feature_table(spark, sf_dir):
    return feats(spark, sf_dir).select("event_ord", "principal_id", "label_attack", *FEATURES)


@query("cross_cloud_nunique", "SELECT event_ord, n_clouds FROM uni JOIN (SELECT session_id, count(DISTINCT cloud_provider) AS n_clouds FROM uni GROUP BY 1) USING (session_id)")
def cross_cloud_nunique(spark, sf_dir):
    return metrics.cross_cloud_keys(uni(spark, sf_dir)).select("event_ord", "n_clouds")


# Streams: the telemetry comes in by files, in three parts of its time, and the result is that of the batch.


def replayed(spark, d):
    """(a streaming table of d and a last event a year later, which lets the watermark pass all others; its delay).  Files of one part may
    come in any order, so the delay is longer than a part."""
    path, us = folder(spark, "stream"), F.unix_micros("ts")
    low, high = d.agg(F.min(us), F.max(us)).first()
    step = (high - low) // 3 + 1
    for i in range(3):
        d.filter(us.between(low + i * step, low + (i + 1) * step - 1)).write.parquet(f"{path}/part{i}")
    last = d.filter(us == high).limit(1).withColumns({"event_ord": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("INTERVAL 400 DAYS")})
    keys = ("principal_id", "device_id", "session_id", "resource_id")
    last.withColumns({k: F.lit("last") for k in keys}).select(*d.columns).coalesce(1).write.parquet(f"{path}/part3")
    source = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(path)
    return source, f"{step // 1_000_000 + 3600} seconds"


@query("graph_stream", f"SELECT edge_key, {', '.join(EDGE_COUNTS)}, {SEEN} FROM edges", "bytes_out_sum")
def graph_stream(spark, sf_dir):
    source, delay = replayed(spark, cut(uni(spark, sf_dir)))
    path = folder(spark, "graph")
    jobs.graph_stream(source.filter("event_ord >= 0"), path, folder(spark, "mark"), delay=delay, buckets=8).awaitTermination()
    return GraphStore(spark, path, 8).read("edges").select("edge_key", *EDGE_COUNTS, *seen())


_STREAMED = "f_geo_switch, f_fast_geo_switch, f_bytes_spike_score, g_is_new_resource_edge, g_new_resource_count_win, f_posture_drift, g_cross_cloud_hops_session"


@query("features_stream", f"SELECT event_ord, {_STREAMED} FROM feat0", "f_bytes_spike_score f_posture_drift")
def features_stream(spark, sf_dir):
    source, delay = replayed(spark, cut(uni(spark, sf_dir)))
    out = None
    for key in streamed.PROCESSORS:
        path = folder(spark, key)
        made = streamed.features_stream(source, key, delay).drop(key).writeStream.format("parquet").option("checkpointLocation", folder(spark, "mark")).option("path", path)
        made.trigger(availableNow=True).start().awaitTermination()
        part = spark.read.parquet(path)
        out = part if out is None else out.join(apart(part), "event_ord")
    return out.select("event_ord", *_STREAMED.split(", "))


# Rule scorers.

SCORE = "risk confidence"
TAGS = "array_to_string(rationale_tags, ';') AS rationale_tags"


@query("static_risk", "SELECT event_ord, risk FROM static", "risk")
def static_risk(spark, sf_dir):
    return rules.static_rules(uni(spark, sf_dir)).select("event_ord", "risk")


@query("static_decision", f"SELECT event_ord, risk, confidence, decision, {TAGS} FROM static", SCORE)
def static_decision(spark, sf_dir):
    return rules.static_rules(uni(spark, sf_dir)).select("event_ord", "risk", "confidence", "decision", joined("rationale_tags"))


@query("siem_thresholds", "SELECT b95 AS siem_bytes_p95, b99 AS siem_bytes_p99 FROM thresholds", "siem_bytes_p95 siem_bytes_p99")
def siem_thresholds(spark, sf_dir):
    return rules.siem_thresholds(uni(spark, sf_dir))


@query("siem_row_rules", "SELECT event_ord, row_severity, array_to_string(row_tags, ';') AS row_tags FROM siemrows")
def siem_row_rules(spark, sf_dir):
    return rules.siem_rows(uni(spark, sf_dir)).select("event_ord", "row_severity", joined("row_tags"))


@query("siem_correlation", f"SELECT event_ord, siem_severity, {TAGS} FROM siemcorr")
def siem_correlation(spark, sf_dir):
    return rules.siem_correlated(uni(spark, sf_dir)).select("event_ord", "siem_severity", joined("rationale_tags"))


@query("siem_score", f"SELECT event_ord, risk, confidence, decision, {TAGS} FROM siem", SCORE)
def siem_score(spark, sf_dir):
    return rules.siem_score(uni(spark, sf_dir)).select("event_ord", "risk", "confidence", "decision", joined("rationale_tags"))


@query("raac_context", "SELECT event_ord, s_ctx FROM raac0", "s_ctx")
def raac_context(spark, sf_dir):
    return rules.raac_context(uni(spark, sf_dir)).select("event_ord", "s_ctx")


@query("raac_fuse", "SELECT event_ord, risk, confidence, decision FROM raac", SCORE)
def raac_fuse(spark, sf_dir):
    return raac(spark, sf_dir).select("event_ord", "risk", "confidence", "decision")


@query("unified_rule_score", "SELECT event_ord, s_rule, array_to_string(rule_tags, ';') AS rule_tags FROM parts", "s_rule")
def unified_rule_score(spark, sf_dir):
    return rules.unified_rule_score(feats(spark, sf_dir)).select("event_ord", "s_rule", joined("rule_tags"))


@query("unified_graph_score", "SELECT event_ord, s_graph, array_to_string(graph_tags, ';') AS graph_tags FROM parts", "s_graph")
def unified_graph_score(spark, sf_dir):
    return rules.unified_graph_score(feats(spark, sf_dir)).select("event_ord", "s_graph", joined("graph_tags"))


@query("confidence", "SELECT event_ord, confidence FROM scored", "confidence")
def confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("event_ord", "confidence")


@query("hybrid_risk", "SELECT event_ord, risk FROM scored", "risk")
def hybrid_risk(spark, sf_dir):
    return scored(spark, sf_dir).select("event_ord", "risk")


@query("unified_decision", "SELECT event_ord, decision FROM scored")
def unified_decision(spark, sf_dir):
    return scored(spark, sf_dir).select("event_ord", "decision")


@query("rationale", f"SELECT event_ord, {TAGS}, {oracles.RATIONALE} AS rationale_text FROM scored")
def rationale(spark, sf_dir):
    return scored(spark, sf_dir).select("event_ord", joined("rationale_tags"), "rationale_text")


# Thresholds, policy, rollout.


@query("tune_thresholds", "SELECT * FROM th", "t_allow t_stepup t_restrict t_deny")
def tune_thresholds(spark, sf_dir):
    return policy.tuned_thresholds(scored(spark, sf_dir))


@query("decision_tuned", "SELECT event_ord, decision_tuned FROM tuned")
def decision_tuned(spark, sf_dir):
    return tuned(spark, sf_dir).select("event_ord", "decision_tuned")


@query("threshold_report", "SELECT avg((decision_tuned IN ('restrict', 'deny'))::INT) FILTER (label_attack = 1) AS tpr_severe, avg((decision_tuned IN ('restrict', 'deny'))::INT) FILTER (label_attack = 0) AS fpr_severe, avg((decision_tuned = 'deny')::INT) FILTER (label_attack = 1) AS tpr_deny, avg((decision_tuned = 'deny')::INT) FILTER (label_attack = 0) AS fpr_deny FROM tuned", "tpr_severe fpr_severe tpr_deny fpr_deny")
def threshold_report(spark, sf_dir):
    rate = lambda cond, y: F.avg(F.when(F.col("label_attack") == y, F.expr(cond).cast("double")))
    severe, deny = "decision_tuned IN ('restrict', 'deny')", "decision_tuned = 'deny'"
    return tuned(spark, sf_dir).agg(rate(severe, 1).alias("tpr_severe"), rate(severe, 0).alias("fpr_severe"), rate(deny, 1).alias("tpr_deny"), rate(deny, 0).alias("fpr_deny"))


@query("decision_from_risk", "SELECT event_ord, CASE WHEN risk < 0.30 THEN 'allow' WHEN risk < 0.60 THEN 'stepup' WHEN risk < 0.80 OR confidence < 0.60 THEN 'restrict' ELSE 'deny' END AS decision FROM scored")
def decision_from_risk(spark, sf_dir):
    return scored(spark, sf_dir).select("event_ord", policy.decision_from_risk(F.col("risk"), F.col("confidence")).alias("decision"))


@query("build_intent", "SELECT intent_id, principal_id, resource_id, risk, confidence, intent_decision FROM intents", SCORE)
def build_intent(spark, sf_dir):
    return intents(spark, sf_dir).select("intent_id", "principal_id", "resource_id", "risk", "confidence", "intent_decision")


@query("compile_actions", "SELECT intent_id, action_index, action_type FROM acts")
def compile_actions(spark, sf_dir):
    return policy.flat_actions(intents(spark, sf_dir)).select("intent_id", "action_index", "action_type")


_CATALOG = ", ".join(f"('{p}', '{a}', '{d}')" for p, own in oracles.CATALOG.items() for a, d in own.items())


@query("action_catalog", f"SELECT provider, action_type, description, n FROM (VALUES {_CATALOG}) t(provider, action_type, description) JOIN (SELECT cloud_provider AS provider, action_type, count(*) AS n FROM acts GROUP BY ALL) USING (provider, action_type)")
def action_catalog(spark, sf_dir):
    return policy.flat_actions(intents(spark, sf_dir)).groupBy("provider", "action_type", "description").agg(F.count(F.lit(1)).alias("n"))


@query("flat_actions", "SELECT intent_id, action_index, cloud_provider AS provider, action_type, finished_s - latency_s AS started_s, finished_s, principal_id AS p_principal, token_id AS p_token FROM acts", "started_s finished_s")
def flat_actions(spark, sf_dir):
    return policy.flat_actions(intents(spark, sf_dir)).select("intent_id", "action_index", "provider", "action_type", "started_s", "finished_s", F.element_at("parameters", "principal_id").alias("p_principal"), F.element_at("parameters", "token_id").alias("p_token"))


@query("intent_columns", "SELECT intent_id, intent_decision, len(action_list) AS action_count, array_to_string(action_list, '|') AS action_types FROM intents")
def intent_columns(spark, sf_dir):
    return intents(spark, sf_dir).select("intent_id", "intent_decision", "action_count", "action_types")


@query("action_timeline", "SELECT intent_id, action_index, finished_s - latency_s AS started_s, finished_s FROM acts", "started_s finished_s")
def action_timeline(spark, sf_dir):
    return policy.flat_actions(intents(spark, sf_dir)).select("intent_id", "action_index", "started_s", "finished_s")


@query("stage_windows", "SELECT stage, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM st GROUP BY stage")
def stage_windows(spark, sf_dir):
    return staged(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@query("enforcement_mask", "SELECT event_ord, stage, enforced, effective_decision FROM st")
def enforcement_mask(spark, sf_dir):
    return staged(spark, sf_dir).select("event_ord", "stage", "enforced", "effective_decision")


KPI = "enforced_fraction false_deny_rate mfa_friction_rate latency_p95_ms policy_error_rate analyst_override_rate"


@query("rollout_kpis", "SELECT * FROM kpi", KPI)
def rollout_kpis(spark, sf_dir):
    return policy.rollout_kpis(staged(spark, sf_dir))


@query("scan_rollout_json", f"SELECT stage, metric, value FROM (UNPIVOT (SELECT stage, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in ['n_events', *KPI.split()])} FROM kpi) ON {', '.join(['n_events', *KPI.split()])} INTO NAME metric VALUE value)", "value")
def scan_rollout_json(spark, sf_dir):
    """The KPIs as one JSON object per stage, in one file, read back as rows."""
    kpis, path = policy.rollout_kpis(staged(spark, sf_dir)), folder(spark, "kpis")
    values = F.map_from_arrays(F.array(*map(F.lit, kpis.columns[1:])), F.array(*[F.col(c).cast("double") for c in kpis.columns[1:]]))
    kpis.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("stage", values)))).alias("value")).write.text(path)  # at most four stages
    return T.scan_rollout_kpis(spark, path)


@query("budget_check", "SELECT stage, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS budgets_ok FROM kpic")
def budget_check(spark, sf_dir):
    return policy.checked(policy.rollout_kpis(staged(spark, sf_dir))).select("stage", joined("reasons"), "budgets_ok")


@query("rollout_timeline", "SELECT stage, stage_no, n_events, len(reasons) = 0 AS budgets_ok FROM line")
def rollout_timeline(spark, sf_dir):
    return policy.timeline(policy.rollout_kpis(staged(spark, sf_dir))).select("stage", "stage_no", "n_events", "budgets_ok")


@query("rollout_decisions", "SELECT event_ord, coalesce(l.stage, 'shadow') AS stage, enforced AND l.stage IS NOT NULL AS enforced, CASE WHEN l.stage IS NULL THEN 'allow' ELSE effective_decision END AS effective_decision FROM st LEFT JOIN line l USING (stage)")
def rollout_decisions(spark, sf_dir):
    events = cut(staged(spark, sf_dir))
    return policy.rolled_out(events, policy.timeline(policy.rollout_kpis(events))).select("event_ord", "stage", "enforced", "effective_decision")


# Evaluation.

_D = " ".join(oracles.SUMMARY_DOUBLES)


@query("binary_metrics", f"SELECT {oracles._binary('hard', 'h')} FROM (SELECT {oracles._FLAGS} FROM static)", "hard_accuracy hard_precision hard_recall hard_fpr hard_f1")
def binary_metrics(spark, sf_dir):
    d = rules.static_rules(uni(spark, sf_dir))
    return d.agg(*metrics.binary_columns(F.col("label_attack") == 1, metrics.flags(F.col("decision"))[1], "hard"))


@query("decision_flags", f"SELECT event_ord, f AS flagged, h AS hard FROM (SELECT event_ord, {oracles._FLAGS} FROM static)")
def decision_flags(spark, sf_dir):
    flagged, hard = metrics.flags(F.col("decision"))
    return rules.static_rules(uni(spark, sf_dir)).select("event_ord", flagged.alias("flagged"), hard.alias("hard"))


@query("access_decision_precision", "SELECT avg(label_attack) AS access_decision_precision FROM static WHERE decision <> 'allow'", "access_decision_precision")
def access_decision_precision(spark, sf_dir):
    return metrics.summarize(rules.static_rules(uni(spark, sf_dir))).select("access_decision_precision")


@query("summarize_scores", f"SELECT {oracles.SUMMARY} FROM (SELECT {oracles._FLAGS} FROM static)", _D)
def summarize_scores(spark, sf_dir):
    return metrics.summarize(rules.static_rules(uni(spark, sf_dir)))


LAT = "count(x) AS n, coalesce(avg(x), 0) AS mean_s, coalesce(quantile_cont(x, 0.5), 0) AS p50_s, coalesce(quantile_cont(x, 0.95), 0) AS p95_s, coalesce(quantile_cont(x, 0.99), 0) AS p99_s, coalesce(max(x), 0) AS max_s"
LATD = "mean_s p50_s p95_s p99_s max_s"


@query("latency_summary", f"SELECT {LAT} FROM (SELECT latency_ms / 1000 AS x FROM uni)", LATD)
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(uni(spark, sf_dir).withColumn("x", F.col("latency_ms") / 1000), "x")


@query("latency_stats_grouped", f"SELECT 'overall' AS intent_decision, {LAT} FROM (SELECT max(finished_s) AS x FROM acts GROUP BY intent_id) UNION ALL SELECT intent_decision, {LAT} FROM (SELECT intent_decision, max(finished_s) AS x FROM acts GROUP BY intent_id, intent_decision) GROUP BY intent_decision", LATD)
def latency_stats_grouped(spark, sf_dir):
    d = cut(intents(spark, sf_dir))
    times = metrics.executions(policy.flat_actions(d)).join(apart(d.select("intent_id", "intent_decision")), "intent_id")
    return metrics.latency_by(times, "response_s", "intent_decision")


@query("response_times_exec", "SELECT intent_id, max(finished_s) AS response_s, sum(latency_s) AS latency_sum_s, count(*) AS n_actions FROM acts GROUP BY intent_id", "response_s latency_sum_s")
def response_times_exec(spark, sf_dir):
    return metrics.executions(policy.flat_actions(intents(spark, sf_dir))).select("intent_id", "response_s", "latency_sum_s", "n_actions")


@query("response_times_stream", "SELECT intent_id, 0.2 + sum(latency_s) AS response_s FROM acts WHERE intent_decision <> 'allow' GROUP BY intent_id", "response_s")
def response_times_stream(spark, sf_dir):
    return policy.response_times(intents(spark, sf_dir), 0.2).select("intent_id", "response_s")


@query("execution_summary", "SELECT intent_id, count(*) AS n_actions, array_to_string(list_sort(list(DISTINCT cloud_provider)), '|') AS providers, array_to_string(list_sort(list(DISTINCT action_type)), '|') AS types FROM acts GROUP BY intent_id")
def execution_summary(spark, sf_dir):
    return metrics.executions(policy.flat_actions(intents(spark, sf_dir))).select("intent_id", "n_actions", "providers", "types")


@query("action_executions", f"SELECT intent_id, action_index, action_type, {TS}, 0.2 + finished_s - latency_s AS started_at, 0.2 + finished_s AS finished_at, 'ok' AS status FROM acts", "started_at finished_at")
def action_executions(spark, sf_dir):
    d = policy.flat_actions(intents(spark, sf_dir))
    return d.select("intent_id", "action_index", "action_type", ts_text(), (F.lit(0.2) + F.col("started_s")).alias("started_at"), (F.lit(0.2) + F.col("finished_s")).alias("finished_at"), F.lit("ok").alias("status"))


@query("scan_action_log_jsonl", "SELECT action_type, count(*) AS n, sum(latency_s) AS latency_s FROM acts GROUP BY 1", "latency_s")
def scan_action_log_jsonl(spark, sf_dir):
    path = folder(spark, "actions")
    T.write_json(policy.flat_actions(intents(spark, sf_dir)).select("intent_id", "action_index", "provider", "action_type", "parameters", "latency_s"), path)
    return T.scan_action_log(spark, path).groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_s").alias("latency_s"))


@query("scan_action_log_corrupt", "SELECT event_ord % 10 = 0 AS corrupt, count(*) AS n, count(DISTINCT CASE WHEN event_ord % 10 > 0 THEN action_type END) AS n_types FROM acts GROUP BY 1")
def scan_action_log_corrupt(spark, sf_dir):
    """A log in which some lines break off and some are blank: broken ones are kept apart, blank ones give no row."""
    path = folder(spark, "actions")
    d = policy.flat_actions(intents(spark, sf_dir))
    line = F.to_json(F.struct("intent_id", "action_index", "provider", "action_type", "latency_s"))
    d.select(F.concat(F.when(F.col("event_ord") % 10 == 0, F.substring(line, 1, 20)).otherwise(line), F.when(F.col("event_ord") % 7 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    out = T.scan_action_log(spark, path, corrupt="keep").withColumn("corrupt", F.col("corrupt_line").isNotNull())
    return out.groupBy("corrupt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("action_type").alias("n_types"))


@query("cross_cloud_detection", "SELECT count(*) FILTER (x) AS xcloud_events, count(*) FILTER (x AND y) AS xcloud_attacks, coalesce(count(*) FILTER (x AND y AND f) / nullif(count(*) FILTER (x AND y), 0), 0.0) AS xcloud_flagged_tpr, coalesce(count(*) FILTER (x AND y AND h) / nullif(count(*) FILTER (x AND y), 0), 0.0) AS xcloud_hard_tpr FROM (SELECT label_attack = 1 AS y, raw_cross_cloud_hop > 0.5 AS x, decision <> 'allow' AS f, decision IN ('restrict', 'deny') AS h FROM static)", "xcloud_flagged_tpr xcloud_hard_tpr")
def cross_cloud_detection(spark, sf_dir):
    return metrics.cross_cloud_detection(rules.static_rules(uni(spark, sf_dir)))


_AFTER = "g_blast_radius_sensitive_k * (1 - CASE decision WHEN 'stepup' THEN 0.1 WHEN 'restrict' THEN 0.45 WHEN 'deny' THEN 0.75 ELSE 0 END)"


@query("blast_radius_reduction", f"SELECT avg(g_blast_radius_sensitive_k) AS mean_blast_before, avg({_AFTER}) AS mean_blast_after, 100 * (1 - avg({_AFTER}) / avg(g_blast_radius_sensitive_k)) AS blast_radius_reduction_pct FROM scored WHERE label_attack = 1", "mean_blast_before mean_blast_after blast_radius_reduction_pct")
def blast_radius_reduction(spark, sf_dir):
    return metrics.blast_reduction(scored(spark, sf_dir))


@query("policy_consistency_var", "SELECT policy_consistency_var, deny_rate_var FROM econ WHERE engine = 'baseline_static'", "policy_consistency_var deny_rate_var")
def policy_consistency_var(spark, sf_dir):
    return metrics.policy_consistency(rules.static_rules(uni(spark, sf_dir)))


def board(spark, sf_dir):
    """One row an engine: detection, response times, cross-cloud detection and blast reduction by one aggregate, policy consistency, and
    rollout safety (of the unified engine, null for the others)."""
    d = cut(uni(spark, sf_dir))
    unified = cut(scored(spark, sf_dir, d))
    every = cut(engines(spark, sf_dir, d, unified))
    seconds = F.create_map(*[F.lit(x) for pair in policy.ACTION_SECONDS.items() for x in pair])
    plan = F.aggregate("action_list", F.lit(0.0), lambda x, a: x + F.element_at(seconds, a))
    out = metrics.engine_summary(every, T.latency_profiles(spark), plan)
    stages = cut(policy.staged_events(cut(policy.intents(tuned(spark, sf_dir, unified), "decision_tuned"))))
    for more in (metrics.policy_consistency(every, by=("engine",)), rollout_safety(stages)):
        out = out.join(F.broadcast(more), "engine", "left")  # a row an engine
    return out


def rollout_safety(events):
    """One row: the canary and rollout stages' false denials, step-ups and latency, if they were attempted."""
    line = policy.timeline(policy.rollout_kpis(events))
    names = {"false_deny_rate": "false_deny_rate", "mfa_friction_rate": "mfa_friction_rate", "latency_p95_ms": "latency_p95_ms"}
    return line.agg(*[F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{n}") for s in ("canary", "rollout") for c, n in names.items()]).withColumn("engine", F.lit("unified"))


_ROLLOUT = "canary_false_deny_rate canary_mfa_friction_rate canary_latency_p95_ms rollout_false_deny_rate rollout_mfa_friction_rate rollout_latency_p95_ms"
_BOARD = f"{_D} policy_consistency_var deny_rate_var avg_response_time_s mttr_proxy_s p95_response_time_s xcloud_flagged_tpr xcloud_hard_tpr mean_blast_before mean_blast_after blast_radius_reduction_pct {_ROLLOUT}"


@query("engine_metrics", "SELECT * FROM board", _BOARD)
def engine_metrics(spark, sf_dir):
    return board(spark, sf_dir)


@query("compare_engines", "SELECT * FROM esum", _D)
def compare_engines(spark, sf_dir):
    return metrics.summarize(engines(spark, sf_dir), by=("engine",))


@query("decision_counts", "SELECT engine, decision, count(*) AS n FROM engines GROUP BY ALL")
def decision_counts(spark, sf_dir):
    return engines(spark, sf_dir).groupBy("engine", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("stagewise_precision", f"SELECT stage, {oracles.SUMMARY} FROM (SELECT stage, label_attack = 1 AS y, effective_decision <> 'allow' AS f, effective_decision IN ('restrict', 'deny') AS h FROM st WHERE enforced) GROUP BY stage", _D)
def stagewise_precision(spark, sf_dir):
    return metrics.summarize(staged(spark, sf_dir).filter("enforced"), "effective_decision", ("stage",))


_TARGETS = "('hard_accuracy', 0.964, TRUE), ('hard_fpr', 0.031, FALSE), ('avg_response_time_s', 2.3, FALSE), ('access_decision_precision', 0.946, TRUE), ('det_accuracy', 0.964, TRUE), ('det_fpr', 0.031, FALSE)"


@query("target_check", f"SELECT engine, metric, value, target, CASE WHEN more THEN value >= target ELSE value <= target END AS passed FROM long JOIN (VALUES {_TARGETS}) t(metric, target, more) USING (metric)", "value target")
def target_check(spark, sf_dir):
    return metrics.target_check(board(spark, sf_dir))


_SIGNS = "('det_accuracy', 1), ('det_precision', 1), ('det_recall', 1), ('det_f1', 1), ('det_fpr', -1), ('access_decision_precision', 1), ('avg_response_time_s', -1), ('policy_consistency_var', -1)"


@query("leaderboard", f"SELECT metric, engine AS best_engine, value, margin FROM (SELECT metric, engine, value, abs(value - lead(value) OVER w) AS margin, row_number() OVER w AS r FROM long JOIN (VALUES {_SIGNS}) t(metric, s) USING (metric) WINDOW w AS (PARTITION BY metric ORDER BY -s * value, engine)) WHERE r = 1", "value margin")
def leaderboard(spark, sf_dir):
    return metrics.leaderboard(board(spark, sf_dir))


@query("score_profile", "SELECT metric, count(*) AS n, avg(v) AS mean, stddev(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM (SELECT 'risk' AS metric, risk AS v FROM siem UNION ALL SELECT 'confidence', confidence FROM siem) GROUP BY metric", "mean std min p25 p50 p75 max")
def score_profile(spark, sf_dir):
    return metrics.profile(rules.siem_score(uni(spark, sf_dir)))


# Joins, sets, sorts.


@query("join_intent_meta", "SELECT intent_id, sum(latency_s) AS latency_sum_s, any_value(intent_decision) AS intent_decision FROM acts GROUP BY intent_id", "latency_sum_s")
def join_intent_meta(spark, sf_dir):
    d = cut(intents(spark, sf_dir))
    return metrics.executions(policy.flat_actions(d)).join(apart(d.select("intent_id", "intent_decision").dropDuplicates(["intent_id"])), "intent_id", "left").select("intent_id", "latency_sum_s", "intent_decision")


@query("join_static_features", "SELECT event_ord, g_shortest_to_sensitive_hops FROM feat")
def join_static_features(spark, sf_dir):
    return feats(spark, sf_dir).select("event_ord", "g_shortest_to_sensitive_hops")


@query("semi_eligible", "SELECT event_ord FROM uni WHERE session_id IN (SELECT session_id FROM uni GROUP BY 1 HAVING count(*) >= 10)")
def semi_eligible(spark, sf_dir):
    d = uni(spark, sf_dir)
    return d.join(d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10"), "session_id", "left_semi").select("event_ord")


@query("union_parts", "SELECT event_ord, cloud_provider FROM uni")
def union_parts(spark, sf_dir):
    d, out = uni(spark, sf_dir), None
    for cloud in ("aws", "azure", "gcp"):
        part = d.filter(F.col("cloud_provider") == cloud)
        out = part if out is None else out.unionByName(part)
    return out.select("event_ord", "cloud_provider")


@query("distinct_intents", "SELECT session_id, min(event_ord) AS event_ord FROM uni GROUP BY 1")
def distinct_intents(spark, sf_dir):
    return uni(spark, sf_dir).groupBy("session_id").agg(F.min_by("event_ord", F.struct("event_ord")).alias("event_ord"))


@query("head_n", "SELECT event_ord, action FROM uni WHERE event_ord < 100")
def head_n(spark, sf_dir):
    return uni(spark, sf_dir).filter("event_ord < 100").select("event_ord", "action")


# Models.


@query("time_split", "SELECT event_ord, row_number() OVER (ORDER BY ts, event_ord) <= floor(0.7 * count(*) OVER ()) AS train FROM uni")
def time_split(spark, sf_dir):
    return models.time_split(uni(spark, sf_dir)).select("event_ord", "train")


@query("anom_quantile_scale", f"SELECT event_ord, {oracles.clip('(raw - lo) / (hi - lo)')} AS s_anom FROM (SELECT event_ord, ln(1 + bytes_out) AS raw FROM uni), (SELECT quantile_cont(ln(1 + bytes_out), 0.05) AS lo, quantile_cont(ln(1 + bytes_out), 0.95) AS hi FROM uni)", "s_anom")
def anom_quantile_scale(spark, sf_dir):
    d = uni(spark, sf_dir).withColumn("raw", F.log1p("bytes_out"))
    return models.quantile_scaled(d, d, "raw").select("event_ord", "s_anom")


@query("ecdf_calibrate", "SELECT event_ord, (SELECT count(*) FROM uni t WHERE t.label_attack = 0 AND t.bytes_out <= u.bytes_out) / (SELECT count(*) FROM uni WHERE label_attack = 0) AS p FROM uni u", "p")
def ecdf_calibrate(spark, sf_dir):
    d = uni(spark, sf_dir)
    return models.ecdf(d, d.filter("label_attack = 0"), "bytes_out").select("event_ord", "p")


@query("robust_scale", "SELECT event_ord, (bytes_out - m) / (hi - lo) AS scaled FROM uni, (SELECT median(bytes_out) AS m, quantile_cont(bytes_out, 0.05) AS lo, quantile_cont(bytes_out, 0.95) AS hi FROM uni)", "scaled")
def robust_scale(spark, sf_dir):
    d = uni(spark, sf_dir)
    return models.robust_scaled(d, d, "bytes_out").select("event_ord", "scaled")


@query("feature_matrix", "SELECT event_ord, (bytes_out - m) / s AS z_bytes, (action = 'read' AND action IN (SELECT action FROM uni WHERE ts < (SELECT s1 FROM starts)))::INT AS a_read, (action = 'list' AND action IN (SELECT action FROM uni WHERE ts < (SELECT s1 FROM starts)))::INT AS a_list FROM uni, (SELECT avg(bytes_out) AS m, stddev_pop(bytes_out) AS s FROM uni WHERE ts < (SELECT s1 FROM starts))", "z_bytes")
def feature_matrix(spark, sf_dir):
    d = uni(spark, sf_dir)
    train = d.crossJoin(F.broadcast(policy.stage_starts(d).select("s1"))).filter("ts < s1").drop("s1")
    return models.feature_matrix(d, train, ("action",), ("bytes_out",)).select("event_ord", F.col("z_bytes_out").alias("z_bytes"), F.col("is_action_read").alias("a_read"), F.col("is_action_list").alias("a_list"))


@query("iforest_fit", "SELECT tree, node, f - 1 AS feature, thr AS threshold, 0.0 AS depth FROM fall_split UNION ALL SELECT tree, node, -1, 0.0, depth FROM fall_leaf", "threshold depth")
def iforest_fit(spark, sf_dir):
    return models.iforest_fit(uni(spark, sf_dir), models.RAAC_FEATURES, 160).drop("model", "norm")


@query("iforest_score", "SELECT event_ord, raw_anom FROM sall", "raw_anom")
def iforest_score(spark, sf_dir):
    d = cut(uni(spark, sf_dir))
    return models.iforest_score(d, cut(models.iforest_fit(d, models.RAAC_FEATURES, 160)), models.RAAC_FEATURES).select("event_ord", "raw_anom")


_PERMILLE = "1000 * risk AS risk_permille, 1000 * confidence AS confidence_permille"
permille = lambda: [(1000 * F.col(c)).alias(f"{c}_permille") for c in ("risk", "confidence")]  # noqa: E731  (values of seven places would be rounded at ties)


@query("raac_score", f"SELECT event_ord, s_anom, {_PERMILLE}, decision FROM ownscore", "s_anom risk_permille confidence_permille")
def raac_score(spark, sf_dir):
    return models.raac_score(cut(uni(spark, sf_dir))).select("event_ord", "s_anom", *permille(), "decision")


@query("per_cloud_models", f"SELECT event_ord, cloud_provider AS percloud_provider, CASE WHEN model = '*' THEN 'global' ELSE model END AS percloud_model, {_PERMILLE}, decision FROM cldscore", "risk_permille confidence_permille")
def per_cloud_models(spark, sf_dir):
    return models.per_cloud_score(cut(uni(spark, sf_dir))).select("event_ord", "percloud_provider", "percloud_model", *permille(), "decision")


@query("supervised_fusion")
def supervised_fusion(spark, sf_dir):
    return models.supervised_fusion(scored(spark, sf_dir)).select("event_ord", "risk", "confidence")


@query("unified_score")
def unified_score(spark, sf_dir):
    return models.unified_score(feats(spark, sf_dir)).select("event_ord", "s_anom", "s_rule", "s_graph", "risk", "confidence", "decision")
