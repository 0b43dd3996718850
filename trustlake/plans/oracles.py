"""DuckDB texts that say independently what the queries of queries.py compute."""

from __future__ import annotations

import re

from ..sources.telemetry import DUCKDB

# Fixed values, said here again so that a wrong one in an operator shows.
SENSITIVITY_RISK = {"LOW": 0.05, "MED": 0.15, "HIGH": 0.30, "CRITICAL": 0.45}
ROLE_RISK = {"admin": 0.05, "service": 0.10, "engineer": 0.15, "employee": 0.22, "contractor": 0.28}
ENGINE_DELAY = {"baseline_static": 0.6, "baseline_siem": 1.5, "baseline_raac_iforest": 0.4, "unified": 0.2}
ACTION_SECONDS = {
    "allow": 0.05, "step_up_mfa": 0.2, "shorten_session": 0.15, "restrict_token_scope": 0.25, "isolate_segment": 1.0, "revoke_token": 0.6, "quarantine_endpoint": 2.0, "alert": 0.1,
    "soar_playbook": 1.5, "deny": 0.05,
}
#: Fixed values, said here again: what an action is called at each provider.
CATALOG = {
    "aws": {
        "step_up_mfa": "Enforce MFA step-up via IdP/Conditional Access for this principal",
        "shorten_session": "Issue short-lived session/token (reduce TTL)",
        "restrict_token_scope": "Apply least-privilege session policy / restrict token scope",
        "isolate_segment": "Tighten security group / NACL (micro-segmentation) for workload/device",
        "revoke_token": "Revoke session (disable access key / revoke refresh where applicable)",
        "quarantine_endpoint": "Quarantine endpoint via EDR/SSM integration",
        "alert": "Create security alert (SOC) with context and rationale",
        "soar_playbook": "Trigger SOAR playbook: containment + ticket + evidence capture",
        "deny": "Deny access at PDP/PEP (block request)",
        "allow": "Allow (log decision)",
    },
    "azure": {
        "step_up_mfa": "Enforce Conditional Access step-up MFA for this user/service principal",
        "shorten_session": "Shorten token/session lifetime (CA session controls)",
        "restrict_token_scope": "Limit token scopes / enforce least privilege via policy",
        "isolate_segment": "Isolate via NSG/micro-segmentation; restrict egress",
        "revoke_token": "Revoke refresh tokens / sign-in sessions (Entra ID)",
        "quarantine_endpoint": "Quarantine endpoint via Defender for Endpoint",
        "alert": "Create security alert (Sentinel) with context",
        "soar_playbook": "Trigger SOAR playbook (Sentinel/Logic Apps)",
        "deny": "Deny access (Conditional Access / policy enforcement)",
        "allow": "Allow (log decision)",
    },
    "gcp": {
        "step_up_mfa": "Require MFA step-up (Cloud Identity / context-aware access)",
        "shorten_session": "Shorten token/session TTL (context-aware/session controls)",
        "restrict_token_scope": "Restrict OAuth scopes / reduce permissions (least privilege)",
        "isolate_segment": "Isolate via VPC firewall rules / micro-segmentation",
        "revoke_token": "Revoke access token / disable service account key",
        "quarantine_endpoint": "Quarantine endpoint via EDR integration",
        "alert": "Create security alert (Chronicle/SCC) with context",
        "soar_playbook": "Trigger SOAR playbook (SCC/Chronicle)",
        "deny": "Deny access (policy enforcement)",
        "allow": "Allow (log decision)",
    },
}
BUDGETS = {"false_deny_rate": 0.02, "mfa_friction_rate": 0.17, "latency_p95_ms": 600.0, "policy_error_rate": 0.01, "analyst_override_rate": 0.30}
SIEM_FLAGS = {
    "n_hits": None, "n_bruteforce": ("siem_bruteforce_high", "siem_bruteforce_alert"), "n_time": ("siem_impossible_travel",), "n_priv": ("siem_privilege_escalation",),
    "n_exfil_high": ("siem_exfil_spike_high",), "n_exfil_med": ("siem_exfil_spike_medium",), "n_xcloud": ("siem_cross_cloud_hop",),
}
LEADERBOARD = ("det_accuracy", "det_precision", "det_recall", "det_f1", "det_fpr", "hard_accuracy", "hard_fpr", "access_decision_precision", "avg_response_time_s", "policy_consistency_var")


def _hash(parts: str, modulus: int) -> str:
    return f"(CAST('0x' || substr(sha256({parts}), 1, 12) AS BIGINT) % {modulus})"


_H24 = _hash("principal_id || '|' || cloud_provider || '|' || session_id", 256**3)
IP = f"'10.' || (1 + ({_H24} // 65536) % 254) || '.' || (1 + ({_H24} // 256 % 256) % 254) || '.' || (1 + ({_H24} % 256) % 254)"
_FACTORS = "list_transform(list_sort([{'v': -0.80 * s_anom, 'i': 0, 'n': 'anomaly'}, {'v': -0.50 * s_rule, 'i': 1, 'n': 'rules'}, {'v': -0.70 * s_graph, 'i': 2, 'n': 'graph'}]), lambda f: f.n)"
RATIONALE = f"'Top factors: ' || ({_FACTORS})[1] || ', ' || ({_FACTORS})[2] || CASE WHEN len(rationale_tags) > 0 THEN '; signals: ' || array_to_string(rationale_tags[1:4], ', ') ELSE '' END"


def unit(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('42:' || {text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967295)"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


SENS_SCORE = "CASE WHEN lower(resource_sensitivity) IN ('critical', 'secret') THEN 1.0 WHEN lower(resource_sensitivity) = 'high' THEN 0.75 WHEN lower(resource_sensitivity) IN ('medium', 'med') THEN 0.45 WHEN lower(resource_sensitivity) = 'low' THEN 0.15 ELSE 0.25 END"


def _tags(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


def _levels(rows) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, _, n in rows) + ")"


_T, _S = "role IN ('admin', 'service')", "resource_sensitivity IN ('HIGH', 'CRITICAL')"
_OPEN, _RISKY = f"(resource_sensitivity = 'CRITICAL' AND NOT {_T})", "action IN ('delete', 'admin_change')"
STATIC = [
    (f"({_RISKY} AND role <> 'admin')", "rbac_privileged_op_non_admin", 3), (_OPEN, "abac_critical_resource", 0),
    (f"({_OPEN} AND (mfa_used = 0 OR posture_score < 0.5))", "abac_critical_no_mfa_or_low_posture", 3),
    (f"({_OPEN} AND NOT (mfa_used = 0 OR posture_score < 0.5))", "abac_critical_restrict_non_privileged", 2),
    (f"(raw_privilege_escalation = 1 AND {_S})", "signal_privilege_escalation", 2), (f"(raw_privilege_escalation = 1 AND NOT {_S})", "signal_privilege_escalation", 1),
    ("raw_time_anomaly = 1", "signal_impossible_travel", 2), ("raw_login_failures_5m >= 10", "signal_bruteforce_high", 2),
    ("raw_login_failures_5m BETWEEN 6 AND 9", "signal_bruteforce_medium", 1), ("posture_score < 0.4", "device_low_posture", 2),
    ("(posture_score >= 0.4 AND posture_score < 0.6)", "device_medium_posture", 1), (f"(mfa_used = 0 AND {_S})", "mfa_missing_sensitive", 1),
    (f"(raw_cross_cloud_hop = 1 AND NOT {_T})", "signal_cross_cloud_hop", 1), ("bytes_out >= 100000", "signal_exfil_spike", 2),
    ("(bytes_out >= 33000 AND bytes_out < 100000)", "signal_exfil_medium", 1), (f"(token_scope = 'WIDE' AND {_S} AND NOT {_T})", "token_scope_wide_sensitive", 1),
]
SIEM = [
    ("raw_login_failures_5m >= 10", "siem_bruteforce_high", 2), ("raw_login_failures_5m BETWEEN 5 AND 9", "siem_bruteforce_alert", 1), ("raw_time_anomaly = 1", "siem_impossible_travel", 2),
    (f"(raw_privilege_escalation = 1 AND {_S})", "siem_privilege_escalation", 3), (f"(raw_privilege_escalation = 1 AND NOT {_S})", "siem_privilege_escalation", 2),
    ("raw_api_calls_5m >= 120", "siem_api_burst_high", 2), ("raw_api_calls_5m BETWEEN 60 AND 119", "siem_api_burst_alert", 1), ("bytes_out >= b99", "siem_exfil_spike_high", 3),
    ("(bytes_out >= b95 AND bytes_out < b99)", "siem_exfil_spike_medium", 2), ("raw_cross_cloud_hop = 1", "siem_cross_cloud_hop", 1), ("posture_score < 0.35", "siem_low_posture", 2),
    ("(posture_score >= 0.35 AND posture_score < 0.55)", "siem_medium_posture", 1), (f"(mfa_used = 0 AND {_S})", "siem_mfa_missing_sensitive", 1), (f"(token_scope = 'WIDE' AND {_S})", "siem_wide_scope_sensitive", 2),
]
CORR = [
    ("(n_bruteforce > 0 AND n_time > 0)", "corr_ato_bruteforce_plus_impossible_travel", 3), (f"(n_priv > 0 AND {_S})", "corr_privilege_escalation_on_sensitive", 3),
    ("(n_xcloud > 0 AND (n_exfil_high > 0 OR n_exfil_med >= 2))", "corr_cross_cloud_plus_exfil", 3), ("n_hits >= 3", "corr_multi_signal_escalation", 2),
]


def _case(c: str, values: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _sliding(flag: str, minutes: int) -> str:
    return f"""(sum({flag}) OVER (PARTITION BY principal_id ORDER BY ts, event_ord ROWS UNBOUNDED PRECEDING)
      - coalesce(sum({flag}) OVER (PARTITION BY principal_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND {minutes * 60_000_000 + 1} PRECEDING), 0))"""


def _siem_flag(own) -> str:
    return "CASE WHEN len(row_tags) > 0 THEN 1 ELSE 0 END" if own is None else "CASE WHEN list_has_any(row_tags, [" + ", ".join(f"'{t}'" for t in own) + "]) THEN 1 ELSE 0 END"


_W = "OVER (PARTITION BY principal_id ORDER BY ts, event_ord)"
_METRICS = """count(*) AS rows, count(*) FILTER (y) AS attacks, count(*) FILTER (NOT y) AS benign,
  {det}, {hard}, coalesce(count(*) FILTER (y AND f) / nullif(count(*) FILTER (f), 0), 0.0) AS access_decision_precision, count(*) FILTER (f) / count(*) AS flagged_rate, count(*) FILTER (h) / count(*) AS hard_rate"""


def _binary(prefix: str, p: str) -> str:
    tp, fp, fn, tn = (f"count(*) FILTER ({a} AND {b})" for a, b in (("y", p), ("NOT y", p), ("y", f"NOT {p}"), ("NOT y", f"NOT {p}")))
    d = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0.0)"
    f1 = f"coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0)"
    return f"({tp} + {tn}) / count(*) AS {prefix}_accuracy, {d(tp, f'{tp} + {fp}')} AS {prefix}_precision, {d(tp, f'{tp} + {fn}')} AS {prefix}_recall, {d(fp, f'{fp} + {tn}')} AS {prefix}_fpr, {f1} AS {prefix}_f1"


SUMMARY = _METRICS.format(det=_binary("det", "f"), hard=_binary("hard", "h"))
_FLAGS = "label_attack = 1 AS y, decision IN ('stepup', 'restrict', 'deny') AS f, decision IN ('restrict', 'deny') AS h"
SUMMARY_DOUBLES = [f"{p}_{m}" for p in ("det", "hard") for m in ("accuracy", "precision", "recall", "fpr", "f1")] + ["access_decision_precision", "flagged_rate", "hard_rate"]

_ids = {
    "cloud": "'cloud:' || cloud_provider", "tenant": "'tenant:' || cloud_provider || ':' || tenant_id", "region": "'region:' || cloud_provider || ':' || region", "principal": "'principal:' || principal_id",
    "role": "'role:' || role", "device": "'device:' || device_id", "workload": "'workload:' || workload_id", "resource": "'resource:' || resource_id", "session": "'session:' || session_id",
    "token": "'token:' || token_id", "api": "'api:' || api",
}
_plain = [("connected-to", "tenant", "cloud"), ("connected-to", "region", "cloud"), ("connected-to", "principal", "tenant"), ("assumed-role", "principal", "role"), ("connected-to", "principal", "device"),
          ("connected-to", "principal", "workload"), ("connected-to", "resource", "region"), ("connected-to", "principal", "session"), ("token-issued", "session", "token"), ("called-api", "principal", "api")]

RAAC_FINAL = f"SELECT *, {clip('0.75 * (1 - abs(s_ctx - s_anom)) + 0.25 * (1 - abs(risk - 0.5) * 2)')} AS confidence, CASE WHEN risk >= 0.75 THEN 'deny' WHEN risk >= 0.55 THEN 'restrict' WHEN risk >= 0.35 THEN 'stepup' ELSE 'allow' END AS decision FROM {{source}}"

#: Named steps; each may use those before it.
CTES = {
    "tele": DUCKDB,
    "uni": f"""SELECT * EXCLUDE (ts, action), date_trunc('second', ts) AS ts, action, lower(resource_type || ':' || action) AS api, action AS operation,
        'wk_' || lpad(CAST({_hash("principal_id || '|' || cloud_provider", 10**8)} AS VARCHAR), 8, '0') AS workload_id,
        'tok_' || lpad(CAST({_hash("principal_id || '|' || session_id", 10**10)} AS VARCHAR), 10, '0') AS token_id,
        12 * ln(1 + bytes_out) + {_hash("strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || printf('%.2f', bytes_out) || '|' || principal_id || '|' || action", 5000)} / 100 AS latency_ms
        FROM tele""",
    "static": f"""SELECT *, {clip(f"{_case('resource_sensitivity', SENSITIVITY_RISK)} + {_case('role', ROLE_RISK)} + CASE WHEN mfa_used = 0 AND resource_sensitivity <> 'LOW' THEN 0.18 ELSE 0 END + CASE WHEN posture_score < 0.4 THEN 0.28 WHEN posture_score < 0.6 THEN 0.14 ELSE 0 END + CASE WHEN raw_login_failures_5m >= 10 THEN 0.22 WHEN raw_login_failures_5m >= 6 THEN 0.12 ELSE 0 END + 0.22 * raw_time_anomaly + 0.30 * raw_privilege_escalation + 0.16 * raw_cross_cloud_hop + CASE WHEN bytes_out >= 100000 THEN 0.32 WHEN bytes_out >= 33000 THEN 0.16 ELSE 0 END + CASE WHEN {_RISKY} AND role <> 'admin' THEN 0.38 WHEN {_RISKY} THEN 0.08 ELSE 0 END + CASE WHEN token_scope = 'WIDE' AND NOT {_T} THEN 0.10 ELSE 0 END")} AS risk,
        [0.60, 0.65, 0.80, 0.90][{_levels(STATIC)} + 1] AS confidence, ['allow', 'stepup', 'restrict', 'deny'][{_levels(STATIC)} + 1] AS decision,
        list_sort(list_distinct({_tags([(c, t) for c, t, _ in STATIC])})) AS rationale_tags FROM uni""",
    "thresholds": "SELECT greatest(1.0, quantile_cont(bytes_out, 0.95)) AS b95, greatest(1.0, quantile_cont(bytes_out, 0.95), quantile_cont(bytes_out, 0.99)) AS b99 FROM uni",
    "siemrows": f"SELECT *, {_tags([(c, t) for c, t, _ in SIEM])} AS row_tags, {_levels(SIEM)} AS row_severity FROM uni, thresholds",
    "siemwin": "SELECT *, " + ", ".join(f"CAST({_sliding(f'({_siem_flag(own)})', 15)} AS BIGINT) AS {n}" for n, own in SIEM_FLAGS.items()) + " FROM siemrows",
    "siemcorr": f"SELECT *, list_sort(list_distinct(list_concat(row_tags, {_tags([(c, t) for c, t, _ in CORR])}))) AS rationale_tags, greatest(row_severity, {_levels(CORR)}) AS siem_severity FROM siemwin",
    "siem": f"""SELECT *, {clip("[0.20, 0.50, 0.75, 0.92][siem_severity + 1] + 0.02 * least(6, len(rationale_tags))")} AS risk, {clip("[0.50, 0.55, 0.62, 0.70][siem_severity + 1] + 0.05 * least(4, len(rationale_tags))")} AS confidence,
        ['allow', 'stepup', 'restrict', 'deny'][siem_severity + 1] AS decision FROM siemcorr""",
    "geof": f"""SELECT *, CASE WHEN lag(geo) {_W} <> geo THEN 1 ELSE 0 END AS f_geo_switch, lag(ts) {_W} AS before_ts FROM uni""",
    "geo2": "SELECT * EXCLUDE (before_ts), CASE WHEN f_geo_switch = 1 AND epoch_us(ts) - epoch_us(before_ts) <= 3600000000 THEN 1 ELSE 0 END AS f_fast_geo_switch FROM geof",
    "hist": """SELECT *, array_agg(posture_score) OVER (PARTITION BY device_id ORDER BY ts, event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hp,
        array_agg(bytes_out) OVER (PARTITION BY principal_id ORDER BY ts, event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hb FROM geo2""",
    "folds": "SELECT * EXCLUDE (hp, hb), abs(posture_score - list_reduce(hp, lambda m, x: 0.8 * m + 0.2 * x)) AS f_posture_drift, bytes_out - list_reduce(hb, lambda m, x: 0.8 * m + 0.2 * x) AS dev FROM hist",
    "folds2": "SELECT *, array_agg(dev * dev) OVER (PARTITION BY principal_id ORDER BY ts, event_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hv FROM folds",
    "spike": "SELECT * EXCLUDE (hv, dev), dev / (sqrt(list_reduce(list_concat([CAST(0 AS DOUBLE)], hv), lambda m, x: 0.8 * m + 0.2 * x)) + 1e-6) AS f_bytes_spike_score FROM folds2",
    "firsts": """SELECT *, CASE WHEN row_number() OVER (PARTITION BY session_id, cloud_provider ORDER BY ts, event_ord) = 1 THEN 1 ELSE 0 END AS fc,
        CASE WHEN row_number() OVER (PARTITION BY principal_id, resource_id ORDER BY ts, event_ord) = 1 THEN 1 ELSE 0 END AS g_is_new_resource_edge FROM spike""",
    "feat0": f"""SELECT * EXCLUDE (fc), CAST(sum(fc) OVER (PARTITION BY session_id ORDER BY ts, event_ord) - 1 AS BIGINT) AS g_cross_cloud_hops_session,
        CAST({_sliding('g_is_new_resource_edge', 30)} AS BIGINT) AS g_new_resource_count_win, 1 AS f_token_scope_width, ln(1 + bytes_out) AS f_bytes_out_log1p,
        CASE WHEN role = 'admin' THEN 1 ELSE 0 END AS f_is_privileged_role, CAST(raw_login_failures_5m AS DOUBLE) AS f_failed_logins_5m, coalesce(CAST(token_age AS DOUBLE), 0) AS f_token_age FROM firsts""",
    "nodeev": " UNION ALL ".join(f"SELECT ts, event_ord, {i} AS node_id, '{k}' AS node_type, {'resource_sensitivity' if k == 'resource' else 'NULL'} AS sensitivity FROM uni" for k, i in _ids.items()),
    "edgeev": " UNION ALL ".join(
        [f"SELECT ts, event_ord, cloud_provider, access_result, label_attack, '{k}' AS edge_type, {_ids[a]} AS src_id, {_ids[b]} AS dst_id, '' AS sensitivity, 0.0 AS bytes_out FROM uni" for k, a, b in _plain]
        + [f"SELECT ts, event_ord, cloud_provider, access_result, label_attack, '{k}' AS edge_type, {_ids['principal']} AS src_id, {_ids['resource']} AS dst_id, resource_sensitivity AS sensitivity, bytes_out FROM uni WHERE {w}"
           for k, w in (("accessed", "TRUE"), ("data-read", "(action IN ('read', 'download', 'list') OR bytes_out > 0)"))]
    ),
    "nodes": "SELECT node_id, node_type, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(sensitivity, (ts, event_ord)) AS sensitivity FROM nodeev GROUP BY node_id, node_type",
    "edges": """SELECT src_id, edge_type, dst_id, cloud_provider, count(*) AS event_count, count(*) FILTER (access_result = 'permit') AS permit_count, count(*) FILTER (access_result = 'deny') AS deny_count,
        count(*) FILTER (access_result = 'restrict') AS restrict_count, count(*) FILTER (label_attack = 1) AS attack_count, sum(bytes_out) AS bytes_out_sum, min(ts) AS first_seen, max(ts) AS last_seen,
        src_id || '::' || edge_type || '::' || dst_id || '::' || cloud_provider AS edge_key FROM edgeev GROUP BY src_id, edge_type, dst_id, cloud_provider""",
    "sens": "SELECT node_id FROM nodes WHERE node_type = 'resource' AND lower(sensitivity) IN ('high', 'critical', 'secret')",
    "near": "SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges",
    "d0": "SELECT node_id AS node, 0 AS hops FROM sens",
    **{f"d{i}": f"SELECT node, min(hops) AS hops FROM (SELECT * FROM d{i - 1} UNION ALL SELECT b, hops + 1 FROM d{i - 1} JOIN near ON node = a) GROUP BY node" for i in range(1, 7)},
    "r0": "SELECT node_id AS node, node_id AS goal FROM sens",
    **{f"r{i}": f"SELECT node, goal FROM r{i - 1} UNION SELECT b, goal FROM r{i - 1} JOIN near ON node = a" for i in range(1, 4)},
    "principals": "SELECT node_id AS node FROM nodes WHERE node_type = 'principal'",
    "back0": "SELECT node_id AS node, 0 AS hops FROM sens",
    **{f"back{i}": f"SELECT node, min(hops) AS hops FROM (SELECT * FROM back{i - 1} UNION ALL SELECT src_id, hops + 1 FROM back{i - 1} JOIN edges ON node = dst_id) GROUP BY node" for i in range(1, 7)},
    "nextof": "SELECT src_id AS node, min(dst_id) AS nxt FROM edges JOIN back6 a ON a.node = src_id JOIN back6 b ON b.node = dst_id WHERE b.hops = a.hops - 1 GROUP BY 1",
    "walk": "SELECT p.node AS start, r.hops, coalesce(n6.nxt, n5.nxt, n4.nxt, n3.nxt, n2.nxt, n1.nxt, p.node) AS goal, concat_ws('>', p.node, n1.nxt, n2.nxt, n3.nxt, n4.nxt, n5.nxt, n6.nxt) AS path FROM principals p JOIN back6 r USING (node) LEFT JOIN nextof n1 ON n1.node = p.node "
    + " ".join(f"LEFT JOIN nextof n{i} ON n{i}.node = n{i - 1}.nxt" for i in range(2, 7)),
    "gfeat": """SELECT substr(p.node, 11) AS principal_id, coalesce(d.hops, -1) AS g_shortest_to_sensitive_hops, (SELECT count(DISTINCT goal) FROM r3 WHERE r3.node = p.node AND goal <> p.node) AS g_blast_radius_sensitive_k
        FROM principals p LEFT JOIN d6 d USING (node)""",
    "feat": "SELECT f.*, g_new_resource_count_win / 30.0 AS g_new_resource_rate_win, g_shortest_to_sensitive_hops, g_blast_radius_sensitive_k FROM feat0 f JOIN gfeat USING (principal_id)",
    "parts": f"""SELECT *, {clip("0.30 * least(1.0, f_failed_logins_5m / 3.0) + 0.25 * f_fast_geo_switch + 0.20 * " + clip("f_bytes_spike_score / 2.5") + " + 0.15 * least(1.0, f_posture_drift / 0.25) + 0.10 * f_is_privileged_role * CASE WHEN " + _S + " THEN 1.0 ELSE 0.5 END")} AS s_rule,
        {_tags([("f_failed_logins_5m >= 3", "failed_logins_spike"), ("f_fast_geo_switch >= 1", "fast_geo_switch"), ("f_bytes_spike_score >= 2.5", "bytes_exfil_spike"), ("f_posture_drift >= 0.25", "device_posture_drift"), (f"(f_is_privileged_role >= 1 AND {_S})", "privileged_sensitive_access")])} AS rule_tags,
        {clip("0.30 * least(1.0, g_cross_cloud_hops_session / 2.0) + 0.25 * g_is_new_resource_edge + 0.20 * least(1.0, g_new_resource_rate_win) + 0.15 * CASE WHEN g_shortest_to_sensitive_hops < 0 THEN 0.0 ELSE " + clip("(3 - g_shortest_to_sensitive_hops) / 3.0") + " END + 0.10 * least(1.0, g_blast_radius_sensitive_k / 15.0)")} AS s_graph,
        {_tags([("g_cross_cloud_hops_session >= 1", "cross_cloud_hop"), ("g_is_new_resource_edge >= 1", "new_resource_edge"), ("g_new_resource_rate_win >= 1", "new_edge_rate_spike"), ("g_shortest_to_sensitive_hops BETWEEN 0 AND 2", "close_to_sensitive_resource"), ("g_blast_radius_sensitive_k >= 15", "large_blast_radius")])} AS graph_tags,
        ((event_ord * 37 % 97) + 0.5) / 97.1 AS s_anom0 FROM feat""",
    "scored0": "SELECT *, CAST(least(1.0, s_anom0) AS DOUBLE) AS s_anom, (least(1.0, s_anom0) + s_rule + s_graph) / 3 AS mu FROM parts",
    "scored1": f"""SELECT *, 1 / (1 + exp(-(0.80 * s_anom + 0.50 * s_rule + 0.70 * s_graph - 1.0))) AS risk, list_filter(list_concat(rule_tags, graph_tags), lambda x: TRUE) AS rationale_tags,
        {clip("0.55 * " + clip("1 - sqrt(((s_anom - mu) ** 2 + (s_rule - mu) ** 2 + (s_graph - mu) ** 2) / 3) / 0.5") + " + 0.45 * " + clip("1 - 4 * mu * (1 - mu)"))} AS confidence FROM scored0""",
    "scored": "SELECT *, CASE WHEN risk < 0.58 THEN 'allow' WHEN risk < 0.62 THEN 'stepup' WHEN risk < 0.66 THEN 'restrict' WHEN risk >= 0.68 AND confidence >= 0.55 THEN 'deny' ELSE 'restrict' END AS decision FROM scored1",
    "raac0": f"SELECT *, {clip(f'0.30 * ' + clip('(0.5 - posture_score) / 0.5') + f' + 0.20 * (1 - mfa_used) + 0.15 * raw_time_anomaly + 0.20 * raw_privilege_escalation + 0.15 * {SENS_SCORE}')} AS s_ctx, least(1.0, ((event_ord * 37 % 97) + 0.5) / 97.1) AS s_anom FROM uni",
    "raac1": f"SELECT *, {clip('0.55 * s_ctx + 0.45 * s_anom')} AS risk FROM raac0",
    "raac": RAAC_FINAL.format(source="raac1"),
    "tq": "SELECT quantile_cont(risk, 0.95) AS q1, quantile_cont(risk, 0.98) AS q2, quantile_cont(risk, 0.995) AS q3 FROM scored WHERE label_attack = 0",
    "th": "SELECT q1 AS t_allow, q1 AS t_stepup, greatest(q1, q2) AS t_restrict, greatest(q1, q2, q3) AS t_deny FROM tq",
    "tuned": "SELECT s.*, CASE WHEN risk >= t_deny THEN 'deny' WHEN risk >= t_restrict THEN 'restrict' WHEN risk >= t_stepup THEN 'stepup' ELSE 'allow' END AS decision_tuned FROM scored s, th",
    "intents": """SELECT *, 'intent_' || event_ord AS intent_id, decision_tuned AS intent_decision,
        CASE decision_tuned WHEN 'allow' THEN ['allow'] WHEN 'restrict' THEN ['restrict_token_scope', 'isolate_segment', 'alert'] WHEN 'deny' THEN ['deny', 'revoke_token', 'quarantine_endpoint', 'soar_playbook']
        ELSE CASE WHEN list_contains(rationale_tags, 'cross_cloud_hop') THEN ['step_up_mfa', 'shorten_session', 'restrict_token_scope', 'alert'] ELSE ['step_up_mfa', 'shorten_session', 'restrict_token_scope'] END END AS action_list FROM tuned""",
    "acts0": "SELECT *, unnest(action_list) AS action_type, generate_subscripts(action_list, 1) - 1 AS action_index FROM intents",
    "acts1": f"SELECT *, {_case('action_type', ACTION_SECONDS)} AS latency_s FROM acts0",
    "acts": "SELECT *, sum(latency_s) OVER (PARTITION BY intent_id ORDER BY action_index) AS finished_s FROM acts1",
    "starts": "SELECT s0, s1, s2, (SELECT min(ts) FROM uni WHERE ts >= s2 + INTERVAL 3 DAY) AS s3 FROM (SELECT s0, s1, (SELECT min(ts) FROM uni WHERE ts >= s1 + INTERVAL 3 DAY) AS s2 FROM (SELECT s0, (SELECT min(ts) FROM uni WHERE ts >= s0 + INTERVAL 7 DAY) AS s1 FROM (SELECT min(ts) AS s0 FROM uni)))",
    "st0": "SELECT i.*, CASE WHEN s1 IS NULL OR ts < s1 THEN 'shadow' WHEN s2 IS NULL OR ts < s2 THEN 'canary' WHEN s3 IS NULL OR ts < s3 THEN 'enforce' ELSE 'rollout' END AS stage FROM intents i, starts",
    "st1": f"SELECT *, CASE stage WHEN 'shadow' THEN FALSE WHEN 'canary' THEN {unit('session_id')} < 0.05 WHEN 'enforce' THEN cloud_provider = 'aws' ELSE TRUE END AS enforced FROM st0",
    "st": "SELECT *, CASE WHEN enforced THEN intent_decision ELSE 'allow' END AS effective_decision, CASE WHEN stage = 'shadow' THEN intent_decision WHEN enforced THEN intent_decision ELSE 'allow' END AS eff, enforced OR stage = 'shadow' AS inn FROM st1",
    "kpi": f"""SELECT stage, count(*) AS n_events, avg(inn::INT) AS enforced_fraction, coalesce(avg((label_attack = 0 AND eff = 'deny')::INT) FILTER (inn), 0) AS false_deny_rate,
        coalesce(avg((eff = 'stepup')::INT) FILTER (inn), 0) AS mfa_friction_rate,
        coalesce(quantile_cont(latency_ms + CASE eff WHEN 'stepup' THEN 150 WHEN 'restrict' THEN 300 WHEN 'deny' THEN 50 ELSE 0 END, 0.95) FILTER (inn), 0) AS latency_p95_ms,
        coalesce(avg(({unit('CAST(event_ord AS VARCHAR)')} < CASE eff WHEN 'stepup' THEN 0.003 WHEN 'restrict' THEN 0.005 WHEN 'deny' THEN 0 ELSE 0.0002 END)::INT) FILTER (inn), 0) AS policy_error_rate,
        coalesce(avg((eff IN ('restrict', 'deny') AND confidence < 0.35)::INT) FILTER (inn), 0) AS analyst_override_rate FROM st GROUP BY stage""",
    "kpic": "SELECT *, CASE stage WHEN 'shadow' THEN 1 WHEN 'canary' THEN 2 WHEN 'enforce' THEN 3 ELSE 4 END AS stage_no, " + _tags([(f"{k} > {v}", k) for k, v in BUDGETS.items()]) + " AS reasons FROM kpi",
    "line": "SELECT * FROM kpic WHERE stage_no <= coalesce((SELECT min(stage_no) FROM kpic WHERE len(reasons) > 0), 9)",
    "engines0": " UNION ALL ".join(
        f"SELECT '{name}' AS engine, event_ord, principal_id, session_id, cloud_provider, label_attack, decision, {x} > 0.5 AS x, CAST({blast} AS DOUBLE) AS blast, {hop} AS hop FROM {source}"
        for name, source, x, blast, hop in (
            ("baseline_static", "static", "raw_cross_cloud_hop", "NULL", "FALSE"), ("baseline_siem", "siem", "raw_cross_cloud_hop", "NULL", "FALSE"), ("baseline_raac_iforest", "raac", "raw_cross_cloud_hop", "NULL", "FALSE"),
            ("unified", "scored", "g_cross_cloud_hops_session", "greatest(0, g_blast_radius_sensitive_k)", "list_contains(rationale_tags, 'cross_cloud_hop')"),
        )
    ),
    "engines": f"SELECT e.*, {_FLAGS} FROM engines0 e",
    "esum": f"SELECT engine, {SUMMARY} FROM engines GROUP BY engine",
    "ecloud": "SELECT engine, principal_id, cloud_provider, avg(CASE decision WHEN 'stepup' THEN 1 WHEN 'restrict' THEN 2 WHEN 'deny' THEN 3 ELSE 0 END) AS s, avg((decision = 'deny')::INT) AS d, count(*) AS n FROM engines GROUP BY ALL",
    "econ": "SELECT engine, avg(s) AS policy_consistency_var, avg(d) AS deny_rate_var FROM (SELECT engine, principal_id, var_pop(s) AS s, var_pop(d) AS d, sum(n) AS n FROM ecloud GROUP BY ALL) WHERE n >= 10 GROUP BY engine",
    "etime": f"SELECT engine, CAST({_case('engine', ENGINE_DELAY)} AS DOUBLE) + CASE decision WHEN 'stepup' THEN CASE WHEN hop THEN 0.7 ELSE 0.6 END WHEN 'restrict' THEN 1.35 ELSE 4.15 END AS rt FROM engines WHERE decision <> 'allow'",
    "emean": "SELECT engine, avg(rt) AS avg_response_time_s, avg(rt) AS mttr_proxy_s, quantile_cont(rt, 0.95) AS p95_response_time_s, count(*) AS latency_count FROM etime GROUP BY engine",
    "exc": "SELECT engine, count(*) FILTER (x) AS xcloud_events, count(*) FILTER (x AND y) AS xcloud_attacks, coalesce(count(*) FILTER (x AND y AND f) / nullif(count(*) FILTER (x AND y), 0), 0.0) AS xcloud_flagged_tpr, coalesce(count(*) FILTER (x AND y AND h) / nullif(count(*) FILTER (x AND y), 0), 0.0) AS xcloud_hard_tpr FROM engines GROUP BY engine",
    "eafter": "SELECT engine, avg(blast) AS mean_blast_before, avg(blast * (1 - CASE decision WHEN 'stepup' THEN 0.1 WHEN 'restrict' THEN 0.45 WHEN 'deny' THEN 0.75 ELSE 0 END)) AS mean_blast_after FROM engines WHERE y GROUP BY engine",
    "eblast": "SELECT *, CASE WHEN mean_blast_before > 0 THEN 100 * (1 - mean_blast_after / mean_blast_before) WHEN mean_blast_before = 0 THEN 0.0 END AS blast_radius_reduction_pct FROM eafter",
    "eroll": "SELECT 'unified' AS engine, " + ", ".join(f"max({c}) FILTER (stage = '{s}') AS {s}_{c}" for s in ("canary", "rollout") for c in ("false_deny_rate", "mfa_friction_rate", "latency_p95_ms")) + " FROM line",
    "board": """SELECT s.*, policy_consistency_var, deny_rate_var, coalesce(avg_response_time_s, 0) AS avg_response_time_s, coalesce(mttr_proxy_s, 0) AS mttr_proxy_s, coalesce(p95_response_time_s, 0) AS p95_response_time_s,
        coalesce(latency_count, 0) AS latency_count, x.* EXCLUDE (engine), b.* EXCLUDE (engine), r.* EXCLUDE (engine)
        FROM esum s LEFT JOIN econ USING (engine) LEFT JOIN emean USING (engine) LEFT JOIN exc x USING (engine) LEFT JOIN eblast b USING (engine) LEFT JOIN eroll r USING (engine)""",
    "long": "SELECT engine, metric, value FROM (UNPIVOT (SELECT engine, " + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in LEADERBOARD) + " FROM board) ON " + ", ".join(LEADERBOARD) + " INTO NAME metric VALUE value)",
}


# Isolation forests, level by level: each row's draw gives its trees, a node's split is a hash of tree and node, and the last level's
# nodes hold the expected depths.

RAAC_FEATURES = ("bytes_out", "latency_ms", "token_age", "posture_score", "raw_login_failures_5m", "raw_api_calls_5m")


def _expected(n: str) -> str:
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"


def forest(name: str, source: str, model: str, trees: int = 160, psi: int = 256, levels: int = 8) -> dict[str, str]:
    """Steps <name>_leaf (model, tree, node, depth), <name>_split (model, tree, node, f, thr) and <name>_norm (model, norm) of a forest
    over source; model: the text of each row's model."""
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in RAAC_FEATURES) + "]"
    steps = {
        f"{name}_rows": f"SELECT {model} AS model, event_ord, {x} AS x, {unit("'row:' || event_ord")} AS u FROM {source}",
        f"{name}_norm": f"SELECT model, n, least(1.0, {psi}.0 / n) AS w, CASE WHEN n > 1 THEN {_expected(f'least(n, {psi})')} ELSE 1.0 END AS norm FROM (SELECT model, count(*) AS n FROM {name}_rows GROUP BY 1)",
        f"{name}_s0": f"SELECT model, ((t % {trees}) + {trees}) % {trees} AS tree, 1 AS node, x FROM (SELECT model, x, unnest(generate_series(CAST(floor((u - w) * {trees}) AS INT) + 1, CAST(floor(u * {trees}) AS INT))) AS t FROM {name}_rows JOIN {name}_norm USING (model))",
    }
    for k in range(levels):
        lows = ", ".join(f"min(x[{i}])" for i in range(1, len(RAAC_FEATURES) + 1))
        highs = lows.replace("min", "max")
        key = "tree || ':' || node || "
        steps[f"{name}_m{k}"] = f"SELECT model, tree, node, count(*) AS n, [{lows}] AS lo, [{highs}] AS hi FROM {name}_s{k} WHERE node >= {2**k} GROUP BY model, tree, node"
        steps[f"{name}_w{k}"] = f"SELECT *, list_filter([{', '.join(map(str, range(1, len(RAAC_FEATURES) + 1)))}], lambda i: hi[i] > lo[i]) AS wide FROM {name}_m{k} WHERE n > 1"
        steps[f"{name}_f{k}"] = f"SELECT model, tree, node, lo, hi, wide[1 + least(len(wide) - 1, CAST(floor({unit(key + repr(':f'))} * len(wide)) AS INT))] AS f, {unit(key + repr(':t'))} AS ut FROM {name}_w{k} WHERE len(wide) > 0"
        steps[f"{name}_p{k}"] = f"SELECT model, tree, node, f, CASE WHEN lo[f] + ut * (hi[f] - lo[f]) <= lo[f] THEN hi[f] ELSE lo[f] + ut * (hi[f] - lo[f]) END AS thr FROM {name}_f{k}"
        steps[f"{name}_s{k + 1}"] = f"SELECT s.model, s.tree, 2 * s.node + (s.x[p.f] >= p.thr)::INT AS node, s.x FROM {name}_s{k} s JOIN {name}_p{k} p USING (model, tree, node)"
    steps[f"{name}_split"] = " UNION ALL ".join(f"SELECT * FROM {name}_p{k}" for k in range(levels))
    steps[f"{name}_leaf"] = " UNION ALL ".join(
        [f"SELECT model, tree, node, {k} + {_expected('n')} AS depth FROM {name}_m{k} m ANTI JOIN {name}_p{k} USING (model, tree, node)" for k in range(levels)]
        + [f"SELECT model, tree, node, {levels} + {_expected('count(*)')} AS depth FROM {name}_s{levels} GROUP BY model, tree, node"]
    )
    return steps


def forest_scores(out: str, name: str, source: str, model: str, trees: int = 160, levels: int = 8) -> dict[str, str]:
    """Step <out>: event_ord, model, raw_anom of source's rows, each walked down all trees of its model."""
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in RAAC_FEATURES) + "]"
    steps = {f"{out}_0": f"SELECT event_ord, {model} AS model, {x} AS x, unnest(generate_series(0, {trees - 1})) AS tree, 1 AS node FROM {source}"}
    for k in range(levels):
        steps[f"{out}_{k + 1}"] = f"SELECT a.event_ord, a.model, a.x, a.tree, CASE WHEN p.f IS NULL THEN a.node ELSE 2 * a.node + (a.x[p.f] >= p.thr)::INT END AS node FROM {out}_{k} a LEFT JOIN {name}_split p USING (model, tree, node)"
    steps[out] = f"SELECT event_ord, model, 2 ** -(sum(depth) / {trees} / any_value(norm)) AS raw_anom FROM {out}_{levels} JOIN {name}_leaf USING (model, tree, node) JOIN {name}_norm USING (model) GROUP BY event_ord, model"
    return steps


CTES |= forest("fall", "uni", "'all'") | forest_scores("sall", "fall", "uni", "'all'")
CTES |= {
    "btrain": "SELECT * FROM uni WHERE label_attack = 0 OR (SELECT count(*) FILTER (label_attack = 0) < greatest(200, 0.1 * count(*)) FROM uni)",
    **forest("fben", "btrain", "'all'"), **forest_scores("sben", "fben", "uni", "'all'"),
    "qben": "SELECT quantile_cont(raw_anom, 0.05) AS lo, quantile_cont(raw_anom, 0.95) AS hi FROM sben JOIN btrain USING (event_ord)",
    "own0": f"SELECT * EXCLUDE (s_anom), {clip('(raw_anom - lo) / greatest(hi - lo, 1e-6)')} AS s_anom FROM raac0 JOIN sben USING (event_ord), qben",
    "own1": f"SELECT *, {clip('0.55 * s_ctx + 0.45 * s_anom')} AS risk FROM own0",
    "ownscore": RAAC_FINAL.format(source="own1"),
    "bigcloud": "SELECT cloud_provider FROM btrain GROUP BY 1 HAVING count(*) >= 400",
    "cloudrows": "SELECT u.*, CASE WHEN b.cloud_provider IS NULL THEN '*' ELSE u.cloud_provider END AS m FROM uni u LEFT JOIN bigcloud b USING (cloud_provider)",
    "cloudtrain": "SELECT * EXCLUDE (m), m FROM cloudrows WHERE m <> '*' AND event_ord IN (SELECT event_ord FROM btrain) UNION ALL SELECT * EXCLUDE (m), '*' AS m FROM cloudrows WHERE event_ord IN (SELECT event_ord FROM btrain)",
}
CTES |= forest("fcld", "cloudtrain", "m") | forest_scores("scld", "fcld", "cloudrows", "m") | forest_scores("stcl", "fcld", "cloudtrain", "m")
CTES |= {
    "qcld": "SELECT model, quantile_cont(raw_anom, 0.05) AS lo, quantile_cont(raw_anom, 0.95) AS hi FROM stcl GROUP BY model",
    "cld0": f"SELECT * EXCLUDE (s_anom), {clip('(raw_anom - lo) / greatest(hi - lo, 1e-6)')} AS s_anom FROM raac0 JOIN scld USING (event_ord) JOIN qcld USING (model)",
    "cld1": f"SELECT *, {clip('0.55 * s_ctx + 0.45 * s_anom')} AS risk FROM cld0",
    "cldscore": RAAC_FINAL.format(source="cld1"),
}


def text(final: str, doubles: tuple[str, ...] | list[str] = ()) -> str:
    """final, with the named steps that it needs before it, and the given columns rounded to six places."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", re.sub(r"'[^']*'", "", sql)) and CTES[name] is not sql:
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(final)
    order = [n for n in CTES if n in needed]
    rounded = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles)}) FROM ({final})" if doubles else final
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" if order else "") + rounded
