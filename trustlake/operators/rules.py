"""Rule scorers: static policy rules, correlation rules over a sliding window, and the rule and graph components of the unified score.

Each takes events and returns them with risk, confidence, decision and tags (array; in the order the rules are listed unless said)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from .lineage import apart, cut
from .ordered import hot_keys, prepared, sliding_counts
from .quantiles import quantiles

#: Risk of a sensitivity and of a role.
SENSITIVITY_RISK = {"LOW": 0.05, "MED": 0.15, "HIGH": 0.30, "CRITICAL": 0.45}
ROLE_RISK = {"admin": 0.05, "service": 0.10, "engineer": 0.15, "employee": 0.22, "contractor": 0.28}

#: What a column that a log lacks counts as.
DEFAULTS = {
    "role": "employee", "resource_sensitivity": "LOW", "mfa_used": 0, "posture_score": 1.0, "action": "", "token_scope": "NARROW", "raw_login_failures_5m": 0, "raw_api_calls_5m": 0,
    "raw_time_anomaly": 0, "raw_privilege_escalation": 0, "raw_cross_cloud_hop": 0, "bytes_out": 0.0, "principal_id": "unknown",
}


def _inputs(df: DataFrame) -> DataFrame:
    df = S.with_defaults(df, DEFAULTS)
    return df.withColumns({
        "_role": S.role_level(F.col("role")), "_sens": S.sensitivity_level(F.col("resource_sensitivity")), "_mfa": F.least(F.lit(1), F.greatest(F.lit(0), S.number(F.col("mfa_used")).cast("int"))),
        "_posture": S.clip01(S.number(F.col("posture_score"), 1.0)), "_action": F.lower(F.coalesce("action", F.lit(""))), "_scope": F.upper(F.coalesce("token_scope", F.lit("NARROW"))),
        "_fails": S.number(F.col("raw_login_failures_5m")).cast("int"), "_calls": S.number(F.col("raw_api_calls_5m")).cast("int"), "_time": S.number(F.col("raw_time_anomaly")) == 1,
        "_priv": S.number(F.col("raw_privilege_escalation")) == 1, "_hop": S.number(F.col("raw_cross_cloud_hop")) == 1, "_bytes": S.number(F.col("bytes_out")),
    })


def _pick(c, values: dict):
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def _dropped(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])


def static_rules(df: DataFrame, posture_restrict=0.40, posture_stepup=0.60, fails_stepup=6, fails_restrict=10, bytes_p95=33000.0, bytes_p99=100000.0) -> DataFrame:
    """risk (s_rule), confidence, decision, rationale_tags (sorted) of the static rules: deny before restrict before step-up."""
    d = _inputs(df)
    role, sens, c = F.col("_role"), F.col("_sens"), F.col
    trusted, sensitive, critical = role.isin("admin", "service"), sens.isin("HIGH", "CRITICAL"), sens == "CRITICAL"
    risky = c("_action").isin("delete", "admin_change")
    two = lambda high, a, mid, b: F.when(high, a).when(mid, b).otherwise(0.0)
    risk = (
        _pick(sens, SENSITIVITY_RISK) + _pick(role, ROLE_RISK) + F.when((c("_mfa") == 0) & (sens != "LOW"), 0.18).otherwise(0.0)
        + two(c("_posture") < posture_restrict, 0.28, c("_posture") < posture_stepup, 0.14) + two(c("_fails") >= fails_restrict, 0.22, c("_fails") >= fails_stepup, 0.12)
        + F.when(c("_time"), 0.22).otherwise(0.0) + F.when(c("_priv"), 0.30).otherwise(0.0) + F.when(c("_hop"), 0.16).otherwise(0.0)
        + two(c("_bytes") >= bytes_p99, 0.32, c("_bytes") >= bytes_p95, 0.16) + two(risky & (role != "admin"), 0.38, risky, 0.08)
        + F.when((c("_scope") == "WIDE") & ~trusted, 0.10).otherwise(0.0)
    )
    open_critical = critical & ~trusted
    weak = (c("_mfa") == 0) | (c("_posture") < 0.50)
    rules = [  # fixed values: (condition, tag, level: 3 deny, 2 restrict, 1 step-up, 0 none)
        (risky & (role != "admin"), "rbac_privileged_op_non_admin", 3),
        (open_critical, "abac_critical_resource", 0),
        (open_critical & weak, "abac_critical_no_mfa_or_low_posture", 3),
        (open_critical & ~weak, "abac_critical_restrict_non_privileged", 2),
        (c("_priv") & sensitive, "signal_privilege_escalation", 2),
        (c("_priv") & ~sensitive, "signal_privilege_escalation", 1),
        (c("_time"), "signal_impossible_travel", 2),
        (c("_fails") >= fails_restrict, "signal_bruteforce_high", 2),
        ((c("_fails") >= fails_stepup) & (c("_fails") < fails_restrict), "signal_bruteforce_medium", 1),
        (c("_posture") < posture_restrict, "device_low_posture", 2),
        ((c("_posture") >= posture_restrict) & (c("_posture") < posture_stepup), "device_medium_posture", 1),
        ((c("_mfa") == 0) & sensitive, "mfa_missing_sensitive", 1),
        (c("_hop") & ~trusted, "signal_cross_cloud_hop", 1),
        (c("_bytes") >= bytes_p99, "signal_exfil_spike", 2),
        ((c("_bytes") >= bytes_p95) & (c("_bytes") < bytes_p99), "signal_exfil_medium", 1),
        ((c("_scope") == "WIDE") & sensitive & ~trusted, "token_scope_wide_sensitive", 1),
    ]
    level = F.greatest(*[F.when(cond, n).otherwise(0) for cond, _, n in rules])
    out = d.withColumn("_level", level).withColumns({
        "risk": S.clip01(risk), "confidence": F.element_at(F.array(*map(F.lit, (0.60, 0.65, 0.80, 0.90))), F.col("_level") + 1),
        "decision": F.element_at(F.array(*map(F.lit, ("allow", "stepup", "restrict", "deny"))), F.col("_level") + 1),
        "rationale_tags": F.array_sort(F.array_distinct(S.tags(*[(cond, tag) for cond, tag, _ in rules]))),
    })
    return _dropped(out, [])


def siem_thresholds(df: DataFrame, p95: float | None = None, p99: float | None = None) -> DataFrame:
    """One row: siem_bytes_p95 and siem_bytes_p99 of the bytes, or the given ones; at least 1, and p99 at least p95."""
    q = quantiles(df, S.number(F.col("bytes_out")), (0.95, 0.99))
    b95 = F.greatest(F.lit(1.0), F.lit(p95) if p95 is not None else F.coalesce(F.col("q")[0], F.lit(1.0)))
    b99 = F.greatest(b95, F.lit(p99) if p99 is not None else F.coalesce(F.col("q")[1], F.lit(1.0)))
    return q.select(b95.alias("siem_bytes_p95"), b99.alias("siem_bytes_p99"))


def siem_rows(df: DataFrame, fails_alert=5, fails_high=10, calls_alert=60, calls_high=120, posture_low=0.35, posture_medium=0.55) -> DataFrame:
    """df with siem_bytes_p95, siem_bytes_p99, row_tags and row_severity (0 to 3) of the rules that look at one event."""
    d = _inputs(df).crossJoin(F.broadcast(siem_thresholds(df)))  # one row of two numbers
    c, sensitive = F.col, F.col("_sens").isin("HIGH", "CRITICAL")
    between = lambda x, a, b: (x >= a) & (x < b)
    rules = [  # fixed values: (condition, tag, severity)
        (c("_fails") >= fails_high, "siem_bruteforce_high", 2), (between(c("_fails"), fails_alert, fails_high), "siem_bruteforce_alert", 1),
        (c("_time"), "siem_impossible_travel", 2), (c("_priv") & sensitive, "siem_privilege_escalation", 3), (c("_priv") & ~sensitive, "siem_privilege_escalation", 2),
        (c("_calls") >= calls_high, "siem_api_burst_high", 2), (between(c("_calls"), calls_alert, calls_high), "siem_api_burst_alert", 1),
        (c("_bytes") >= c("siem_bytes_p99"), "siem_exfil_spike_high", 3), (between(c("_bytes"), c("siem_bytes_p95"), c("siem_bytes_p99")), "siem_exfil_spike_medium", 2),
        (c("_hop"), "siem_cross_cloud_hop", 1), (c("_posture") < posture_low, "siem_low_posture", 2), (between(c("_posture"), posture_low, posture_medium), "siem_medium_posture", 1),
        ((c("_mfa") == 0) & sensitive, "siem_mfa_missing_sensitive", 1), ((c("_scope") == "WIDE") & sensitive, "siem_wide_scope_sensitive", 2),
    ]
    return d.withColumns({"row_tags": S.tags(*[(cond, tag) for cond, tag, _ in rules]), "row_severity": F.greatest(*[F.when(cond, n).otherwise(0) for cond, _, n in rules])})


#: What the correlation window counts, by the tags of a row (None: any tag).
SIEM_COUNTS = {
    "n_hits": None, "n_bruteforce": ("siem_bruteforce_alert", "siem_bruteforce_high"), "n_time": ("siem_impossible_travel",), "n_priv": ("siem_privilege_escalation",),
    "n_exfil_high": ("siem_exfil_spike_high",), "n_exfil_med": ("siem_exfil_spike_medium",), "n_xcloud": ("siem_cross_cloud_hop",),
}


def siem_windows(df: DataFrame, minutes: int = 15, bound: int | None = None) -> DataFrame:
    """siem_rows with the seven counts over the principal's last `minutes`; all use one partitioning.

    A row without a timestamp comes last, and its window is all that the principal did before, as no time bounds it."""
    d = prepared(siem_rows(df).withColumn("principal_id", F.coalesce("principal_id", F.lit("unknown"))))
    some = lambda own: F.size("row_tags") > 0 if own is None else F.arrays_overlap("row_tags", F.array(*map(F.lit, own)))
    flagged = cut(d.select("event_ord", "principal_id", "_late", "_us", *[F.when(some(own), 1).otherwise(0).alias(f"_{n}") for n, own in SIEM_COUNTS.items()]))
    counts = sliding_counts(flagged, "principal_id", {n: f"_{n}" for n in SIEM_COUNTS}, minutes, late_counts_all=True, known=hot_keys(flagged, "principal_id", bound))
    return d.drop("_late", "_us").join(apart(counts.select("event_ord", *SIEM_COUNTS)), "event_ord")


def siem_correlated(df: DataFrame, minutes: int = 15, escalate: int = 3) -> DataFrame:
    d, c = siem_windows(df, minutes), F.col
    rules = [
        ((c("n_bruteforce") > 0) & (c("n_time") > 0), "corr_ato_bruteforce_plus_impossible_travel", 3),
        ((c("n_priv") > 0) & c("_sens").isin("HIGH", "CRITICAL"), "corr_privilege_escalation_on_sensitive", 3),
        ((c("n_xcloud") > 0) & ((c("n_exfil_high") > 0) | (c("n_exfil_med") >= 2)), "corr_cross_cloud_plus_exfil", 3),
        (c("n_hits") >= escalate, "corr_multi_signal_escalation", 2),
    ]
    return d.withColumns({
        "rationale_tags": F.array_sort(F.array_distinct(F.concat("row_tags", S.tags(*[(cond, tag) for cond, tag, _ in rules])))),
        "siem_severity": F.greatest("row_severity", *[F.when(cond, n).otherwise(0) for cond, _, n in rules]),
    })


def siem_score(df: DataFrame, minutes: int = 15, escalate: int = 3) -> DataFrame:
    """siem_correlated with risk, confidence and decision by severity; more tags raise both a little."""
    d, n = siem_correlated(df, minutes, escalate), F.size("rationale_tags")
    by = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("siem_severity") + 1)
    out = d.withColumns({
        "risk": S.clip01(by(0.20, 0.50, 0.75, 0.92) + 0.02 * F.least(F.lit(6), n)), "confidence": S.clip01(by(0.50, 0.55, 0.62, 0.70) + 0.05 * F.least(F.lit(4), n)),
        "decision": by("allow", "stepup", "restrict", "deny"),
    })
    return _dropped(out, [])


def raac_context(df: DataFrame, posture_low: float = 0.50) -> DataFrame:
    """s_ctx: weighted posture, missing MFA, time anomaly, privilege escalation and sensitivity."""
    flag = lambda c: F.when(S.number(F.col(c)) >= 1, 1.0).otherwise(0.0)
    at_risk = S.clip01((F.lit(posture_low) - S.clip01(S.number(F.col("posture_score"), 1.0))) / F.lit(posture_low))
    s_ctx = 0.30 * at_risk + 0.20 * (1 - flag("mfa_used")) + 0.15 * flag("raw_time_anomaly") + 0.20 * flag("raw_privilege_escalation") + 0.15 * S.sensitivity_score(F.col("resource_sensitivity"))
    return df.withColumn("s_ctx", S.clip01(s_ctx))


def raac_fuse(df: DataFrame, alpha: float = 0.55, beta: float = 0.45, allow: float = 0.35, stepup: float = 0.55, deny: float = 0.75) -> DataFrame:
    """risk, confidence, decision and rationale_tags from s_ctx and s_anom."""
    total = alpha + beta
    a, b = (alpha / total, beta / total) if total > 0 else (0.5, 0.5)
    c, flag = F.col, lambda n: S.number(F.col(n)) >= 1
    d = df.withColumn("risk", S.clip01(a * c("s_ctx") + b * c("s_anom")))
    names = S.tags(
        (c("s_ctx") >= 0.6, "raac_context_high"), (c("s_anom") >= 0.6, "iforest_anomaly_high"), (~flag("mfa_used"), "mfa_missing"), (flag("raw_time_anomaly"), "time_anomaly"),
        (flag("raw_privilege_escalation"), "privilege_escalation"), (S.sensitivity_score(c("resource_sensitivity")) >= 0.75, "sensitive_resource"),
    )
    return d.withColumns({
        "confidence": S.clip01(0.75 * (1 - F.abs(c("s_ctx") - c("s_anom"))) + 0.25 * (1 - F.abs(c("risk") - 0.5) * 2)),
        "decision": F.when(c("risk") >= deny, "deny").when(c("risk") >= stepup, "restrict").when(c("risk") >= allow, "stepup").otherwise("allow"),
        "rationale_tags": F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("normal_behavior"))),
    })


def unified_rule_score(df: DataFrame) -> DataFrame:
    """s_rule and rule_tags from the behaviour features."""
    n = lambda c: S.number(F.col(c))
    sensitive = F.lower(F.coalesce("resource_sensitivity", F.lit(""))).isin("high", "critical", "secret")
    score = (
        0.30 * S.clip01(n("f_failed_logins_5m") / 3.0) + 0.25 * S.clip01(n("f_fast_geo_switch")) + 0.20 * S.clip01(n("f_bytes_spike_score") / 2.5)
        + 0.15 * S.clip01(n("f_posture_drift") / 0.25) + 0.10 * S.clip01(n("f_is_privileged_role")) * F.when(sensitive, 1.0).otherwise(0.5)
    )
    names = S.tags(
        (n("f_failed_logins_5m") >= 3, "failed_logins_spike"), (n("f_fast_geo_switch") >= 1, "fast_geo_switch"), (n("f_bytes_spike_score") >= 2.5, "bytes_exfil_spike"),
        (n("f_posture_drift") >= 0.25, "device_posture_drift"), ((n("f_is_privileged_role") >= 1) & sensitive, "privileged_sensitive_access"),
    )
    return df.withColumns({"s_rule": S.clip01(score), "rule_tags": names})


def unified_graph_score(df: DataFrame) -> DataFrame:
    """s_graph and graph_tags from the graph features."""
    n = lambda c, d=0.0: S.number(F.col(c), d)
    short = n("g_shortest_to_sensitive_hops", -1.0)
    score = (
        0.30 * S.clip01(n("g_cross_cloud_hops_session") / 2.0) + 0.25 * S.clip01(n("g_is_new_resource_edge")) + 0.20 * S.clip01(n("g_new_resource_rate_win"))
        + 0.15 * F.when(short < 0, 0.0).otherwise(S.clip01((2 - short + 1) / 3.0)) + 0.10 * S.clip01(n("g_blast_radius_sensitive_k") / 15.0)
    )
    names = S.tags(
        (n("g_cross_cloud_hops_session") >= 1, "cross_cloud_hop"), (n("g_is_new_resource_edge") >= 1, "new_resource_edge"), (n("g_new_resource_rate_win") >= 1, "new_edge_rate_spike"),
        (short.between(0, 2), "close_to_sensitive_resource"), (n("g_blast_radius_sensitive_k") >= 15, "large_blast_radius"),
    )
    return df.withColumns({"s_graph": S.clip01(score), "graph_tags": names})


def fused(df: DataFrame, w_anom=0.80, w_rule=0.50, w_graph=0.70, bias=-1.00, allow=0.70, stepup=0.81, restrict=0.88, deny=0.91, min_conf=0.55) -> DataFrame:
    """risk, confidence, decision, rationale_tags and rationale_text from s_anom, s_rule, s_graph and their tags."""
    a, r, g, c = F.col("s_anom"), F.col("s_rule"), F.col("s_graph"), F.col
    mean = (a + r + g) / 3
    spread = F.sqrt((F.pow(a - mean, F.lit(2)) + F.pow(r - mean, F.lit(2)) + F.pow(g - mean, F.lit(2))) / 3)
    d = df.withColumns({
        "risk": 1 / (1 + F.exp(-(w_anom * a + w_rule * r + w_graph * g + bias))),
        "confidence": S.clip01(0.55 * S.clip01(1 - spread / 0.5) + 0.45 * S.clip01(1 - 4 * mean * (1 - mean))),
        "rationale_tags": F.array_distinct(F.concat("rule_tags", "graph_tags")),
    })
    parts = [("anomaly", w_anom * a, 0), ("rules", w_rule * r, 1), ("graph", w_graph * g, 2)]
    top = F.array_sort(F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for n, v, i in parts]))
    factors = F.concat(F.lit("Top factors: "), F.concat_ws(", ", top[0]["n"], top[1]["n"]))
    signals = F.concat(F.lit("; signals: "), F.array_join(F.slice("rationale_tags", 1, 4), ", "))
    return d.withColumns({
        "decision": F.when(c("risk") < allow, "allow").when(c("risk") < stepup, "stepup").when(c("risk") < restrict, "restrict")
        .when((c("risk") >= deny) & (c("confidence") >= min_conf), "deny").otherwise("restrict"),
        "rationale_text": F.when(F.size("rationale_tags") > 0, F.concat(factors, signals)).otherwise(factors),
    })
