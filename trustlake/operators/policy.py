"""Thresholds, policy actions and staged rollout, as columns and joins with constant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from .lineage import cut
from .ordered import ordinal
from .quantiles import quantiles, with_quantiles

#: Seconds that an action takes.
ACTION_SECONDS = {
    "allow": 0.05, "step_up_mfa": 0.2, "shorten_session": 0.15, "restrict_token_scope": 0.25, "isolate_segment": 1.0, "revoke_token": 0.6, "quarantine_endpoint": 2.0, "alert": 0.1,
    "soar_playbook": 1.5, "deny": 0.05,
}
#: What an action is called at each provider.
DESCRIPTIONS = {
    "aws": {
        "step_up_mfa": "Enforce MFA step-up via IdP/Conditional Access for this principal", "shorten_session": "Issue short-lived session/token (reduce TTL)",
        "restrict_token_scope": "Apply least-privilege session policy / restrict token scope", "isolate_segment": "Tighten security group / NACL (micro-segmentation) for workload/device",
        "revoke_token": "Revoke session (disable access key / revoke refresh where applicable)", "quarantine_endpoint": "Quarantine endpoint via EDR/SSM integration",
        "alert": "Create security alert (SOC) with context and rationale", "soar_playbook": "Trigger SOAR playbook: containment + ticket + evidence capture",
        "deny": "Deny access at PDP/PEP (block request)", "allow": "Allow (log decision)",
    },
    "azure": {
        "step_up_mfa": "Enforce Conditional Access step-up MFA for this user/service principal", "shorten_session": "Shorten token/session lifetime (CA session controls)",
        "restrict_token_scope": "Limit token scopes / enforce least privilege via policy", "isolate_segment": "Isolate via NSG/micro-segmentation; restrict egress",
        "revoke_token": "Revoke refresh tokens / sign-in sessions (Entra ID)", "quarantine_endpoint": "Quarantine endpoint via Defender for Endpoint",
        "alert": "Create security alert (Sentinel) with context", "soar_playbook": "Trigger SOAR playbook (Sentinel/Logic Apps)",
        "deny": "Deny access (Conditional Access / policy enforcement)", "allow": "Allow (log decision)",
    },
    "gcp": {
        "step_up_mfa": "Require MFA step-up (Cloud Identity / context-aware access)", "shorten_session": "Shorten token/session TTL (context-aware/session controls)",
        "restrict_token_scope": "Restrict OAuth scopes / reduce permissions (least privilege)", "isolate_segment": "Isolate via VPC firewall rules / micro-segmentation",
        "revoke_token": "Revoke access token / disable service account key", "quarantine_endpoint": "Quarantine endpoint via EDR integration",
        "alert": "Create security alert (Chronicle/SCC) with context", "soar_playbook": "Trigger SOAR playbook (SCC/Chronicle)",
        "deny": "Deny access (policy enforcement)", "allow": "Allow (log decision)",
    },
}
#: The parameter that an action adds.
EXTRA = {"step_up_mfa": ("mfa_required", "true"), "shorten_session": ("session_ttl_minutes", "15"), "restrict_token_scope": ("scope_policy", "least_privilege"), "isolate_segment": ("isolation", "microsegment"), "soar_playbook": ("playbook", "containment_high_risk")}
SUBJECT = ("principal_id", "role", "session_id", "token_id", "resource_id", "tenant_id", "region", "device_id")


def tuned_thresholds(df: DataFrame, mfa_rate: float = 0.05, fpr_restrict: float = 0.02, fpr_deny: float = 0.005) -> DataFrame:
    """One row: t_allow (= t_stepup), t_restrict, t_deny, the benign risks' quantiles (linear) that give the rates."""
    q = quantiles(df.filter(F.col("label_attack") == 0), F.col("risk"), (1 - mfa_rate, 1 - fpr_restrict, 1 - fpr_deny))
    return q.select(F.col("q")[0].alias("t_allow"), F.col("q")[0].alias("t_stepup"), F.greatest(F.col("q")[0], F.col("q")[1]).alias("t_restrict"), F.greatest(F.col("q")[0], F.col("q")[1], F.col("q")[2]).alias("t_deny"))


def with_tuned(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """df with decision_tuned; thresholds: one row."""
    risk, c = F.col("risk"), F.col
    tuned = F.when(risk >= c("t_deny"), "deny").when(risk >= c("t_restrict"), "restrict").when(risk >= c("t_stepup"), "stepup").otherwise("allow")
    return df.crossJoin(F.broadcast(thresholds)).withColumn("decision_tuned", tuned).drop(*thresholds.columns)


def decision_from_risk(risk: Column, confidence: Column, allow=0.30, stepup=0.60, restrict=0.80, min_conf=0.60) -> Column:
    """deny only with enough confidence, else restrict."""
    return F.when(risk < allow, "allow").when(risk < stepup, "stepup").when((risk < restrict) | (confidence < min_conf), "restrict").otherwise("deny")


def actions_of(decision: Column, tags: Column, device: Column, workload: Column) -> Column:
    """Ordered action types of a decision, as an array."""
    arr = lambda *a: F.array(*map(F.lit, a))
    some = (F.trim(F.coalesce(device, F.lit(""))) != "") | (F.trim(F.coalesce(workload, F.lit(""))) != "")
    stepup = F.when(F.array_contains(tags, "cross_cloud_hop"), arr("step_up_mfa", "shorten_session", "restrict_token_scope", "alert")).otherwise(arr("step_up_mfa", "shorten_session", "restrict_token_scope"))
    deny = F.when(some, arr("deny", "revoke_token", "quarantine_endpoint", "soar_playbook")).otherwise(arr("deny", "revoke_token", "soar_playbook"))
    return F.when(decision == "allow", arr("allow")).when(decision == "stepup", stepup).when(decision == "restrict", arr("restrict_token_scope", "isolate_segment", "alert")).otherwise(deny)


def intents(df: DataFrame, decision: str = "decision") -> DataFrame:
    """df with intent_id, intent_decision, action_list, action_count and action_types."""
    d = df.withColumns({"intent_id": F.concat(F.lit("intent_"), F.col("event_ord")), "intent_decision": F.col(decision)})
    d = d.withColumn("action_list", actions_of(F.col("intent_decision"), F.col("rationale_tags"), F.col("device_id"), F.col("workload_id")))
    return d.withColumns({"action_count": F.size("action_list"), "action_types": F.array_join("action_list", "|")})


def catalog(spark: SparkSession) -> DataFrame:
    """30 rows: provider, action_type, description, extra_name, extra_value, latency_s."""
    rows = [(p, a, d, *EXTRA.get(a, (None, None)), ACTION_SECONDS[a]) for p, own in DESCRIPTIONS.items() for a, d in own.items()]
    return spark.createDataFrame(rows, "provider string, action_type string, description string, extra_name string, extra_value string, latency_s double")


def flat_actions(df: DataFrame) -> DataFrame:
    """One row per action of each intent: provider (unknown ones as aws), index, type, description, parameters (map), latency_s, started_s
    and finished_s within the intent."""
    cloud = F.lower(F.coalesce("cloud_provider", F.lit("")))
    seconds = F.create_map(*[F.lit(x) for pair in ACTION_SECONDS.items() for x in pair])
    # An intent's own few actions are timed within its row, so nothing is shuffled.
    upto = lambda i: F.aggregate(F.slice(F.col("action_list"), F.lit(1), i + 1), F.lit(0.0), lambda x, a: x + F.element_at(seconds, a))
    steps = F.transform("action_list", lambda a, i: F.struct(i.alias("action_index"), a.alias("action_type"), upto(i).alias("finished_s")))
    d = df.withColumn("provider", F.when(cloud.isin(*DESCRIPTIONS), cloud).otherwise("aws")).withColumn("_step", F.explode(steps)).select("*", "_step.*").drop("_step")
    d = d.join(F.broadcast(catalog(df.sparkSession)), ["provider", "action_type"], "left")  # 30 rows
    base = F.map_from_arrays(F.array(*map(F.lit, SUBJECT)), F.array(*[F.col(c) for c in SUBJECT]))
    extra = F.when(F.col("extra_name").isNotNull(), F.create_map("extra_name", "extra_value")).when(F.col("action_type") == "alert", F.create_map(F.lit("rationale"), F.array_join("rationale_tags", ";"))).otherwise(F.create_map().cast("map<string,string>"))
    return d.withColumn("parameters", F.map_concat(base, extra)).withColumn("started_s", F.col("finished_s") - F.col("latency_s")).drop("extra_name", "extra_value", "action_list")


def response_times(df: DataFrame, delay_s: float = 0.0, only_flagged: bool = True) -> DataFrame:
    """intent_id, response_s of each (flagged) intent: the engine's delay and the sum of its actions' latencies."""
    d = df.filter(F.col("intent_decision") != "allow") if only_flagged else df
    seconds = F.create_map(*[F.lit(x) for pair in ACTION_SECONDS.items() for x in pair])
    total = F.aggregate(F.transform("action_list", lambda a: F.element_at(seconds, a)), F.lit(0.0), lambda x, y: x + y)
    return d.select("intent_id", "intent_decision", (F.lit(delay_s) + total).alias("response_s"))


# Rollout.  Stages: shadow 7 days, canary 3, enforce 3, then everything; each starts at the first event not in the one before.
STAGES = ("shadow", "canary", "enforce", "rollout")


def stage_starts(df: DataFrame, days: tuple[int, int, int] = (7, 3, 3)) -> DataFrame:
    """One row: s0 to s3, the stages' first timestamps (null if no event is left)."""
    out = df.agg(F.min("ts").alias("s0"))
    for i, n in enumerate(days):
        until = F.expr(f"s{i} + make_interval(0, 0, 0, {n})")
        out = df.select("ts").crossJoin(F.broadcast(out)).groupBy(*[f"s{j}" for j in range(i + 1)]).agg(F.min(F.when(F.col("ts") >= until, F.col("ts"))).alias(f"s{i + 1}"))
    return out


#: Fixed value: events that count as a day where no event has a timestamp.
EVENTS_A_DAY = 2000


def stage_by_ordinal(df: DataFrame, days: tuple[int, int, int] = (7, 3, 3), per_day: int = EVENTS_A_DAY) -> DataFrame:
    """df with stage by how many events come before (in event_ord order): so many events a day, the last stage takes the rest."""
    d = ordinal(df, F.col("event_ord"), ("event_ord",), "_before")
    ends = [sum(days[: i + 1]) * per_day for i in range(3)]
    n = F.col("_before")
    return d.withColumn("stage", F.when(n < ends[0], "shadow").when(n < ends[1], "canary").when(n < ends[2], "enforce").otherwise("rollout")).drop("_before")


def staged_events(
    df: DataFrame, days: tuple[int, int, int] = (7, 3, 3), canary: float = 0.05, cohort: str = "session_id", cloud: str | None = "aws", tenant: str | None = None, region: str | None = None,
    seed: int = 42, per_day: int = EVENTS_A_DAY,
) -> DataFrame:
    """df (with intent_decision) with stage, enforced and effective_decision.  Events without a timestamp belong to the last stage; where
    no event has one (or there is no such column), stages are counts of events, per_day for a day."""
    c, never = F.col, F.lit("9999-01-01").cast("timestamp")
    starts = cut(stage_starts(df.select("ts"), days)) if "ts" in df.columns else None
    if starts is None or starts.first()["s0"] is None:
        d = stage_by_ordinal(df, days, per_day)
    else:
        until = lambda s: c("ts") < F.coalesce(s, never)
        stage = F.when(until("s1"), "shadow").when(until("s2"), "canary").when(until("s3"), "enforce").otherwise("rollout")
        d = df.crossJoin(F.broadcast(starts)).withColumn("stage", stage).drop(*starts.columns)  # one row
    scope = F.lit(True)
    for name, value in (("cloud_provider", cloud), ("tenant_id", tenant), ("region", region)):
        scope = scope & (F.lower(c(name)) == value.lower()) if value else scope
    enforced = F.when(c("stage") == "shadow", False).when(c("stage") == "canary", S.unit_hash(c(cohort), seed) < canary).when(c("stage") == "enforce", scope).otherwise(True)
    return d.withColumn("enforced", enforced).withColumn("effective_decision", F.when(c("enforced"), c("intent_decision")).otherwise("allow"))


def rollout_kpis(df: DataFrame, override_conf: float = 0.35, seed: int = 42) -> DataFrame:
    """One row per stage: events, enforced fraction and the five safety rates over enforced events; shadow as if all were enforced."""
    c = F.col
    eff = F.when(c("stage") == "shadow", c("intent_decision")).otherwise(c("effective_decision"))
    d = df.withColumns({"_in": c("enforced") | (c("stage") == "shadow"), "_eff": eff})
    overhead = F.when(c("_eff") == "stepup", 150.0).when(c("_eff") == "restrict", 300.0).when(c("_eff") == "deny", 50.0).otherwise(0.0)
    chance = F.when(c("_eff") == "stepup", 0.003).when(c("_eff") == "restrict", 0.005).when(c("_eff") == "deny", 0.0).otherwise(0.0002)
    d = d.withColumns({"_lat": S.number(c("latency_ms"), 100.0) + overhead, "_err": S.unit_hash(c("event_ord"), seed) < chance})
    rate = lambda cond: F.coalesce(F.avg(F.when(c("_in"), cond.cast("double"))), F.lit(0.0))
    stats = d.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(c("_in").cast("double")).alias("enforced_fraction"), rate((c("label_attack") == 0) & (c("_eff") == "deny")).alias("false_deny_rate"),
        rate(c("_eff") == "stepup").alias("mfa_friction_rate"), rate(c("_err")).alias("policy_error_rate"),
        rate(c("_eff").isin("restrict", "deny") & (c("confidence") < override_conf)).alias("analyst_override_rate"),
    )
    out = with_quantiles(stats, quantiles(d.filter("_in"), c("_lat"), (0.95,), ("stage",)), ("stage",))
    p95 = F.coalesce(c("q")[0], F.lit(0.0)).alias("latency_p95_ms")
    return out.select("stage", "n_events", "enforced_fraction", "false_deny_rate", "mfa_friction_rate", p95, "policy_error_rate", "analyst_override_rate")


#: The safety budgets, by KPI.
BUDGETS = {"false_deny_rate": 0.02, "mfa_friction_rate": 0.17, "latency_p95_ms": 600.0, "policy_error_rate": 0.01, "analyst_override_rate": 0.30}


def checked(kpis: DataFrame, budgets: dict[str, float] = BUDGETS) -> DataFrame:
    """kpis with reasons (the KPIs over budget) and budgets_ok."""
    over = S.tags(*[(F.col(k) > v, k) for k, v in budgets.items()])
    return kpis.withColumn("reasons", over).withColumn("budgets_ok", F.size("reasons") == 0)


def timeline(kpis: DataFrame, budgets: dict[str, float] = BUDGETS) -> DataFrame:
    """The stages attempted: none after the first that breaks a budget (at most four rows)."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    d = checked(kpis, budgets).withColumn("stage_no", order.cast("int"))
    failed = d.filter("not budgets_ok").agg(F.min("stage_no").alias("_fail"))
    return d.crossJoin(F.broadcast(failed)).filter(F.col("_fail").isNull() | (F.col("stage_no") <= F.col("_fail"))).drop("_fail")


def rolled_out(staged: DataFrame, attempted: DataFrame) -> DataFrame:
    """Events with the stages that were attempted; those of later ones fall back to shadow and allow."""
    known = F.broadcast(attempted.select("stage", F.lit(True).alias("_ok")))  # at most four rows
    d = staged.join(known, "stage", "left")
    ok = F.coalesce("_ok", F.lit(False))
    return d.withColumns({"effective_decision": F.when(ok, F.col("effective_decision")).otherwise("allow"), "enforced": ok & F.col("enforced"), "stage": F.when(ok, F.col("stage")).otherwise("shadow")}).drop("_ok")
