"""Evaluation: one aggregate per metric family.  A ratio with denominator 0 is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .lineage import cut, sized
from .quantiles import quantiles, with_quantiles


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_columns(truth: Column, predicted: Column, prefix: str) -> list[Column]:
    tp, fp = F.count_if(truth & predicted), F.count_if(~truth & predicted)
    fn, tn = F.count_if(truth & ~predicted), F.count_if(~truth & ~predicted)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "fpr": ratio(fp, fp + tn), "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
    return [v.alias(f"{prefix}_{k}") for k, v in values.items()]


def flags(decision: Column) -> tuple[Column, Column]:
    """(flagged, hard)"""
    d = F.lower(F.coalesce(decision, F.lit("")))
    return d.isin("stepup", "restrict", "deny"), d.isin("restrict", "deny")


def summary_columns(decision: str = "decision") -> list[Column]:
    truth = F.col("label_attack") == 1
    flagged, hard = flags(F.col(decision))
    return [
        F.count(F.lit(1)).alias("rows"), F.count_if(truth).alias("attacks"), F.count_if(~truth).alias("benign"), *binary_columns(truth, flagged, "det"), *binary_columns(truth, hard, "hard"),
        ratio(F.count_if(truth & flagged), F.count_if(flagged)).alias("access_decision_precision"), ratio(F.count_if(flagged), F.count(F.lit(1))).alias("flagged_rate"), ratio(F.count_if(hard), F.count(F.lit(1))).alias("hard_rate"),
    ]


def summarize(df: DataFrame, decision: str = "decision", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*summary_columns(decision))


def latency_summary(df: DataFrame, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean_s, p50_s, p95_s, p99_s, max_s of a column (of each group); nulls don't count, and without values all are 0."""
    v, zero = F.col(c), lambda x: F.coalesce(x, F.lit(0.0))
    stats = df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.avg(v)).alias("mean_s"), zero(F.max(v)).alias("max_s"))
    out = with_quantiles(stats, quantiles(df, v, (0.5, 0.95, 0.99), by), by)
    return out.select(*by, "n", "mean_s", *[zero(F.col("q")[i]).alias(n) for i, n in enumerate(("p50_s", "p95_s", "p99_s"))], "max_s")


def latency_by(df: DataFrame, c: str, group: str) -> DataFrame:
    """Overall (group 'overall') and by group."""
    d = cut(df.select(F.col(c), group))
    overall = latency_summary(d, c).withColumn(group, F.lit("overall"))
    return overall.unionByName(latency_summary(d, c, (group,)))


def cross_cloud_keys(df: DataFrame, key: str = "session_id", cloud: str = "cloud_provider") -> DataFrame:
    """df with n_clouds of its key; by a join with the aggregate, so a hot key is split."""
    of = df.groupBy(F.coalesce(key, F.lit("unknown")).alias("_key")).agg(F.count_distinct(F.coalesce(cloud, F.lit("unknown"))).alias("n_clouds"))
    return df.join(sized(cut(of)), F.coalesce(key, F.lit("unknown")) == F.col("_key")).drop("_key")


#: Columns that mark cross-cloud events, that hold a cloud, that hold a key of events that belong together, a blast radius,
#: or a pivot score; the first present counts.
XCLOUD = ("g_cross_cloud_hops_session", "raw_cross_cloud_hop", "cross_cloud_hops", "is_cross_cloud_event", "is_cross_cloud")
CLOUDS = ("cloud_provider", "cloud", "provider")
KEYS = ("session_id", "raw_session_id", "trace_id", "principal_id", "user_id")
BLASTS = ("g_blast_radius_sensitive_k", "g_sensitive_blast_k", "g_sensitive_reach_k", "g_sensitive_neighbor_count", "g_sensitive_neighbors_k")
PIVOTS = ("g_pivot_score", "g_graph_pivot_score", "graph_pivot_score", "pivot_score")


def _first(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((c for c in names if c in columns), None)


def marked(df: DataFrame) -> DataFrame:
    """df with _crossed, whether an event is cross-cloud: by a column that says so, else whether its key's events are in several clouds;
    without such columns no event is."""
    mark, cloud, key = (_first(df.columns, names) for names in (XCLOUD, CLOUDS, KEYS))
    if mark:
        return df.withColumn("_crossed", S.number(F.col(mark).cast("double")) > 0.5)
    if cloud and key:
        return cross_cloud_keys(df, key, cloud).withColumn("_crossed", F.col("n_clouds") > 1).drop("n_clouds")
    return df.withColumn("_crossed", F.lit(False))


def _detection(decision: str) -> list[Column]:
    attack = F.col("_crossed") & (F.coalesce("label_attack", F.lit(0)) == 1)
    flagged, hard = flags(F.col(decision))
    return [
        F.count_if("_crossed").alias("xcloud_events"), F.count_if(attack).alias("xcloud_attacks"), ratio(F.count_if(attack & flagged), F.count_if(attack)).alias("xcloud_flagged_tpr"),
        ratio(F.count_if(attack & hard), F.count_if(attack)).alias("xcloud_hard_tpr"),
    ]


def cross_cloud_detection(df: DataFrame, decision: str = "decision", by: tuple[str, ...] = ()) -> DataFrame:
    """Events and attacks across clouds, and the shares of those attacks that are flagged and hard; zeros without labels."""
    d = df if "label_attack" in df.columns else df.filter("false").withColumn("label_attack", F.lit(0))
    return marked(d).groupBy(*by).agg(*_detection(decision))


def blast_size(columns: list[str]) -> Column:
    """The blast radius of an event: a column that has it, else 1 to 21 by a pivot score, else null."""
    blast, pivot = _first(columns, BLASTS), _first(columns, PIVOTS)
    if blast:
        return F.greatest(F.lit(0.0), S.number(F.col(blast)))
    return 1 + 20 * S.clip01(S.number(F.col(pivot))) if pivot else F.lit(None).cast("double")


def _reduction(decision: str, size: str) -> list[Column]:
    d, attack = F.lower(F.coalesce(decision, F.lit(""))), F.col("label_attack") == 1
    factor = F.when(d == "stepup", 0.10).when(d == "restrict", 0.45).when(d == "deny", 0.75).otherwise(0.0)
    none = F.coalesce(F.count_if(attack), F.lit(0)) == 0
    before = F.when(none, 0.0).otherwise(F.avg(F.when(attack, F.col(size))))
    after = F.when(none, 0.0).otherwise(F.avg(F.when(attack, F.col(size) * (1 - factor))))
    percent = F.when(before <= 0, 0.0).otherwise(100 * (1 - F.try_divide(after, before)))
    return [before.alias("mean_blast_before"), after.alias("mean_blast_after"), percent.alias("blast_radius_reduction_pct")]


def blast_reduction(df: DataFrame, decision: str = "decision", by: tuple[str, ...] = ()) -> DataFrame:
    """Attacks only: mean blast radius before and after containment by the decision, and the reduction in percent; 0 without attacks,
    null without labels or without a column to tell it by."""
    if "label_attack" not in df.columns:
        null = [F.first(F.lit(None).cast("double")).alias(c) for c in ("mean_blast_before", "mean_blast_after", "blast_radius_reduction_pct")]
        return df.groupBy(*by).agg(*null)
    return df.withColumn("_size", blast_size(df.columns)).groupBy(*by).agg(*_reduction(decision, "_size"))


def policy_consistency(df: DataFrame, decision: str = "decision", least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over principals (of at least `least` events) of the population variance across clouds of mean severity and of deny rate."""
    deny = (F.lower(F.coalesce(decision, F.lit(""))) == "deny").cast("double")
    d = df.select(*by, F.coalesce("principal_id", F.lit("unknown")).alias("_p"), F.coalesce("cloud_provider", F.lit("unknown")).alias("_c"), S.severity(F.col(decision)).alias("_s"), deny.alias("_d"))
    per_cloud = d.groupBy(*by, "_p", "_c").agg(F.avg("_s").alias("s"), F.avg("_d").alias("d"), F.count(F.lit(1)).alias("n"))
    per_principal = per_cloud.groupBy(*by, "_p").agg(F.var_pop("s").alias("s"), F.var_pop("d").alias("d"), F.sum("n").alias("n")).filter(F.col("n") >= least)
    return per_principal.groupBy(*by).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("policy_consistency_var"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("deny_rate_var"))


def executions(actions: DataFrame) -> DataFrame:
    """Per intent: finish of its last action, sum of latencies, number of actions, sorted providers and types."""
    return actions.groupBy("intent_id").agg(
        F.min("ts").alias("detect_ts"), F.max("finished_s").alias("response_s"), F.sum("latency_s").alias("latency_sum_s"), F.count(F.lit(1)).alias("n_actions"),
        F.array_join(F.array_sort(F.collect_set("provider")), "|").alias("providers"), F.array_join(F.array_sort(F.collect_set("action_type")), "|").alias("types"),
    )


def profile(df: DataFrame, columns: tuple[str, ...] = ("risk", "confidence")) -> DataFrame:
    """metric, n, mean, std, min, p25, p50, p75, max."""
    long = cut(df.select(*columns)).unpivot([], list(columns), "metric", "v")
    stats = long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = with_quantiles(stats, quantiles(long, F.col("v"), (0.25, 0.5, 0.75), ("metric",)), ("metric",))
    return out.select("metric", "n", "mean", "std", "min", *[F.col("q")[i].alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max")


#: Metric -> (target, whether more is better), on hard decisions and, as a first check, on flagged ones.
TARGETS = {
    "hard_accuracy": (0.964, True), "hard_fpr": (0.031, False), "avg_response_time_s": (2.3, False), "access_decision_precision": (0.946, True), "det_accuracy": (0.964, True),
    "det_fpr": (0.031, False),
}
DIRECTIONS = {"det_accuracy": 1, "det_precision": 1, "det_recall": 1, "det_f1": 1, "det_fpr": -1, "access_decision_precision": 1, "avg_response_time_s": -1, "policy_consistency_var": -1}


def engine_summary(df: DataFrame, delays: DataFrame, seconds: Column) -> DataFrame:
    """A row an engine, by one aggregate over events with engine, decision, is_cross_cloud and blast_size: detection; mean and 95th
    percentile of delay and plan (seconds) over events that are not allowed, and their number; cross-cloud detection; blast reduction.

    Plans have few distinct lengths, set by the code, so the percentile's counts are small."""
    d = df.join(F.broadcast(delays), "engine").withColumnRenamed("is_cross_cloud", "_crossed")  # delays: a row an engine
    d = d.withColumn("_rt", F.when(F.lower("decision") != "allow", F.col("processing_delay_s") + seconds))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    times = [zero(F.avg("_rt")).alias("avg_response_time_s"), zero(F.avg("_rt")).alias("mttr_proxy_s"), zero(F.percentile("_rt", 0.95)).alias("p95_response_time_s"), F.count("_rt").alias("latency_count")]
    return d.groupBy("engine").agg(*summary_columns(), *times, *_detection("decision"), *_reduction("decision", "blast_size"))


def melted(engines: DataFrame, metrics: list[str]) -> DataFrame:
    return engines.unpivot(["engine"], metrics, "metric", "value")


def target_check(engines: DataFrame) -> DataFrame:
    rows = [(m, t, up) for m, (t, up) in TARGETS.items()]
    targets = F.broadcast(engines.sparkSession.createDataFrame(rows, "metric string, target double, more boolean"))  # four rows
    d = melted(engines, list(TARGETS)).join(targets, "metric")
    return d.select("engine", "metric", "value", "target", F.when(F.col("more"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target")).alias("passed"))


def leaderboard(engines: DataFrame, metrics: dict[str, int] = DIRECTIONS) -> DataFrame:
    """Of each metric the best engine (ties: the first name), its value and the margin to the next."""
    sign = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    d = melted(engines, list(metrics)).withColumn("_key", -F.element_at(sign, F.col("metric")) * F.col("value"))
    w = Window.partitionBy("metric").orderBy("_key", "engine")
    d = d.withColumns({"_nth": F.row_number().over(w), "next_value": F.lead("value").over(w)})
    return d.filter("_nth = 1").select("metric", F.col("engine").alias("best_engine"), "value", F.abs(F.col("value") - F.col("next_value")).alias("margin"))
