"""The composed scorers: samples, routing, ranges, independence of partitions, fusion against its own optimum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.operators import metrics, models, policy, quantiles
from trustlake.plans import queries


@pytest.fixture(scope="module")
def d(spark, sf_dir):
    return queries.uni(spark, sf_dir).persist()


def test_samples(spark):
    rows = spark.range(20_000).selectExpr("'all' AS model", "id AS event_ord", "array(1D) AS x")
    sizes = [r["count"] for r in models.sampled(rows, 50, 256, 42).groupBy("tree").count().collect()]
    assert len(sizes) == 50 and 180 < min(sizes) and max(sizes) < 340
    few = models.sampled(rows.limit(100), 50, 256, 42).groupBy("tree").count().collect()
    assert {r["count"] for r in few} == {100} and len(few) == 50


def test_a_tree_parts_its_rows():
    x = np.array([[1.0, 5.0], [2.0, 5.0], [2.0, 5.0], [9.0, 5.0]])
    nodes = {n: (f, t, depth) for n, f, t, depth in models.grow(x, 0, 8, 42)}
    def walk(row, n=1):
        f, t, depth = nodes[n]
        return (n, depth) if f < 0 else walk(row, 2 * n + (row[f] >= t))
    leaves = [walk(r) for r in x]
    assert leaves[1] == leaves[2] and len({n for n, _ in leaves}) == 3 and all(f in (-1, 0) for f, _, _ in nodes.values())
    depth = int(math.log2(leaves[1][0]))
    assert leaves[1][1] == depth + 1.0  # two equal rows: one more step is expected


def test_raac_score(spark, d):
    a, b = ({r.event_ord: (round(r.risk, 9), r.decision) for r in models.raac_score(d.repartition(n), trees=20).collect()} for n in (2, 5))
    assert a == b and len(a) == d.count() and all(0 <= r <= 1 for r, _ in a.values()) and {x for _, x in a.values()} <= {"allow", "stepup", "restrict", "deny"}


def test_routing(spark, d):
    """A provider with enough rows has its own model, others share one: the same as scoring each part by itself."""
    sizes = {r.cloud_provider: r["count"] for r in models.benign(d, 200).groupBy("cloud_provider").count().collect()}
    least = sorted(sizes.values())[1]
    out = models.per_cloud_score(d, least, trees=10).cache()
    assert {r.percloud_provider: r.percloud_model for r in out.select("percloud_provider", "percloud_model").distinct().collect()} == {c: c if n >= least else "global" for c, n in sizes.items()}
    train = models.benign(d, 200)
    for cloud, n in sizes.items():
        own = train.filter(F.col("cloud_provider") == cloud)
        model = models.iforest_fit(own, models.RAAC_FEATURES, 10, group="cloud_provider").withColumn("model", F.lit("all")) if n >= least else models.iforest_fit(train, models.RAAC_FEATURES, 10)
        part = d.filter(F.col("cloud_provider") == cloud)
        scored = models.iforest_score(models.rules.raac_context(part), model, models.RAAC_FEATURES)
        want = models.rules.raac_fuse(models.quantile_scaled(scored, models.iforest_score(own if n >= least else train, model, models.RAAC_FEATURES)))
        got = {r.event_ord: round(r.risk, 9) for r in out.filter(F.col("percloud_provider") == cloud).collect()}
        assert got == {r.event_ord: round(r.risk, 9) for r in want.collect()}
    assert all(r.rationale_tags[-1].startswith("percloud_") for r in out.take(5))


def test_plan_does_not_grow_with_providers(spark, d):
    of = lambda n: d.withColumn("cloud_provider", F.concat("cloud_provider", (F.col("event_ord") % n).cast("string")))
    size = lambda t: t._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(models.per_cloud_score(of(4), 10, trees=3)) == size(models.per_cloud_score(of(1), 10, trees=3))


def test_unknown_model_gives_null(spark, d):
    model = models.iforest_fit(d, models.RAAC_FEATURES, 3)
    out = models.iforest_score(d, model, models.RAAC_FEATURES, F.when(F.col("event_ord") % 2 == 0, "all").otherwise("none"))
    assert out.filter("event_ord % 2 = 1 AND raw_anom IS NOT NULL").count() == 0 == out.filter("event_ord % 2 = 0 AND raw_anom IS NULL").count()


def test_fusion(spark):
    """The gradient of the balanced, penalized likelihood is 0 at the fit; too few rows or one label leave the table as it is."""
    rng = np.random.default_rng(3)
    x = rng.random((2_500, 4))
    y = (x @ [2, 1, -1, 1] + rng.normal(0, 0.4, 2_500) > 2).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), 0.5, int(t)) for i, (r, t) in enumerate(zip(x, y))], "event_ord long, s_anom double, s_rule double, s_graph double, risk double, confidence double, label_attack int")
    out = models.supervised_fusion(rows).toPandas().sort_values("event_ord")
    p = out["risk"].to_numpy()
    np.testing.assert_allclose(out["confidence"], np.clip(0.25 + 0.5 * np.clip(2 * abs(p - 0.5), 0, 1), 0, 1), atol=1e-12)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    logit = np.log(p / (1 - p))
    coef = np.linalg.lstsq(np.c_[x, np.ones(len(x))], logit, rcond=None)[0]
    np.testing.assert_allclose(np.c_[x, np.ones(len(x))] @ coef, logit, atol=1e-6)  # the risk is a logistic function of the four scores
    slope = x.T @ (w * (p - y)) / w.sum() + coef[:4] / len(y)
    assert abs(slope).max() < 1e-3 and abs((w * (p - y)).sum() / w.sum()) < 1e-3
    assert models.supervised_fusion(rows.limit(100)).columns == rows.columns
    assert models.supervised_fusion(rows.withColumn("label_attack", F.lit(0))).select("risk").first().risk == x[0][3]


def test_unified_score(spark, sf_dir, d):
    table = d.withColumns({c: F.lit(1.0) * (F.col("event_ord") % (7 + i)) for i, c in enumerate(models.UNIFIED_FEATURES)})
    out = models.unified_score(table, trees=5, fusion=False)
    assert out.count() == d.count() and out.filter("s_anom < 0 OR s_anom > 1 OR risk < 0 OR risk > 1 OR confidence < 0 OR confidence > 1").count() == 0
    assert models.unified_score(table, trees=5).select("decision").distinct().count() >= 1


def test_quantiles_per_group(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), None if rng.random() < 0.1 else float(rng.integers(0, 50) if g % 2 else rng.normal())) for g in range(5) for _ in range(400 * g + 1)] + [(None, 3.0), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: list(r.q) for r in quantiles.quantiles(t, F.col("v"), (0.0, 0.3, 0.95, 1.0), ("g",)).collect()}
    of = {}
    for g, v in rows:
        if v is not None:
            of.setdefault(g, []).append(v)
    assert got.keys() == of.keys()
    for g, vs in of.items():
        np.testing.assert_allclose(got[g], np.quantile(vs, (0.0, 0.3, 0.95, 1.0)), rtol=1e-12)
    lat = {r.g: (r.n, r.p50_s, r.max_s) for r in metrics.latency_by(t.fillna("x", ["g"]), "v", "g").collect()}
    assert lat["none"] == (0, 0.0, 0.0) and lat["overall"][0] == sum(map(len, of.values()))


def test_other_columns_of_metrics(spark):
    rows = [("deny", 1, 0.5, "s", "aws"), ("allow", 1, 2.0, "s", "gcp"), ("stepup", 0, 1.0, "t", "aws")]
    t = spark.createDataFrame(rows, "decision string, label_attack int, pivot_score double, trace_id string, provider string")
    r = metrics.blast_reduction(t).first()
    assert (r.mean_blast_before, round(r.mean_blast_after, 6)) == (16.0, round((11 * 0.25 + 21) / 2, 6))
    assert metrics.blast_reduction(t.drop("pivot_score")).first().mean_blast_before is None
    assert metrics.blast_reduction(t.drop("pivot_score").filter("label_attack = 0")).first().mean_blast_before == 0
    assert metrics.blast_reduction(t.drop("label_attack")).first().blast_radius_reduction_pct is None
    assert metrics.blast_reduction(t.withColumnRenamed("pivot_score", "g_sensitive_reach_k")).first().mean_blast_before == 1.25
    x = metrics.cross_cloud_detection(t).first()
    assert (x.xcloud_events, x.xcloud_attacks, x.xcloud_flagged_tpr) == (2, 2, 0.5)
    assert metrics.cross_cloud_detection(t.drop("provider")).first().xcloud_events == 0 == metrics.cross_cloud_detection(t.drop("label_attack")).first().xcloud_events


def test_stages_by_counts(spark):
    t = spark.range(100).selectExpr("id AS event_ord", "CAST(NULL AS timestamp) AS ts", "'deny' AS intent_decision", "concat('s', id) AS session_id", "'aws' AS cloud_provider").repartition(4)
    for d in (t, t.drop("ts")):
        out = {r.event_ord: r.stage for r in policy.staged_events(d, per_day=5).collect()}
        assert [out[i] for i in (0, 34, 35, 49, 50, 64, 65, 99)] == ["shadow", "shadow", "canary", "canary", "enforce", "enforce", "rollout", "rollout"]


def test_broken_log_lines(spark, tmp_path):
    from trustlake.sources import telemetry as T

    (tmp_path / "log.jsonl").write_text('{"intent_id": "a", "latency_s": 1.5}\n\n  \n{"intent_id": "b"\n{"intent_id": "c"}\n')
    out = T.scan_action_log(spark, str(tmp_path / "log.jsonl"), corrupt="keep").collect()
    assert sorted((str(r.intent_id), r.corrupt_line) for r in out) == [("None", '{"intent_id": "b"'), ("a", None), ("c", None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        T.scan_action_log(spark, str(tmp_path / "log.jsonl")).collect()
