"""Computations along keys' orders against sequential ones, with ties, nulls and keys above and below the bound of a chunk."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlake.operators import features, lineage, ordered, rules

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_ord long, ts timestamp, principal_id string, device_id string, session_id string, geo string, bytes_out double, posture_score double, resource_id string, cloud_provider string"


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    out = []
    for i in range(900):
        p = random.choice(["hot", "hot", "hot", "a", "b", None])
        ts = None if random.random() < 0.03 else T0 + dt.timedelta(minutes=random.randint(0, 400))
        out.append((i, ts, p, random.choice(["d", "d", "e", None]), random.choice(["s", None, "t"]), random.choice(["G1", "G2", None]), random.choice([None, 0.0, 5.0, random.random() * 1e5]), random.random(),
                    random.choice(["r1", "unknown", None, f"x{random.randint(0, 80)}"]), random.choice(["aws", "gcp", None])))
    return out


def sequential(rows, alpha=0.2, minutes=30):
    """event_ord -> all ordered features, by one walk through the rows in order."""
    out, geo, last, seen, hits, mean, var, drift, clouds = {}, {}, {}, set(), {}, {}, {}, {}, {}
    for i, ts, p, d, s, g, b, x, r, c in sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0])):
        p, d, s, c = (v or "unknown" for v in (p, d, s, c))
        moved = p in geo and geo[p] is not None and g is not None and geo[p] != g
        fast = moved and ts is not None and p in last and (ts - last[p]).total_seconds() <= 3600
        geo[p] = g
        if ts is not None:
            last[p] = ts
        spike = None
        if b is not None:
            mean[p] = alpha * b + (1 - alpha) * mean[p] if p in mean else b
            dev = b - mean[p]
            var[p] = alpha * dev * dev + (1 - alpha) * var.get(p, 0.0)
            spike = dev / (math.sqrt(var[p]) + 1e-6)
        drift[d] = alpha * x + (1 - alpha) * drift[d] if d in drift else x
        new = (p, r) not in seen
        seen.add((p, r))
        new = new and (r or "").lower() not in ("", "unknown")
        if new and ts is not None:
            hits.setdefault(p, []).append(ts)
        count = sum((ts - h).total_seconds() <= minutes * 60 for h in hits.get(p, [])) if ts is not None else 0
        clouds.setdefault(s, set()).add(c)
        out[i] = (int(moved), int(fast), spike, abs(x - drift[d]), int(new), count, len(clouds[s]) - 1)
    return out


COLUMNS = "f_geo_switch f_fast_geo_switch f_bytes_spike_score f_posture_drift g_is_new_resource_edge g_new_resource_count_win g_cross_cloud_hops_session".split()


@pytest.mark.parametrize("bound", [None, 60, 7])
def test_feature_table(spark, rows, bound):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"access_result": F.lit("deny"), "token_scope": F.lit("a|b"), "role": F.lit("x"), "token_age": F.lit(1.0)}).repartition(3)
    want = sequential(rows)
    got = features.feature_table(d, bound=bound).collect()
    assert len(got) == len(rows)
    for r in got:
        for c, w in zip(COLUMNS, want[r.event_ord]):
            assert (r[c] is None and w is None) or r[c] == pytest.approx(w, abs=1e-6, rel=1e-9), (c, r.event_ord)


def test_no_rows(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert features.geo_features(d).count() == features.bytes_spike(d).count() == features.new_resource(d).count() == features.session_hops(d).count() == 0


def test_one_key_of_many_rows(spark):
    """A sequential fold over 100,000 rows of one key, in chunks of about 2,000."""
    n = 100_000
    x = np.random.default_rng(1).lognormal(8, 2, n)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "event_ord long, v double").selectExpr("event_ord", "timestamp_micros(event_ord div 3) AS ts", "'k' AS k", "v")
    d = ordered.prepared(d)
    out = ordered.exponential(d, "k", "v", 0.2, ordered.hot_keys(d, "k", 2_000)).toPandas().sort_values("event_ord")
    mean, var, means, variances = x[0], 0.0, [], []
    for v in x:
        mean = 0.2 * v + 0.8 * mean
        var = 0.2 * (v - mean) ** 2 + 0.8 * var
        means.append(mean)
        variances.append(var)
    means[0] = x[0]
    np.testing.assert_allclose(out["mean"], means, rtol=1e-12)
    np.testing.assert_allclose(out["variance"], variances, rtol=1e-9, atol=1e-9)


def test_chunks_are_bounded(spark):
    """A third of the rows under one key, one timestamp for most of them: no chunk is far above the bound."""
    d = ordered.prepared(spark.range(30_000).selectExpr("id AS event_ord", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 1000) END AS k", "timestamp_seconds(CASE WHEN id % 5 = 0 THEN id ELSE 7 END) AS ts"))
    out, hot = ordered.chunked(d, "k", ordered.hot_keys(d, "k", 1_000))
    sizes = [r["count"] for r in out.groupBy("k", "_chunk").count().collect()]
    assert hot and sum(sizes) == 30_000 and max(sizes) <= 1_500
    ends = out.filter("_chunk > 0").groupBy("_chunk").agg(F.min(F.struct("_us", "event_ord")).alias("a"), F.max(F.struct("_us", "event_ord")).alias("b")).orderBy("_chunk").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))


@pytest.mark.parametrize("alpha", [0.01, 0.5, 0.999, 1.0])
def test_composed_maps(alpha):
    rng = np.random.default_rng(2)
    x = rng.normal(size=5_000)
    a, b = np.full(5_000, 1 - alpha), alpha * x
    a[0], b[0] = 0.0, x[0]
    a[2_500], b[2_500] = 0.0, x[2_500]
    want, m = [], 0.0
    for i, v in enumerate(x):
        m = v if i in (0, 2_500) else alpha * v + (1 - alpha) * m
        want.append(m)
    ordered.compose(a, b[None])
    np.testing.assert_allclose(b, want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("bound", [None, 40])
def test_siem_windows(spark, rows, bound):
    d = spark.createDataFrame([(i, ts, p, float(b or 0)) for i, ts, p, *_, b, _x, _r, _c in rows], "event_ord long, ts timestamp, principal_id string, bytes_out double")
    d = d.withColumns({"raw_time_anomaly": (F.col("event_ord") % 3 == 0).cast("int"), "raw_login_failures_5m": (F.col("event_ord") % 7).cast("int")})
    got = {r.event_ord: (r.n_time, r.n_bruteforce) for r in rules.siem_windows(d, bound=bound).collect()}
    assert len(got) == len(rows)
    done = {}
    for i, ts, p, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0])):
        own = done.setdefault(p or "unknown", [])
        own.append((ts, i))
        inside = [j for t, j in own if ts is None or (ts - t).total_seconds() <= 900]
        assert got[i] == (sum(j % 3 == 0 for j in inside), sum(j % 7 >= 5 for j in inside)), i


def test_no_wide_table_is_broadcast(spark, rows, monkeypatch, tmp_path):
    """What has as many rows as the events is joined by a sort-merge join, however small the files look."""
    monkeypatch.setattr(ordered, "sized", lambda t: lineage.sized(t, 0))
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"access_result": F.lit("deny"), "token_scope": F.lit("a|b"), "role": F.lit("x"), "token_age": F.lit(1.0)})
    d.write.parquet(f"{tmp_path}/d")
    plan = features.feature_table(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [event_ord" in plan and "BroadcastHashJoin" not in plan
