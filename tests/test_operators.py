"""Golden tables: ties, nulls, boundaries, hand-computed folds, and the streaming job against the batch one."""

import datetime as dt

from pyspark.sql import functions as F

from trustlake.functions import scalars as S
from trustlake.operators import features, graph, models, policy

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (ord, minutes or None, principal, resource, bytes)"""
    data = [(o, None if m is None else T0 + dt.timedelta(minutes=m), p, r, float(b)) for o, m, p, r, b in rows]
    return spark.createDataFrame(data, "event_ord long, ts timestamp, principal_id string, resource_id string, bytes_out double")


def test_scope_width_and_bool(spark):
    d = spark.createDataFrame([("a|b",), ("a, b,c",), ("none",), (None,), ("x",), ("a b",)], "v string")
    assert [r[0] for r in d.select(S.scope_width(F.col("v"))).collect()] == [2, 3, 0, 0, 1, 2]
    d = spark.createDataFrame([("YES",), ("0",), ("2.5",), (None,), ("maybe",)], "v string")
    assert [r[0] for r in d.select(S.to_bool01(F.col("v"))).collect()] == [1, 0, 1, 0, 0]


def test_window_counts_rows_up_to_the_row_and_includes_the_boundary(spark):
    rows = [(1, 0, "u", "a", 1), (2, 0, "u", "b", 1), (3, 30, "u", "c", 1), (4, 31, "u", "d", 1), (5, 31, "u", "d", 1), (6, None, "u", "e", 1)]
    out = features.new_resource(events(spark, rows)).orderBy("event_ord").collect()
    assert [r.g_new_resource_count_win for r in out] == [1, 2, 3, 2, 2, 0]


def test_window_against_two_pointers(spark):
    import random

    random.seed(3)
    rows = [(i, random.randint(0, 60), f"u{random.randint(0, 2)}", f"r{random.randint(0, 30)}", 1) for i in range(300)]
    got = {r.event_ord: (r.g_is_new_resource_edge, r.g_new_resource_count_win) for r in features.new_resource(events(spark, rows)).collect()}
    for p in ("u0", "u1", "u2"):
        own, seen, hits = sorted((m, o, r) for o, m, q, r, _ in rows if q == p), set(), []
        for m, o, r in own:
            new = r not in seen
            seen.add(r)
            hits += [m] if new else []
            assert got[o] == (int(new), sum(m - h <= 30 for h in hits))


def test_spike_by_hand(spark):
    out = features.bytes_spike(events(spark, [(1, 0, "u", "a", 10), (2, 1, "u", "a", 20), (3, 2, "v", "a", 5)])).orderBy("event_ord").collect()
    mean = 0.8 * 10 + 0.2 * 20
    d = 20 - mean
    assert out[0].f_bytes_spike_score == 0 and out[2].f_bytes_spike_score == 0
    assert abs(out[1].f_bytes_spike_score - d / ((0.2 * d * d) ** 0.5 + 1e-6)) < 1e-9


def test_hops_and_blast_on_a_line(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src_id string, dst_id string")
    sensitive = spark.createDataFrame([("n0",), ("n2",)], "node_id string")
    hops = {r.node: r.hops for r in graph.hops_to_sensitive(edges, sensitive, 5).collect()}
    assert hops == {"n0": 0, "n1": 1, "n2": 0, "n3": 1, "n4": 2, "n5": 3, "n6": 4, "n7": 5}
    starts = spark.createDataFrame([("n1",), ("n2",), ("n8",)], "node string")
    assert {r.node: r.blast for r in graph.blast_radius(edges, sensitive, starts, 3).collect()} == {"n1": 2, "n2": 1, "n8": 0}


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "g"), ("a", "c"), ("c", "g"), ("x", "y")], "src_id string, dst_id string")
    out = graph.shortest_paths(edges, spark.createDataFrame([("a",), ("x",)], "node string"), spark.createDataFrame([("g",)], "node string"))
    assert [(r.start, r.path, r.hops) for r in out.collect()] == [("a", ["a", "b", "g"], 2)]


def test_incremental_in_any_order(spark, sf_dir):
    from trustlake.plans import queries

    d = queries.uni(spark, sf_dir)
    parts = [d.filter(F.col("event_ord") % 3 == i) for i in (2, 0, 1)]
    table = graph.edges(graph.edge_events(parts[0]))
    for p in parts[1:]:
        table = graph.merge_edges(table, graph.edges(graph.edge_events(p)))
    key = lambda t: sorted((r.edge_key, r.event_count, round(r.bytes_out_sum, 3)) for r in t.collect())
    assert key(table) == key(graph.edges(graph.edge_events(d)))


def test_actions(spark):
    d = spark.createDataFrame([(1, "stepup", ["cross_cloud_hop"], "d", None), (2, "deny", [], "", " "), (3, "allow", [], None, None)], "event_ord long, decision string, rationale_tags array<string>, device_id string, workload_id string")
    out = {r.event_ord: r.action_types for r in policy.intents(d).collect()}
    assert out == {1: "step_up_mfa|shorten_session|restrict_token_scope|alert", 2: "deny|revoke_token|soar_playbook", 3: "allow"}


def test_forest_ranks_an_outlier_first_whatever_the_partitions(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(400)] + [(999, 500.0, -300.0)]
    d = spark.createDataFrame(rows, "event_ord long, x double, y double")
    a, b = [{r.event_ord: r.raw_anom for r in models.iforest_score(d.repartition(n), models.iforest_fit(d.repartition(n), ("x", "y"), 20, 64), ("x", "y")).collect()} for n in (2, 5)]
    assert a == b and max(a, key=a.get) == 999


def test_paths_against_brute_force(spark):
    import random

    random.seed(4)
    edges = sorted({(f"n{random.randint(0, 60):02}", f"n{random.randint(0, 60):02}") for _ in range(110)})
    goals, starts = {"n03", "n17"}, [f"n{i:02}" for i in range(61)]
    want = {}
    for s in starts:
        front, seen = [[s]], {s}
        for _ in range(7):
            hits = sorted(p for p in front if p[-1] in goals)
            if hits:
                want[s] = hits[0]
                break
            # All shortest paths are kept, so that the smallest of equals is known.
            front = [p + [b] for p in front for a, b in edges if a == p[-1] and b not in seen]
            seen |= {p[-1] for p in front}
    table = lambda rows, c: spark.createDataFrame(rows, c)
    out = graph.shortest_paths(table(edges, "src_id string, dst_id string"), table([(s,) for s in starts], "node string"), table([(g,) for g in goals], "node string")).collect()
    assert {r.start: r.path for r in out} == want and all(r.goal == r.path[-1] and r.hops == len(r.path) - 1 for r in out)
