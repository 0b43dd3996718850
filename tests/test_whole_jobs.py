"""Registered queries do the operators' whole jobs."""

import pytest

from trustlake.plans import queries as plans


@pytest.mark.parametrize("name, trees", [("iforest_fit", 160), ("iforest_score", 160), ("raac_score", 160), ("per_cloud_models", 160), ("unified_score", 200)])
def test_forests_have_all_trees(spark, sf_dir, monkeypatch, name, trees):
    class Asked(Exception):
        pass

    def fit(df, columns, trees, *_, **__):
        raise Asked(trees)

    monkeypatch.setattr(plans.models, "iforest_fit", fit)
    monkeypatch.setattr(plans, "feats", plans.uni)
    with pytest.raises(Asked) as asked:
        plans.QUERIES[name](spark, sf_dir)
    assert asked.value.args == (trees,)


def test_paths_of_six_hops(spark, sf_dir, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "resource" if i == 7 else "principal", 9.0 if i == 7 else 0.0) for i in range(8)], "node_id string, node_type string, sensitivity double")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "src_id string, dst_id string")
    monkeypatch.setattr(plans, "graph_tables", lambda *_: (nodes, edges))
    monkeypatch.setattr(plans.graph, "sensitive_nodes", lambda n: n.filter("node_id = 'n7'").select("node_id"))
    assert {r.start: r.hops for r in plans.QUERIES["shortest_path_nodes_6"](spark, sf_dir).collect()} == {f"n{i}": 7 - i for i in range(1, 7)}


def test_all_non_allow_events(spark, sf_dir):
    every = plans.QUERIES["static_decision"](spark, sf_dir).filter("decision <> 'allow'").select("event_ord").collect()
    out = plans.QUERIES["filter_non_allow_all"](spark, sf_dir).collect()
    assert sorted(r.event_ord for r in out) == sorted(r.event_ord for r in every) and max(r.event_ord for r in out) >= 500
