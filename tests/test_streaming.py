"""Streams against the batch operators over several micro-batches, with repeated and late events; the store of graph tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trustlake.operators import features, graph
from trustlake.plans import queries
from trustlake.sources.graph_store import GraphStore, read_graph, write_graph
from trustlake.streaming import features as streamed, jobs

EDGE = lambda t: sorted((r.edge_key, r.event_count, r.attack_count, r.deny_count, round(r.bytes_out_sum, 3), r.first_seen, r.last_seen) for r in t.collect())
NODE = lambda t: sorted((r.node_id, r.node_type, r.first_seen, r.last_seen, r.attrs_json, str(r.sensitivity)) for r in t.collect())


def stream_of(spark, d, folder, parts):
    """A stream whose micro-batches are the parts, in order."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_graph_stream(spark, sf_dir, tmp_path):
    d = queries.uni(spark, sf_dir).withColumn("ts", F.when(F.col("event_ord") % 97 != 5, F.col("ts"))).persist()
    part = lambda i: d.filter(F.col("event_ord") * 5 % 1000 >= 0).filter(F.floor(F.col("event_ord") / 300) == i)
    again = part(0).filter("ts IS NOT NULL AND event_ord % 3 = 0").unionByName(part(1))  # repetitions within the watermark
    source = stream_of(spark, d, str(tmp_path / "in"), [part(0), again.unionByName(part(1).filter("ts IS NOT NULL")), part(2), part(3)])
    jobs.graph_stream(source, str(tmp_path / "graph"), str(tmp_path / "mark"), delay="60 days", buckets=8).awaitTermination(400)
    store = GraphStore(spark, str(tmp_path / "graph"), 8)
    assert EDGE(store.read("edges")) == EDGE(graph.edges(graph.edge_events(d)))
    assert NODE(store.read("nodes")) == NODE(graph.nodes(graph.node_events(d)))
    assert len(store.versions()) == 2  # older ones are removed
    d.unpersist()


def test_store_rewrites_only_what_it_touches(spark, tmp_path):
    rows = lambda ids, n: spark.createDataFrame([(f"n{i}", "x", n) for i in ids], "node_id string, node_type string, n long")
    merge = {"nodes": lambda old, new: old.unionByName(new).groupBy("node_id", "node_type").agg(F.sum("n").alias("n"))}
    store = GraphStore(spark, str(tmp_path), 16)
    assert store.read("nodes") is None and read_graph(spark, str(tmp_path)) == {}
    store.commit({"nodes": rows(range(200), 1)}, merge)
    before = store._pointer()
    store.commit({"nodes": rows([7], 5)}, merge)
    after = store._pointer()
    assert sum(before[k] != v for k, v in after.items()) == 1 and len(after) == 16
    store.commit({"nodes": rows([7], 5)}, merge, 1)  # the same commit once more changes nothing
    assert {r.node_id: r.n for r in store.read("nodes").collect()} == {f"n{i}": 6 if i == 7 else 1 for i in range(200)}
    store.commit({"nodes": rows([], 0)}, merge)
    assert store.read("nodes").count() == 200
    write_graph(spark, {"nodes": rows([1, 2], 9)}, str(tmp_path), 16)  # replaces
    assert sorted(r.node_id for r in read_graph(spark, str(tmp_path))["nodes"].collect()) == ["n1", "n2"]


def test_a_commit_that_breaks_off_is_not_seen(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("a", "x", n)], "node_id string, node_type string, n long")
    store = GraphStore(spark, str(tmp_path), 4)
    store.commit({"nodes": rows(1)})

    def broken(old, new):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.commit({"nodes": rows(2)}, {"nodes": broken})
    assert store.read("nodes").first().n == 1


@pytest.fixture(scope="module")
def events(spark):
    random.seed(3)
    t0, rows = dt.datetime(2024, 1, 1), []
    for i in range(400):
        ts = None if i % 90 == 13 else t0 + dt.timedelta(seconds=i * 40 + random.randint(-240, 240))
        rows.append((i, ts, random.choice(["p", "q", None]), random.choice(["d", "e"]), random.choice(["s", "t", None]), random.choice(["G1", "G2", None]), random.choice([None, random.random() * 1e4]),
                     random.choice([None, random.random()]), f"r{random.randint(0, 60)}", random.choice(["aws", "gcp", None])))
    return spark.createDataFrame(rows, "event_ord long, ts timestamp, principal_id string, device_id string, session_id string, geo string, bytes_out double, posture_score double, resource_id string, cloud_provider string")


@pytest.mark.parametrize("key", ["principal_id", "device_id", "session_id"])
def test_features_stream(spark, events, tmp_path, key):
    timed = events.filter("ts IS NOT NULL")
    last = timed.filter("event_ord = 399").withColumns({"event_ord": F.lit(10_000).cast("long"), "ts": F.lit("2024-02-01 00:00:00").cast("timestamp"), key: F.lit("end")})
    parts = [events.filter(F.col("event_ord").between(a, a + 99)).orderBy(F.rand(1)) for a in (0, 100, 200, 300)]
    source = stream_of(spark, events, str(tmp_path / "in"), [*parts, last.select(*events.columns)])
    out = streamed.features_stream(source, key, delay="20 minutes")
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(400)
    names = [*streamed.PROCESSORS[key].results]
    made = {"principal_id": lambda d: features.new_resource(features.bytes_spike(features.geo_features(d))), "device_id": features.posture_drift, "session_id": features.session_hops}[key](timed)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = {r.event_ord: [plain(r[c]) for c in names] for r in made.collect()}
    got = {r.event_ord: [plain(r[c]) for c in names] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
