"""The graph kept up to date by micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph
from ..operators.lineage import cut
from ..sources.graph_store import GraphStore


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_ord once, if its repetition comes within the watermark; the state of an event goes when the watermark passes it, and
    events behind the watermark are dropped.  Events without a timestamp have no watermark: they pass, repetitions too."""
    timed = events.filter("ts IS NOT NULL").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_ord"])
    return timed.unionByName(events.filter("ts IS NULL"))


def graph_stream(events: DataFrame, path: str, checkpoint: str, every: str | None = None, delay: str = "1 hour", buckets: int = 64):
    """Merges the events of each micro-batch into the store under path.

    A batch rewrites only the buckets that its nodes and edges fall into.  A batch that is run again merges the same rows into the same
    predecessor under the same number, so each event counts once; merges commute, so late events count too."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = cut(batch)
        tables = {"nodes": graph.nodes(graph.node_events(rows)), "edges": graph.edges(graph.edge_events(rows))}
        GraphStore(batch.sparkSession, path, buckets).commit(tables, {"nodes": graph.merge_nodes, "edges": graph.merge_edges}, number)

    writer = deduplicated(events, delay).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
