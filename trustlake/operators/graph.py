"""The trust graph: nodes and edge events of each access event, their merged aggregates, and queries and traversals over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import apart, cut, sized

SENSITIVE = ("high", "critical", "secret")
OPERATIONAL = ("accessed", "data-read", "called-api", "assumed-role", "token-issued")


def _ids(df: DataFrame) -> dict[str, Column]:
    """Node id of each kind, '' where the event has none; tenants and regions are told apart by their cloud."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit("")
    cloud = text("cloud_provider")
    named = lambda kind, v: F.when(v != "", F.concat(F.lit(f"{kind}:"), v)).otherwise("")
    inside = lambda v: F.when((cloud != "") & (v != ""), F.concat_ws(":", cloud, v)).otherwise(v)
    return {
        "cloud": named("cloud", cloud), "tenant": named("tenant", inside(text("tenant_id"))), "region": named("region", inside(text("region"))),
        **{k: named(k, text(c)) for k, c in (("principal", "principal_id"), ("role", "role"), ("device", "device_id"), ("workload", "workload_id"), ("resource", "resource_id"), ("session", "session_id"), ("token", "token_id"), ("api", "api"))},
    }


#: The attributes that a node of each kind keeps.
ATTRIBUTES = {
    "cloud": ("cloud_provider",), "tenant": ("tenant_id", "cloud_provider"), "region": ("region", "cloud_provider"), "principal": ("principal_id", "principal_type"), "role": ("role",),
    "device": ("device_id", "posture_score"), "workload": ("workload_id",), "resource": ("resource_id", "resource_type", "resource_sensitivity"), "session": ("session_id",),
    "token": ("token_id", "token_scope"), "api": ("api",),
}


def node_events(df: DataFrame) -> DataFrame:
    """ts, event_ord, node_id, node_type, attrs_json, sensitivity (of resources): up to eleven rows of each event."""
    ids = _ids(df)
    made = []
    for kind, i in ids.items():
        own = [F.col(c).alias("sensitivity" if c == "resource_sensitivity" else c) for c in ATTRIBUTES[kind] if c in df.columns]
        sens = F.col("resource_sensitivity") if kind == "resource" else F.lit(None).cast("string")
        made.append(F.struct(i.alias("node_id"), F.lit(kind).alias("node_type"), F.to_json(F.struct(*own)).alias("attrs_json"), sens.alias("sensitivity")))
    return df.select("ts", "event_ord", F.explode(F.filter(F.array(*made), lambda n: n["node_id"] != "")).alias("n")).select("ts", "event_ord", "n.*")


def edge_events(df: DataFrame) -> DataFrame:
    """Up to twelve typed edges of each event; only accessed and data-read carry sensitivity and bytes."""
    i, c = _ids(df), F.col
    none, zero = F.lit(""), F.lit(0.0)
    nbytes = F.coalesce(c("bytes_out"), zero)

    def edge(kind, src, dst, when=F.lit(True), sens=none, amount=zero):
        return F.when(when & (src != "") & (dst != ""), F.struct(F.lit(kind).alias("edge_type"), src.alias("src_id"), dst.alias("dst_id"), sens.alias("sensitivity"), amount.alias("edge_bytes")))

    sens = F.coalesce("resource_sensitivity", none)
    reads = F.lower("action").isin("read", "download", "list") | (nbytes > 0)
    made = F.array(
        edge("connected-to", i["tenant"], i["cloud"]), edge("connected-to", i["region"], i["cloud"]), edge("connected-to", i["principal"], i["tenant"]),
        edge("connected-to", i["principal"], i["cloud"], i["tenant"] == ""), edge("assumed-role", i["principal"], i["role"]), edge("connected-to", i["principal"], i["device"]),
        edge("connected-to", i["principal"], i["workload"]), edge("connected-to", i["resource"], i["region"]), edge("connected-to", i["principal"], i["session"]),
        edge("token-issued", i["session"], i["token"]), edge("token-issued", i["principal"], i["token"], i["session"] == ""), edge("called-api", i["principal"], i["api"]),
        edge("accessed", i["principal"], i["resource"], sens=sens, amount=nbytes), edge("data-read", i["principal"], i["resource"], reads, sens, nbytes),
    )
    keep = ["ts", "event_ord", "cloud_provider", "tenant_id", "region", "access_result", "action", "api", "operation", "label_attack", "attack_type"]
    return df.select(*[k for k in keep if k in df.columns], F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("*", "e.*").drop("e").withColumnRenamed("edge_bytes", "bytes_out")


def nodes(events: DataFrame) -> DataFrame:
    """Merged nodes: first and last sight, attributes of the last event (equal times: of the later row)."""
    last = F.struct("ts", "event_ord")
    return events.groupBy("node_id", "node_type").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("event_ord").alias("last_ord"),
        F.max_by("attrs_json", last).alias("attrs_json"), F.max_by("sensitivity", last).alias("sensitivity"),
    )


def edge_key() -> Column:
    return F.concat_ws("::", "src_id", "edge_type", "dst_id", "cloud_provider")


def edges(events: DataFrame) -> DataFrame:
    """Merged edges: counts by result, attacks, bytes, first and last sight."""
    said = lambda v: F.count_if(F.lower("access_result") == v)
    return events.withColumn("cloud_provider", F.coalesce(F.nullif("cloud_provider", F.lit("")), F.lit("unknown"))).groupBy("src_id", "edge_type", "dst_id", "cloud_provider").agg(
        F.count(F.lit(1)).alias("event_count"), said("permit").alias("permit_count"), said("deny").alias("deny_count"), said("restrict").alias("restrict_count"),
        F.count_if(F.col("label_attack") == 1).alias("attack_count"), F.sum("bytes_out").alias("bytes_out_sum"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    ).withColumn("edge_key", edge_key())


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two merged node tables in one; the merge commutes, so late events do no harm."""
    last = F.struct("last_seen", "last_ord")
    return old.unionByName(new).groupBy("node_id", "node_type").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen_"), F.max_by("last_ord", last).alias("last_ord_"), F.max_by("attrs_json", last).alias("attrs_json"),
        F.max_by("sensitivity", last).alias("sensitivity"),
    ).withColumnsRenamed({"last_seen_": "last_seen", "last_ord_": "last_ord"}).select(*old.columns)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    counts = [F.sum(c).alias(c) for c in ("event_count", "permit_count", "deny_count", "restrict_count", "attack_count", "bytes_out_sum")]
    return old.unionByName(new).groupBy("src_id", "edge_type", "dst_id", "cloud_provider").agg(*counts, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("edge_key", edge_key()).select(*old.columns)


def incremental(old_nodes: DataFrame, old_edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the events after its last one (the largest last_seen); running it again changes nothing."""
    mark = old_edges.agg(F.max("last_seen").alias("mark"))
    fresh = events.crossJoin(F.broadcast(mark)).filter(F.col("mark").isNull() | (F.col("ts") > F.col("mark"))).drop("mark")  # one row
    return merge_nodes(old_nodes, nodes(node_events(fresh))), merge_edges(old_edges, edges(edge_events(fresh)))


def stats(node_table: DataFrame, edge_event_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, t in (("nodes", node_table), ("edge_events", edge_event_table), ("edges_agg", edge_table))]
    return reduce(DataFrame.unionByName, parts)


def sensitive_nodes(node_table: DataFrame) -> DataFrame:
    return node_table.filter((F.col("node_type") == "resource") & F.lower("sensitivity").isin(*SENSITIVE)).select("node_id")


def neighbors(edge_table: DataFrame) -> DataFrame:
    """a, b: both directions of every edge, once."""
    return edge_table.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(edge_table.select("dst_id", "src_id")).distinct()


def hops_to_sensitive(edge_table: DataFrame, sensitive: DataFrame, max_hops: int = 6) -> DataFrame:
    """node, hops (undirected, up to max_hops) of every node that a sensitive one reaches: one search from all sensitive nodes at
    once, so the work does not grow with the number of principals."""
    near = cut(neighbors(edge_table))
    seen = front = sensitive.select(F.col("node_id").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, max_hops + 1):
        step = front.join(near, front["node"] == near["a"]).select(F.col("b").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        front = cut(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def blast_radius(edge_table: DataFrame, sensitive: DataFrame, starts: DataFrame, k: int = 3) -> DataFrame:
    """node, blast: distinct sensitive nodes within k undirected hops of each start, itself excluded.

    Sensitive nodes carry numbers, dense within a partition; each node holds the set of what it reaches as bitmaps of 32,768 numbers a bucket, and takes over its
    neighbours' in k rounds: rows stay at nodes x buckets even around hubs."""
    near = cut(neighbors(edge_table))
    numbered = cut(sensitive.distinct()).withColumn("n", F.monotonically_increasing_id())
    held = numbered.groupBy(F.col("node_id").alias("node"), F.expr("bitmap_bucket_number(n + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(n + 1))").alias("bits"))
    own = held
    for _ in range(k):
        told = near.join(apart(held), near["b"] == held["node"]).select(F.col("a").alias("node"), "bucket", "bits")
        held = cut(told.unionByName(held).groupBy("node", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits")))
    count = held.groupBy("node").agg(F.sum(F.expr("bitmap_count(bits)")).alias("all"))
    mine = own.select("node", F.lit(1).alias("self"))
    out = starts.join(count, "node", "left").join(mine, "node", "left")
    return out.select("node", (F.coalesce("all", F.lit(0)) - F.coalesce("self", F.lit(0))).cast("long").alias("blast"))


def static_features(edge_table: DataFrame, node_table: DataFrame, max_hops: int = 6, k: int = 3) -> DataFrame:
    """principal_id, g_shortest_to_sensitive_hops (-1 beyond max_hops), g_blast_radius_sensitive_k."""
    sensitive = cut(sensitive_nodes(node_table))
    starts = node_table.filter("node_type = 'principal'").select(F.col("node_id").alias("node"))
    found = starts.join(hops_to_sensitive(edge_table, sensitive, max_hops), "node", "left").join(blast_radius(edge_table, sensitive, starts, k), "node")
    return found.select(F.substring_index("node", "principal:", -1).alias("principal_id"), F.coalesce("hops", F.lit(-1)).alias("g_shortest_to_sensitive_hops"), F.col("blast").alias("g_blast_radius_sensitive_k"))


def next_to_goal(edge_table: DataFrame, goals: DataFrame, max_hops: int = 6) -> DataFrame:
    """node, hops, next: of every node with a directed path to a goal, the length of the shortest one and its next node (of equals the
    smallest).  One search backwards from all goals at once: a row a node, however many starts there are."""
    back = cut(edge_table.select("src_id", "dst_id").distinct())
    front = cut(goals.select("node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("next")).distinct())
    seen = front
    for hop in range(1, max_hops + 1):
        step = back.join(front.select(F.col("node").alias("dst_id")), "dst_id").groupBy(F.col("src_id").alias("node")).agg(F.min("dst_id").alias("next"))
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops"), "next"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edge_table: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int = 6) -> DataFrame:
    """start, goal, path, hops: for each start a shortest directed path to a goal (of equals the smallest path).

    The smallest next node at each step makes the smallest path; it is followed from all starts at once, a join a hop."""
    pointers = sized(cut(next_to_goal(edge_table, goals, max_hops)))
    known = pointers.select("node", "hops", F.col("next").alias("_next"))
    found = starts.select("node").distinct().join(known, "node").select(F.col("node").alias("start"), "hops", F.array("node").alias("path"), F.col("_next").alias("_at"))
    follow = pointers.select(F.col("node").alias("_at"), F.col("next").alias("_then"))
    for _ in range(max_hops):
        step = found.join(follow, "_at", "left")
        found = step.select("start", "hops", F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_at"))).alias("path"), F.col("_then").alias("_at"))
    return found.select("start", F.element_at("path", -1).alias("goal"), "path", "hops")


def pivots(edge_table: DataFrame) -> DataFrame:
    """Of each principal over accessed and connected-to edges: its clouds, sorted, and how many resources and tenants it met."""
    of = edge_table.filter(F.col("edge_type").isin("accessed", "connected-to") & F.col("src_id").startswith("principal:"))
    met = lambda kind: F.count_distinct(F.when(F.col("dst_id").startswith(f"{kind}:"), F.col("dst_id")))
    return of.groupBy(F.col("src_id").alias("principal")).agg(F.array_sort(F.collect_set("cloud_provider")).alias("clouds"), met("resource").alias("n_resources"), met("tenant").alias("n_tenants"))


def top_risky(edge_table: DataFrame, n: int = 20) -> DataFrame:
    score = F.col("deny_count") + 2 * F.col("attack_count") + F.log1p(F.col("bytes_out_sum") / 1e6)
    return edge_table.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "edge_key").limit(n)


def top_risky_operational(edge_table: DataFrame, n: int = 10) -> DataFrame:
    score = F.col("attack_count") * 10 + F.col("deny_count") + F.col("bytes_out_sum") / 1e6
    return edge_table.filter(F.col("edge_type").isin(*OPERATIONAL)).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "edge_key").limit(n)
