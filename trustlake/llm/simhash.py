"""SimHash near-deduplication with vantage-point trees.

Fingerprints: words are lower-cased (A-Z) runs of characters outside [\\x20\\x09-\\x0D]; a fingerprint bit is 1 if it is set in over half
of the XXH64 values (seed 42) of the document's word shingles, repeats included.  Documents are linked when their fingerprints differ
in at most `max_bits` bits; a component is what links reach.

Equal fingerprints are collapsed first, so a group of copies of any size is one point.  A vantage-point tree is built on the driver
over a bounded sample of the distinct fingerprints (`sample` of them, the smallest hashes): each node has a vantage point and a radius,
its leaves are the shards.  Every distinct fingerprint (not only the sample) goes down the tree: to its own shard, and, by the triangle
bound, to each shard across a boundary that is within max_bits of it.  A shard whose own points exceed a block is searched with a
vantage-point tree of its own, so no shard is a cross product.  Each shard yields only a spanning forest of its links (at most one
edge a point), found by union-find over the pairs that it meets, hence no pairs of a group are emitted; components of the forest edges
come from label propagation with pointer jumping, on Spark.

Defined results: null text is empty; without words the fingerprint is zero and is linked like any other; fewer words than a shingle:
the whole sequence is the shingle; component_id is the smallest doc_id in the component (null if all are null); repeated rows give
repeated result rows; an empty table gives an empty result; other columns are ignored, and passed on by
simhash_dedup but for _row.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import sized, small, staged, without

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint, as an unsigned integer."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    joined, width = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count = len(found) - width + 1
    hashes = np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:count].tolist(), ends[width - 1 :].tolist())), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            values = np.fromiter((fingerprint(t, words) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, f"doc_id {kind}, fp long")


# The tree, as arrays: node i splits at distance radius[i] from vantage[i]; a child >= 0 is a node, one < 0 is leaf ~child.


def build_tree(points: np.ndarray, leaf: int, seed: int = 7) -> dict[str, np.ndarray]:
    """A vantage-point tree over distinct points; leaves hold at most `leaf` of them unless no vantage point splits them."""
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []
    leaves = 0

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        if len(own) > leaf:
            best = None
            for v in rng.choice(own, size=min(12, len(own)), replace=False):
                d = np.bitwise_count(own ^ v).astype(np.int64)
                for radius in {int(np.median(d)), int(np.median(d)) - 1, int(np.median(d)) + 1}:
                    inside = d <= radius
                    share = inside.mean()
                    if not 0.1 <= share <= 0.9:
                        continue
                    crossing = (np.abs(2 * d - 2 * radius - 1) <= 4).mean()
                    if best is None or crossing + abs(share - 0.5) < best[0]:
                        best = (crossing + abs(share - 0.5), v, radius, inside)
            if best is not None:
                at = len(nodes)
                nodes.append([int(best[1]), best[2], 0, 0])
                nodes[at][2] = grow(own[best[3]])
                nodes[at][3] = grow(own[~best[3]])
                return at
        leaves += 1
        return ~(leaves - 1)

    root = grow(points)
    table = np.array(nodes, dtype=object).reshape(-1, 4)
    return {
        "root": root, "leaves": leaves, "vantage": table[:, 0].astype(np.uint64), "radius": table[:, 1].astype(np.int64),
        "inside": table[:, 2].astype(np.int64), "outside": table[:, 3].astype(np.int64),
    }


def descend(tree: dict, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of point, leaf, whether it is the point's own leaf) for every leaf that may hold something within `reach` of the point."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(tree["root"], np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((at, ~node, own))
            continue
        d = np.bitwise_count(points[at] ^ tree["vantage"][node]).astype(np.int64)
        inside = d <= tree["radius"][node]
        near_in, near_out = d - reach <= tree["radius"][node], d + reach > tree["radius"][node]
        todo.append((int(tree["inside"][node]), at[near_in], (own & inside)[near_in]))
        todo.append((int(tree["outside"][node]), at[near_out], (own & ~inside)[near_out]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([a for a, _, _ in out]), np.concatenate([np.full(len(a), k) for a, k, _ in out]), np.concatenate([o for _, _, o in out])


class _Forest:
    """Union-find; remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, pairs: np.ndarray) -> None:
        for i, j in pairs.tolist():
            a, b = self.top(i), self.top(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))


def forest_of(points: np.ndarray, own: np.ndarray, reach: int, block: int = 8192) -> list[tuple[int, int]]:
    """A spanning forest of the links between `points` (own ones with any) of one shard."""
    trees = _Forest(len(points))
    if own.sum() <= block:
        parts = [(np.flatnonzero(own), np.arange(len(points)))]
    else:
        tree = build_tree(points[:: max(1, len(points) // 65536)], block // 2)
        at, leaf, mine = descend(tree, points, reach)
        order = np.argsort(leaf, kind="stable")
        at, leaf, mine = at[order], leaf[order], mine[order]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        parts = [(a[m & own[a]], a) for a, m in zip(np.split(at, cuts), np.split(mine, cuts))]
    for queries, others in parts:
        for s in range(0, len(queries), 256):
            q = queries[s : s + 256]
            for o in range(0, len(others), 4096):
                t = others[o : o + 4096]
                near = np.bitwise_count(points[q][:, None] ^ points[t][None, :]) <= reach
                i, j = np.nonzero(near)
                pairs = np.column_stack((q[i], t[j]))
                trees.join(pairs[pairs[:, 0] != pairs[:, 1]])
    return trees.links


def links(points: DataFrame, max_bits: int = 2, shard: int = 4096, sample: int = 65536, bound: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): a spanning forest of each shard's links; together they connect exactly
    what links of at most max_bits bits connect.  `shard` is the number of points a leaf aims at, `sample` bounds the driver's share; a
    leaf of more than `bound` (8 x shard) points of its own is split by a tree of its own, so shards don't grow with the corpus."""
    spark = points.sparkSession
    total = points.count()
    seen = points.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = build_tree(seen, max(8, int(shard * len(seen) / max(total, 1))))
    given = spark.sparkContext.broadcast(tree)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = b["fp"].to_numpy(np.int64)
            at, leaf, own = descend(given.value, values.view(np.uint64), max_bits)
            yield pd.DataFrame({"fp": values[at], "leaf": leaf, "own": own})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        values = pdf["fp"].to_numpy(np.int64)
        found = np.array(forest_of(values.view(np.uint64), pdf["own"].to_numpy(bool), max_bits), dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": values[found[:, 0]], "b": values[found[:, 1]]})

    spread_out = points.select("fp").mapInPandas(spread, "fp long, leaf long, own boolean")
    if total > (bound or 8 * shard):
        spread_out = _split_again(staged(spread_out), max_bits, shard, bound or 8 * shard)
    return spread_out.groupBy("leaf").applyInPandas(within, "a long, b long").distinct()


def _split_again(rows: DataFrame, max_bits: int, shard: int, bound: int, sample: int = 2048) -> DataFrame:
    """rows (fp, leaf, own) with leaves of more than bound own points split: each by a tree over about `sample` of its points, built
    on executors.  A point goes to all parts that may hold something within reach of it, as in the first tree, so no link is lost."""
    big = staged(rows.filter("own").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound))
    if big.isEmpty():
        return rows
    draw = F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(1 << 20))
    some = rows.filter("own").join(sized(big), "leaf").filter(draw < F.lit(float(sample << 20)) / F.col("n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        tree = build_tree(values, max(8, int(shard * len(values) / pdf["n"].iloc[0])))
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "tree": [pickle.dumps(tree)]})

    # At most sample / 8 nodes a leaf, and leaves of the first tree are at most an eighth of its sample.
    trees = {r["leaf"]: pickle.loads(r["tree"]) for r in some.groupBy("leaf").applyInPandas(build, "leaf long, tree binary").toLocalIterator()}
    given = rows.sparkSession.sparkContext.broadcast(trees)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for leaf, part in b.groupby("leaf"):
                values, own = part["fp"].to_numpy(np.int64), part["own"].to_numpy(bool)
                if leaf in given.value:
                    at, sub, mine = descend(given.value[leaf], values.view(np.uint64), max_bits)
                    yield pd.DataFrame({"fp": values[at], "leaf": (leaf << 20) + 1 + sub, "own": own[at] & mine})
                else:
                    yield pd.DataFrame({"fp": values, "leaf": leaf << 20, "own": own})

    return rows.mapInPandas(again, "fp long, leaf long, own boolean")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, label: the smallest node of its component, for every node of `edges` (a, b).  Min-label propagation with pointer jumping,
    so rounds grow with the logarithm of a chain's length; each round is written to the shared folder."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("before"), F.least("label", "theirs").alias("label"))
        # The old label takes the new one too (its own tree joins), then each node jumps to its label's label.
        told = step.groupBy(F.col("before").alias("node")).agg(F.min("label").alias("told"))
        step = staged(step.join(told, "node", "left").select("node", "before", F.least("label", "told").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(step.join(jump, "label", "left").select("node", "before", F.least("label", "next").alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> before").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _of_fingerprints(found: DataFrame, max_bits: int) -> DataFrame:
    """fp, grp (one value for each component) and first_id of the distinct fingerprints of `found`."""
    points = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(points, max_bits))
    return points.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("grp"), "first_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id of each row."""
    found = staged(fingerprints(docs, id_col, text_col, words))
    named = _of_fingerprints(found, max_bits)
    ids = named.groupBy("grp").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(ids, "grp").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), of rows with that id one by its digest and number.  Rows
    are told apart by a number, so unlike rows that share an id, or have none, are decided each by itself."""
    docs = without(docs, "_row")
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()))
    place = docs.select(F.col("_row").alias("doc_id"), F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col("_row").alias("nth")).alias("place"))
    found = staged(fingerprints(docs, "_row", text_col, words))
    named = _of_fingerprints(found, max_bits).select("fp", "grp")
    kept = found.join(place, "doc_id").join(named, "fp").groupBy("grp").agg(F.min("place").alias("p")).select(F.col("p.nth").alias("_row"))
    return docs.join(sized(staged(kept)), "_row", "left_semi").drop("_row").select(*[c for c in docs.columns if c != "_row"])
