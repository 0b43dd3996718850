"""Model jobs: isolation forest, calibration, scaling, splits, fusion and the scorers composed of them.

Each row has one draw, a hash of its event_ord; a tree takes the rows whose draw lies in its window of width psi / n, so a tree's sample is
bounded, does not depend on partitioning, and a row costs one hash however many trees there are.  Splits are hashes of tree and node.
Trees are built in parallel, one group each; nodes come back as a table of at most trees x 2 psi rows of each model, which is broadcast
to score.  Everything can be said in SQL too, level by level."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from . import rules
from .lineage import cut
from .ordered import ordinal
from .quantiles import quantiles

#: The features of the two forests.
RAAC_FEATURES = ("bytes_out", "latency_ms", "token_age", "posture_score", "raw_login_failures_5m", "raw_api_calls_5m")
UNIFIED_FEATURES = (
    "f_token_scope_width", "f_token_age", "f_bytes_out_log1p", "f_failed_logins_5m", "f_geo_switch", "f_fast_geo_switch", "f_posture_drift", "f_bytes_spike_score", "f_is_privileged_role",
    "g_cross_cloud_hops_session", "g_is_new_resource_edge", "g_new_resource_count_win", "g_new_resource_rate_win", "g_shortest_to_sensitive_hops", "g_blast_radius_sensitive_k",
)
NODE = "model string, tree int, node int, feature int, threshold double, depth double, norm double"


def benign(df: DataFrame, least: int, share: float = 0.1) -> DataFrame:
    """The benign rows, or all if these are fewer than max(least, share of all)."""
    counts = df.agg((F.count_if(F.col("label_attack") == 0) >= F.greatest(F.lit(float(least)), F.lit(share) * F.count(F.lit(1)))).alias("_enough"))
    return df.crossJoin(F.broadcast(counts)).filter((F.col("label_attack") == 0) | ~F.col("_enough")).drop("_enough")  # one row


def path_length(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _unit(text: str, seed: int) -> float:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:8], 16) / 4294967295


def sampled(rows: DataFrame, trees: int, psi: int, seed: int) -> DataFrame:
    """rows (model, event_ord, x) with tree: windows start at tree / trees and wrap around at 1."""
    counts = F.broadcast(rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")))  # a row a model
    draw = S.unit_hash(F.concat(F.lit("row:"), F.col("event_ord")), seed)
    low = F.floor((draw - F.least(F.lit(1.0), F.lit(float(psi)) / F.col("n"))) * trees).cast("int") + 1
    high = F.floor(draw * trees).cast("int")
    own = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    d = rows.join(counts, "model").select("model", "event_ord", "x", F.explode(own).alias("_t"))
    return d.select("model", "event_ord", "x", F.pmod("_t", F.lit(trees)).alias("tree"))


def grow(x: np.ndarray, tree: int, limit: int, seed: int) -> list[tuple]:
    """(node, feature, threshold, depth) of one tree: the root is 1, the children of k are 2 k (values below the threshold) and 2 k + 1;
    leaves have feature -1 and the expected depth."""
    out, todo = [], [(1, np.arange(len(x)), 0)]
    while todo:
        node, at, depth = todo.pop()
        low, high = x[at].min(axis=0), x[at].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= limit or len(at) <= 1 or not len(wide):
            out.append((node, -1, 0.0, depth + float(path_length(len(at)))))
            continue
        f = int(wide[min(len(wide) - 1, int(_unit(f"{tree}:{node}:f", seed) * len(wide)))])
        threshold = low[f] + _unit(f"{tree}:{node}:t", seed) * (high[f] - low[f])
        threshold = high[f] if threshold <= low[f] else threshold
        below = x[at, f] < threshold
        out.append((node, f, float(threshold), 0.0))
        todo += [(2 * node, at[below], depth + 1), (2 * node + 1, at[~below], depth + 1)]
    return out


def iforest_fit(df: DataFrame, columns: tuple[str, ...], trees: int, psi: int = 256, seed: int = 42, group: str | None = None) -> DataFrame:
    """Node rows of `trees` isolation trees of one model, all, or of one model for each value of `group`.  norm is the expected depth
    among as many rows as a tree samples."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("unknown")) if group else F.lit("all")
    rows = cut(df.select(key.alias("model"), "event_ord", F.array(*[S.number(F.col(c)) for c in columns]).alias("x")))
    limit = math.ceil(math.log2(max(psi, 2)))
    sizes = rows.groupBy("model").agg(F.least(F.count(F.lit(1)), F.lit(psi)).alias("_n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        name, tree = pdf["model"].iloc[0], int(pdf["tree"].iloc[0])
        return pd.DataFrame([(name, tree, *row) for row in grow(np.array(pdf["x"].tolist()), tree, limit, seed)], columns=["model", "tree", "node", "feature", "threshold", "depth"])

    nodes = sampled(rows, trees, psi, seed).groupBy("model", "tree").applyInPandas(build, "model string, tree int, node int, feature int, threshold double, depth double")
    n = F.col("_n").cast("double")
    norm = F.when(n > 2, 2 * (F.log(n - 1) + F.lit(0.5772156649015329)) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(1.0)
    return nodes.join(F.broadcast(sizes), "model").select(*[c.split()[0] for c in NODE.split(", ")[:-1]], norm.alias("norm"))  # a row a model


#: Models that one scoring job holds at most; each has at most trees x 2 psi nodes.
MODELS = 64


def iforest_score(df: DataFrame, model: DataFrame, columns: tuple[str, ...], route: Column | None = None) -> DataFrame:
    """df with raw_anom, 2 ** -(mean depth / expected depth), higher for rarer rows, null where the routed model does not exist.

    route: the name of each row's model (by default all); rows go to their model's nodes inside one Arrow function, so the plan does not
    depend on how many models there are."""
    if len(model.select("model").distinct().limit(MODELS + 1).collect()) > MODELS:
        raise ValueError(f"more than {MODELS} models")
    table = model.toPandas()
    dense = {}
    for (name, tree), own in table.groupby(["model", "tree"]):
        size = int(own["node"].max()) + 1
        feature, threshold, depth = np.full(size, -1, np.int16), np.zeros(size), np.zeros(size)
        at = own["node"].to_numpy()
        feature[at], threshold[at], depth[at] = own["feature"], own["threshold"], own["depth"]
        dense.setdefault(name, (float(own["norm"].iloc[0]), []))[1].append((feature, threshold, depth))
    given = df.sparkSession.sparkContext.broadcast(dense)

    def deep(x: np.ndarray, trees: list) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, depth in trees:
            at = np.ones(len(x), np.int64)
            inner = np.arange(len(x))
            while len(inner := inner[feature[at[inner]] >= 0]):
                now = at[inner]
                at[inner] = 2 * now + (x[inner, feature[now]] >= threshold[now])
            total += depth[at]
        return total / max(1, len(trees))

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, names in batches:
            x, out = np.array(x.tolist(), float).reshape(-1, len(columns)), np.full(len(names), np.nan)
            for name, at in names.groupby(names).groups.items():
                if name in given.value:
                    norm, trees = given.value[name]
                    places = names.index.get_indexer(at)
                    out[places] = 2 ** -(deep(x[places], trees) / norm)
            yield pd.Series(out).astype("Float64").mask(np.isnan(out))

    score_udf = F.pandas_udf(score, "double")
    return df.withColumn("raw_anom", score_udf(F.array(*[S.number(F.col(c)) for c in columns]), route if route is not None else F.lit("all")))


def quantile_scaled(df: DataFrame, train: DataFrame, column: str = "raw_anom", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with s_anom: column between the training rows' quantiles, clipped."""
    q = quantiles(train, F.col(column), (low, high)).withColumnRenamed("q", "_q")  # one row
    scaled = (F.col(column) - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6))
    return df.crossJoin(F.broadcast(q)).withColumn("s_anom", S.clip01(scaled)).drop("_q")


def ecdf(df: DataFrame, train: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """df with p: the share of training values not above the row's.  Values are dealt to ranges; within one, a running sum over the
    distinct values gives the count, and whole ranges below are added: no global window."""
    edges = train.agg(F.percentile_approx(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("_edges"))  # one row
    own = df.crossJoin(F.broadcast(edges)).withColumn("_r", F.size(F.filter("_edges", lambda e: e < F.col(column)))).drop("_edges")
    hist = train.crossJoin(F.broadcast(edges)).select(F.col(column).alias("v"), F.size(F.filter("_edges", lambda e: e < F.col(column))).alias("_r")).groupBy("_r", "v").agg(F.count(F.lit(1)).alias("n"))
    hist = cut(hist)
    sizes = hist.groupBy("_r").agg(F.sum("n").alias("m"))
    total = F.broadcast(hist.agg(F.sum("n").alias("total")))
    values = own.select("_r", F.col(column).alias("v")).distinct().withColumn("n", F.lit(0).cast("long")).unionByName(hist.select("_r", "v", "n")).groupBy("_r", "v").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("_r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.withColumn("upto", running).crossJoin(total)
    whole = F.broadcast(sizes.select(F.collect_list(F.struct("_r", "m")).alias("all")))  # one row, an entry a range
    ranks = ranks.crossJoin(whole).withColumn("below", F.aggregate(F.filter("all", lambda s: s["_r"] < F.col("_r")), F.lit(0).cast("long"), lambda a, s: a + s["m"]))
    ranks = ranks.select(F.col("_r").alias("_r2"), F.col("v").alias("_v"), ((F.col("upto") + F.col("below")) / F.col("total")).alias("p"))
    return own.join(ranks, (own["_r"] == ranks["_r2"]) & own[column].eqNullSafe(ranks["_v"]), "left").withColumn("p", F.coalesce("p", F.lit(0.0))).drop("_r", "_r2", "_v")


def robust_scaled(df: DataFrame, train: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with scaled: column less the training median, over the training range of the quantiles (0 range: 1)."""
    q = quantiles(train, F.col(column), (0.5, low, high)).withColumnRenamed("q", "_q")  # one row
    width = F.col("_q")[2] - F.col("_q")[1]
    return df.crossJoin(F.broadcast(q)).withColumn("scaled", (F.col(column) - F.col("_q")[0]) / F.when(width == 0, 1.0).otherwise(width)).drop("_q")


def learned_categories(train: DataFrame, columns: tuple[str, ...], most: int = 1000) -> dict[str, tuple[str, ...]]:
    """The values of each column in the training rows, sorted; a column with more than `most` is no category and raises an error."""
    found = {c: tuple(r[0] for r in train.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()) for c in columns}
    for c, own in found.items():
        if len(own) > most:
            raise ValueError(f"{c} has more than {most} values")
    return found


def feature_matrix(df: DataFrame, train: DataFrame, categories: dict[str, tuple[str, ...]] | tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """df with is_<column>_<value> (0/1; values that are not known give zeros) and z_<column> by the training mean and population
    deviation.  categories: the values of each column, or the columns, whose values are then learned from the training rows."""
    if not isinstance(categories, dict):
        categories = learned_categories(train, categories)
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"_s_{c}") for c in numbers])  # one row
    d = df.crossJoin(F.broadcast(stats))
    dummies = {f"is_{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c, own in categories.items() for v in own}
    scaled = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in numbers}
    return d.withColumns(dummies | scaled).drop(*stats.columns)


def time_split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """df with train: whether it is among the first int(share x n) rows by (ts, event_ord); rows without a timestamp come last."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))  # one row
    d = ordinal(df, F.unix_micros("ts"), ("ts", "event_ord"), "_before").crossJoin(total)
    return d.withColumn("train", F.col("_before") < F.floor(F.lit(share) * F.col("_total"))).drop("_before", "_total")


def raac_score(df: DataFrame, train: DataFrame | None = None, trees: int = 160, model: DataFrame | None = None) -> DataFrame:
    """Context and isolation-forest risk of each event."""
    fit_on = benign(train if train is not None else df, 200)
    model = cut(model if model is not None else iforest_fit(fit_on, RAAC_FEATURES, trees))
    d = iforest_score(rules.raac_context(df), model, RAAC_FEATURES)
    return rules.raac_fuse(quantile_scaled(d, iforest_score(fit_on, model, RAAC_FEATURES)))


#: The name of the model of all providers, which no provider has.
_SHARED = "*"


def per_cloud_score(df: DataFrame, least: int = 400, trees: int = 160) -> DataFrame:
    """Each provider's events by its own model if it has `least` training rows, else by that of all; percloud_provider, percloud_model.

    One job for all providers: rows are routed to their model's nodes, and its scores' training quantiles are a row a model."""
    d = df.withColumn("percloud_provider", F.coalesce(F.lower("cloud_provider"), F.lit("unknown")))
    train = cut(benign(d, 200))
    big = F.broadcast(train.groupBy(F.col("percloud_provider").alias("_big")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("_big"))  # see MODELS
    own = iforest_fit(train.join(big, F.col("percloud_provider") == F.col("_big"), "left_semi"), RAAC_FEATURES, trees, group="percloud_provider")
    model = cut(own.unionByName(iforest_fit(train, RAAC_FEATURES, trees).withColumn("model", F.lit(_SHARED))))
    # A model learns its quantiles from the rows that it was fitted on: all of them for the shared one.
    models = F.filter(F.array("_big", F.lit(_SHARED)), lambda m: m.isNotNull())
    learned = train.join(big, F.col("percloud_provider") == F.col("_big"), "left").withColumn("_model", F.explode(models))
    q = quantiles(iforest_score(learned, model, RAAC_FEATURES, F.col("_model")), F.col("raw_anom"), (0.05, 0.95), ("_model",))
    d = d.join(big, F.col("percloud_provider") == F.col("_big"), "left")
    d = d.withColumns({"_model": F.coalesce("_big", F.lit(_SHARED)), "percloud_model": F.coalesce("_big", F.lit("global"))}).drop("_big")
    d = iforest_score(rules.raac_context(d), model, RAAC_FEATURES, F.col("_model")).join(F.broadcast(q), "_model").drop("_model")  # a row a model
    scaled = (F.col("raw_anom") - F.col("q")[0]) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-6))
    out = rules.raac_fuse(d.withColumn("s_anom", S.clip01(scaled)).drop("q"))
    return out.withColumn("rationale_tags", F.concat("rationale_tags", F.array(F.concat(F.lit("percloud_"), "percloud_model"))))


def supervised_fusion(df: DataFrame, least: int = 2000, c: float = 1.0) -> DataFrame:
    """df with risk and confidence by a balanced logistic regression on (s_anom, s_rule, s_graph, risk), if there are enough rows and
    both labels; else unchanged."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n, attacks = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("label_attack"), F.lit(0))).first()
    if n < least or not 0 < attacks < n:
        return df
    d = VectorAssembler(inputCols=["s_anom", "s_rule", "s_graph", "risk"], outputCol="_x").transform(df)
    weighed = d.withColumn("_w", F.when(F.col("label_attack") == 1, n / (2 * attacks)).otherwise(n / (2 * (n - attacks))))
    fit = LogisticRegression(featuresCol="_x", labelCol="label_attack", weightCol="_w", regParam=1 / (c * n), standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(weighed.select("_x", F.col("label_attack").cast("double"), "_w"))
    out = fit.transform(d).withColumn("risk", vector_to_array("_p")[1])
    return out.withColumn("confidence", S.clip01(0.5 * F.col("confidence") + 0.5 * S.clip01(2 * F.abs(F.col("risk") - 0.5)))).drop("_x", "_p", "_raw", "_pred")


def unified_score(df: DataFrame, trees: int = 200, fusion: bool = True) -> DataFrame:
    """The unified score of a feature table: anomaly (forest, calibrated by the training ECDF), rules and graph, fused."""
    train = benign(time_split(df).filter("train").drop("train"), 500)
    model = cut(iforest_fit(train, UNIFIED_FEATURES, trees))
    d = ecdf(iforest_score(df, model, UNIFIED_FEATURES), iforest_score(train, model, UNIFIED_FEATURES), "raw_anom").withColumnRenamed("p", "s_anom")
    out = rules.fused(rules.unified_graph_score(rules.unified_rule_score(d)))
    if not fusion:
        return out
    out = supervised_fusion(cut(out))
    decision = F.when(F.col("risk") < 0.70, "allow").when(F.col("risk") < 0.81, "stepup").when(F.col("risk") < 0.88, "restrict").when((F.col("risk") >= 0.91) & (F.col("confidence") >= 0.55), "deny").otherwise("restrict")
    return out.withColumn("decision", decision)
