"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Tokens are runs of word characters, lower-cased.  The labels are of documents, so token labels are derived: over all training rows it is
counted in how many toxic and how many clean documents a word (or a word's prefix of 4, 5 or 6 characters) occurs; those much more
frequent in toxic documents are the field's features, and a token of a toxic document that has one is labelled toxic.  The field has two
states, a weight per feature, a bias and two transitions (into the toxic state); it is trained on a bounded sample by gradient steps on
the conditional likelihood, with forward-backward in log odds.  Its marginals give, per document, the largest marginal, the expected
number of toxic tokens and the number of tokens; a logistic curve, fitted on the same sample, makes them a score.  Spans are runs of
tokens with a marginal of at least one half.

Defined results: a null or empty text, or one without tokens, scores as the curve does with no toxic token; without training rows of
both labels every score is 0; rows with a null label are not trained on; repeated training rows are one text
of that weight; repeated rows give repeated result rows; texts of any length are scored whole; an empty table gives an empty result; other columns are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import sampled, sized, small, staged, without
from .language_id import fold
from .repeats import BITMAP_BITS, bitmap

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def features(token: str) -> tuple[str, ...]:
    """Feature names of a token: the word, and its prefixes (marked by a length, as a prefix is not a word)."""
    return (token, *(f"{n}:{token[:n]}" for n in (4, 5, 6) if len(token) > n))


@dataclass
class Field:
    """weights: feature -> weight of the toxic state; the other numbers are log odds against the clean state."""

    weights: dict[str, float]
    bias: float = -6.0
    stay: float = 1.0  # toxic after toxic
    enter: float = 0.0  # toxic after clean
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)  # intercept and the weights of _facts

    def emission(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(token))


def messages(emissions: np.ndarray, lengths: np.ndarray, bias: float, stay: float, enter: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, own) log odds of the toxic state at each place.  emissions: [sequences, longest], lengths: tokens of each
    sequence.

    A message is the log odds m of toxic against clean; past a transition it becomes log((e^m e^stay + e^enter) / (e^m + 1)): toxic
    after toxic weighs stay, toxic after clean enter, clean 0.  Backwards the transition's other side is summed out."""
    n, most = emissions.shape
    own = emissions + bias
    ahead, back = np.zeros((n, most)), np.zeros((n, most))
    for t in range(1, most):
        m = ahead[:, t - 1] + own[:, t - 1]
        ahead[:, t] = np.logaddexp(m + stay, enter) - np.logaddexp(m, 0)
    for t in range(most - 2, -1, -1):
        m = back[:, t + 1] + own[:, t + 1]
        step = np.logaddexp(m + stay, 0) - np.logaddexp(m + enter, 0)
        back[:, t] = np.where(t + 1 < lengths, step, 0)
    return ahead, back, own


def marginals(emissions: np.ndarray, lengths: np.ndarray, bias: float, stay: float, enter: float) -> np.ndarray:
    """Log odds of the toxic state at each place."""
    return sum(messages(emissions, lengths, bias, stay, enter))


def gradients(emissions: np.ndarray, lengths: np.ndarray, truth: np.ndarray, stands: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log likelihood of the labels `truth`, each sequence weighed by `stands`: by each emission, and by (bias, stay,
    enter).  Transitions are counted by pairwise marginals."""
    real = np.arange(emissions.shape[1])[None, :] < lengths[:, None]
    ahead, back, own = messages(emissions, lengths, *shared)
    error = (truth - 1 / (1 + np.exp(-np.clip(ahead + back + own, -50, 50)))) * real * stands[:, None]
    # The four states of two neighbours, as log weights against clean after clean.
    m, w = (ahead + own)[:, :-1], (back + own)[:, 1:]
    toxic_toxic, clean_toxic = m + w + shared[1], w + shared[2]
    total = np.logaddexp(np.logaddexp(toxic_toxic, clean_toxic), np.logaddexp(m, 0))
    both = real[:, 1:] * stands[:, None]
    stay = (truth[:, :-1] * truth[:, 1:] - np.exp(toxic_toxic - total)) * both
    enter = ((1 - truth[:, :-1]) * truth[:, 1:] - np.exp(clean_toxic - total)) * both
    return error, np.array([error.sum(), stay.sum(), enter.sum()])


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, lengths.max(initial=1))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def batched_marginals(rows: list[np.ndarray], field: Field, cells: int = 500_000) -> list[np.ndarray]:
    """Marginals (log odds) of each row of emissions: rows of like length go together, at most `cells` padded places at a time."""
    out: list[np.ndarray] = [np.empty(0)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(rows[order[end]]) <= cells:
            end += 1
        values, lengths = _padded([rows[i] for i in order[at:end]])
        odds = marginals(values, lengths, field.bias, field.stay, field.enter)
        for i, o in zip(order[at:end], odds):
            out[i] = o[: len(rows[i])]
        at = end
    return out


class _Marks(dict):
    """Whether a feature may be one of those in a bitmap (see repeats) of their hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __missing__(self, feature: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        at = xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 42) >> (64 - BITMAP_BITS)
        self[feature] = value = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return value


def _counts(rows: DataFrame, known: np.ndarray | None) -> DataFrame:
    """feature, n: in how many documents of rows a feature occurs; if a bitmap is given, only of those in it (and a few others)."""
    given = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        may = _Marks(given.value) if given is not None else None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

        for b in small(batches):
            for text in b.column("text").to_pylist():
                own = {f for token in set(tokens(text)) for f in features(token)}
                seen.update(own if may is None else [f for f in own if may[f]])
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_features: int = 4000, sample: int = 1000, odds: float = 1.5, least_docs: int = 2, least_weight: float = 0.1,
    most_windows: int = 20_000,
) -> Field | None:
    """The field, from rows with a text and a label of 0 or 1; None without both labels.

    Features are counted over all rows: those in at least least_docs toxic ones whose log odds, less two standard errors, reach `odds`
    are ranked by these, and the first max_features taken.  The field is fitted on a bounded sample: of each label the `sample` distinct
    texts with the smallest hashes, each weighed by its rows.  Their windows are cut on executors; of those with features at most
    most_windows, by their hashes, come to the driver, which holds no text.  Features whose fitted weight is below least_weight are left
    out.  Without any chosen feature all texts get one score."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.filter("label IN (0, 1)").groupBy("label").count().collect()}
    toxic_n, clean_n = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic_n or not clean_n:
        return None
    # Log odds less two standard errors, so a rare word must be rarer still among clean documents.
    score = lambda t, c: F.log((t + 0.5) / (toxic_n + 1)) - F.log((c + 0.5) / (clean_n + 1)) - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    t, c = F.col("n"), F.coalesce(F.col("c"), F.lit(0))
    toxic = staged(_counts(rows.filter("label = 1"), None).filter((t >= least_docs) & (score(t, F.lit(0)) >= odds)))
    # The bitmap only spares other features a shuffle, however many toxic ones there are: the join decides.
    bits = bitmap(toxic.select(F.xxhash64("feature").alias("key")))
    clean = _counts(rows.filter("label = 0"), bits).select("feature", F.col("n").alias("c"))
    ranked = toxic.join(clean, "feature", "left").select("feature", score(t, c).alias("score")).filter(F.col("score") >= odds)
    chosen = [r["feature"] for r in ranked.orderBy(F.desc("score"), "feature").limit(max_features).collect()]
    sample_ = staged(sampled(rows.filter("label IN (0, 1)"), "label", sample, 11))
    known = {r["by"]: (r["k"], r["texts"]) for r in sample_.groupBy("by").agg(F.sum("copies").alias("k"), F.count(F.lit(1)).alias("texts")).collect()}
    # A sampled text stands for as many rows as its label has for each row of the sampled ones; the mean over texts is 1.
    mean = (toxic_n + clean_n) / sum(n for _, n in known.values())
    share = {label: sizes[label] / k / mean for label, (k, _) in known.items()}
    parts = staged(_windows(sample_, chosen))
    plain: Counter[int] = Counter()
    for r in parts.filter("feats IS NULL").groupBy("by", "n").agg(F.sum("copies").alias("k")).collect():  # two labels, lengths up to a window's
        plain[r["n"]] += share[r["by"]] * r["k"]
    marked = parts.filter("feats IS NOT NULL")
    n_marked = marked.count()
    taken = marked if n_marked <= most_windows else marked.orderBy(F.xxhash64("h", "number", "by"), "h", "number").limit(most_windows)
    seqs = sorted(taken.collect(), key=lambda r: (r["by"], r["h"], r["number"]))
    field = _fit(seqs, np.array([share[r["by"]] * r["copies"] for r in seqs]) * max(1.0, n_marked / most_windows), plain, chosen, least_weight)
    if seqs:
        facts = sorted(_facts_of(sample_, field).collect())
        field.curve = _curve(np.array([r[2:5] for r in facts]), np.array([r["by"] for r in facts], float), np.array([share[r["by"]] * r["copies"] for r in facts]))
    return field


#: Tokens of a training window.
WINDOW = 160


def _windows(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """The windows of the sampled texts (by, h, text, copies) that hold features, with the places and numbers of these; and of each text
    how many windows without any it has of each length n, as copies (feats is null)."""
    given = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = given.value
        for b in small(batches, 20):
            for label, h, text, copies in zip(*[b.column(c).to_pylist() for c in ("by", "h", "text", "copies")]):
                rows, bare, size = [], Counter(), 0
                for k, part in enumerate(_parts(tokens(text))):
                    found = [(t, column[f]) for t, token in enumerate(part) for f in features(token) if f in column]
                    size += 1
                    if found:
                        rows.append((label, h, k, copies, len(part), *map(list, zip(*found))))
                    else:
                        bare[len(part)] += copies
                rows += [(label, h, -1, k, n, None, None) for n, k in bare.items()]
                if rows:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["by", "h", "number", "copies", "n", "places", "feats"])

    return sample.select("by", "h", "text", "copies").mapInArrow(run, "by int, h long, number int, copies long, n int, places array<int>, feats array<int>")


def _parts(own: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(own), WINDOW):
        yield own[at : at + WINDOW]


def _facts_of(sample: DataFrame, field: Field) -> DataFrame:
    """by, h, the three facts and copies of each sampled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 20):
            rows = [np.array([field.emission(t) for t in tokens(text)], float) for text in b.column("text").to_pylist()]
            facts = np.array([_facts(o) for o in batched_marginals(rows, field)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("by"), b.column("h"), *[pa.array(f) for f in facts.T], b.column("copies")], names=["by", "h", "x", "y", "z", "copies"])

    return sample.select("by", "h", "text", "copies").mapInArrow(run, "by int, h long, x double, y double, z double, copies long")


def _fit(seqs: list, weight: np.ndarray, plain: dict[int, float], chosen: list[str], least_weight: float, rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """seqs: training windows (by, n, places, feats) with features, weight: of each.  Windows without features, in which nothing tells one
    from another, count once for each length: plain has the sum of their weights."""
    if not seqs:
        return Field({})
    count = len(seqs)
    lengths = np.array([r["n"] for r in seqs] + sorted(plain))
    stands = np.concatenate([weight, [plain[n] for n in sorted(plain)]])
    seq = np.repeat(np.arange(count), [len(r["feats"]) for r in seqs])
    place, feat = (np.concatenate([np.array(r[c], np.int64) for r in seqs]) for c in ("places", "feats"))
    truth = np.zeros((len(lengths), lengths.max()))
    label = np.array([r["by"] for r in seqs])
    truth[seq, place] = label[seq] == 1
    weights, shared = np.zeros(len(chosen)), np.array([-3.0, 0.5, 0.0])  # bias, stay, enter
    second_w, second_s = np.full(len(chosen), 1e-8), np.full(3, 1e-8)
    for _ in range(rounds):
        emissions = np.zeros(truth.shape)
        np.add.at(emissions, (seq, place), weights[feat])
        error, grad_s = gradients(emissions, lengths, truth, stands, shared)
        grad_w = np.bincount(feat, error[seq, place], minlength=len(chosen)) / count - decay * weights
        grad_s = grad_s / count
        second_w = 0.9 * second_w + 0.1 * grad_w**2
        second_s = 0.9 * second_s + 0.1 * grad_s**2
        weights += rate * grad_w / np.sqrt(second_w + 1e-8)
        shared += 0.3 * rate * grad_s / np.sqrt(second_s + 1e-8)
    weights[np.abs(weights) < least_weight] = 0
    return Field({f: float(w) for f, w in zip(chosen, weights) if w}, *map(float, shared))


def _curve(facts: np.ndarray, label: np.ndarray, own: np.ndarray) -> tuple[float, ...]:
    """The logistic curve over the facts of texts with labels and weights, by Newton steps."""
    x, curve = np.column_stack((np.ones(len(facts)), facts)), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ curve))
        curve += np.linalg.solve((x * (own * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (own * (label - p)) - 0.05 * curve)
    return tuple(map(float, curve))


def _facts(odds: np.ndarray) -> tuple[float, float, float]:
    """(largest marginal as log odds within +-8, log of 1 + expected toxic tokens, log of 1 + tokens); the many tokens with a marginal
    below one in twenty are no part of the expectation, as their sum would be the text's length again."""
    if not len(odds):
        return -8.0, 0.0, 0.0
    likely = odds[odds > -3]
    return float(np.clip(odds.max(), -8, 8)), float(np.log1p((1 / (1 + np.exp(-np.minimum(likely, 50)))).sum())), float(np.log1p(len(odds)))


class _Plain:
    """Facts of a text of n tokens none of which has a feature (most are): both messages depend on the distance to an end alone."""

    def __init__(self, field: Field):
        self.field, self.ahead, self.back, self.known = field, [0.0], [0.0], {}

    def __call__(self, n: int) -> tuple[float, float, float]:
        f = self.field
        while len(self.ahead) < n:
            m, w = self.ahead[-1] + f.bias, self.back[-1] + f.bias
            self.ahead.append(float(np.logaddexp(m + f.stay, f.enter) - np.logaddexp(m, 0)))
            self.back.append(float(np.logaddexp(w + f.stay, 0) - np.logaddexp(w + f.enter, 0)))
        if n not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[n] = _facts(np.array(self.ahead[:n]) + np.array(self.back[:n][::-1]) + f.bias)
        return self.known[n]


class _Emissions(dict):
    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, token: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[token] = value = self.field.emission(token)
        return value


def score(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with _score and _spans (array of start and end offsets, in code points of the text, of toxic runs)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    docs = without(docs, "_score", "_spans")
    given = docs.sparkSession.sparkContext.broadcast(field)
    kind = StructType([*docs.schema.fields, *StructType.fromDDL("_score double, _spans array<struct<start:int,end:int>>").fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = given.value
        known, plain = (_Emissions(field), _Plain(field)) if field else ({}, None)
        for b in small(batches):
            texts = b.column(text_col).to_pylist()
            facts, spans = [(-8.0, 0.0, 0.0)] * len(texts), [[] for _ in texts]
            special: list[tuple[int, np.ndarray]] = []
            for i, text in enumerate(texts) if field else ():
                found = tokens(text)
                emissions = np.fromiter(map(known.__getitem__, found), float, len(found))
                if emissions.any():
                    special.append((i, emissions))
                else:
                    facts[i] = plain(len(found))
            for (i, _), odds in zip(special, batched_marginals([e for _, e in special], field)):
                facts[i] = _facts(odds)
                if odds.max() >= 0:
                    spans[i] = _spans(texts[i], odds)
            values = 1 / (1 + np.exp(-(np.array(facts).reshape(-1, 3) @ np.array(field.curve[1:]) + field.curve[0]))) if field else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64()), pa.array(spans, arrow.field("_spans").type)], names=arrow.names)

    return docs.mapInArrow(run, kind)


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    """Offsets are those of the text itself; lower-casing may change lengths, so tokens are found again in the text."""
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if len(places) != len(odds):  # a letter whose lower case is more than one word character or none
        places = [(m.start(), m.end()) for m in _TOKEN.finditer(text.lower())]
    out: list[dict] = []
    for k in np.flatnonzero(odds >= 0).tolist():
        if out and out[-1]["last"] == k - 1:
            out[-1] |= {"end": places[k][1], "last": k}
        else:
            out.append({"start": places[k][0], "end": places[k][1], "last": k})
    return [{"start": x["start"], "end": x["end"]} for x in out]


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, parts: int, held_out: int) -> Field | None:
    marks = labels.filter(F.col(label_col).isNotNull() & (fold(id_col, parts) != held_out)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    train = docs.select(id_col, text_col).join(sized(staged(marks)), F.col(id_col) == F.col("_id"))
    return learn(train.select(F.col(text_col).alias("text"), F.col("_label").alias("label")), "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 4, held_out: int = 2, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: learned from the labelled rows outside the held-out fold, scored for all."""
    field = learn_from(docs, labels, id_col, text_col, label_col, parts, held_out)
    found = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), field)
    return found.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= at).cast("int").alias("predicted"), F.col("_spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 4, held_out: int = 2, at: float = 0.3) -> DataFrame:
    """The rows of docs that score below `at`."""
    field = learn_from(docs, labels, id_col, text_col, label_col, parts, held_out)
    scored = score(docs, field, text_col)
    return scored.filter(F.col("_score") < at).drop("_score", "_spans")
