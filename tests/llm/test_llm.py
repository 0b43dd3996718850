"""The pipeline operations against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

pytest.importorskip("trustlake.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from trustlake.llm import bpe, exact_dedup, language_id, line_dedup, media, packing, simhash, substring_dedup, suffix_dedup, toxicity  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, kept boolean, _th string, key int"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def table(spark, rows, n=3):
    return spark.createDataFrame([(i, t, "en", True, "x", 1) for i, t in rows], SCHEMA).repartition(n)


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = ["".join(random.choice("abcdefgé") for _ in range(random.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(random.choice(words) for _ in range(n))
    shared, line = say(70), say(25)
    base = [say(random.randint(5, 200)) for _ in range(25)]
    near = shared.split()
    near[30] = "other"
    rows = [*enumerate(base)]
    rows += [(100, say(40) + "\n" + shared + "\n" + say(30)), (101, shared + " " + say(90)), (102, say(20) + " " + " ".join(near) + " " + say(9)), (103, base[3]), (104, base[3]), (105, base[3].replace(" ", "  "))]
    rows += [(110, line + "\n" + say(8)), (111, say(9) + "\n" + line[:-1]), (112, line[:5] + "Q" + line[6:] + "\n" + line), (113, line), (114, "short\nshort\n shor\n\n\t\n\t"), (115, "}\nshort\n}")]
    rows += [(120, None), (121, ""), (122, " \n\t"), (None, "a text without an id " + say(60)), (123, "x"), (123, "x"), (124, say(3000)), (125, "ab " * 400)]
    return rows


EMPTY = []


def test_exact(spark, texts):
    out = exact_dedup.exact_dedup(table(spark, texts), max_heavy=2, tracked=64).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(BLANK.sub("", t or ""), []).append((i, t or ""))
    assert len(out) == len(texts)
    for t, members in groups.items():
        got = [r for r in out if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        want = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        assert sum(r.kept for r in got) == 1 and {(r.keep_id, r.group_size) for r in got} == {(want, len(members))}
    assert exact_dedup.exact_dedup(table(spark, EMPTY)).count() == 0


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p:] == b[p:] or a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute_lines(rows):
    """(id, text) -> kept text, by the definition: equal lines of any length go, one edit counts from 10 code points on."""
    places = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: (r[0], r[1], xxhash_signed(r[2])))
    seen, out = [], {}
    for none, i, t in places:
        kept = []
        for line in t.split("\n"):
            s = line.strip(" ")
            if not BLANK.sub("", s) or not (s in seen or len(s) >= 10 and any(len(o) >= 10 and edit_at_most_one(s, o) for o in seen)):
                kept.append(line)
            if BLANK.sub("", s):
                seen.append(s)
        out[None if none else i, t] = "\n".join(kept)
    return out


def xxhash_signed(t):
    return int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))


def test_lines(spark, texts, monkeypatch):
    for block in (line_dedup.BLOCK, 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        out = line_dedup.line_dedup(table(spark, texts)).collect()
        want = brute_lines(texts)
        source = sorted((str(i), want[i, t or ""]) for i, t in texts)
        assert sorted((str(r.doc_id), r.text) for r in out) == source
    assert any(r._near for r in out) and any(r._exact for r in out)
    assert line_dedup.line_dedup(table(spark, EMPTY)).count() == 0


def brute_bytes(rows, width):
    ids = sorted({i for i, _ in rows if i is not None})
    text = {i: next(t or "" for j, t in rows if j == i).encode() for i in ids}
    seen, out = set(), {}
    for i in ids:
        d = text[i]
        gone = np.zeros(len(d), bool)
        own = [d[j : j + width] for j in range(len(d) - width + 1)]
        for j, s in enumerate(own):
            if s in seen:
                gone[j : j + width] = True
        seen.update(own)
        out[i] = (len(d), int(gone.sum()), bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


def test_suffixes(spark, texts):
    out = suffix_dedup.suffix_dedup(table(spark, texts), batch_bytes=2000).collect()
    want = brute_bytes(texts, 50)
    assert len(out) == len(texts)
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id], r.doc_id
    assert suffix_dedup.suffix_dedup(table(spark, EMPTY)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\x00", min_size=4, max_size=25), st.integers(0, 5)), min_size=1, max_size=10), st.integers(8, 60))
def test_merged_transforms(parts, shard):
    segments, owners = [s.encode() for s, _ in parts], np.array([o for _, o in parts])
    best = {}
    for s, o in zip(segments, owners.tolist()):
        for j in range(len(s) - 3):
            best[s[j : j + 4]] = min(best.get(s[j : j + 4], 99), o)
    got = suffix_dedup.smallest_owner(segments, owners, 4, shard)
    assert [g.tolist() for g in got] == [[best[s[j : j + 4]] for j in range(len(s) - 3)] for s in segments]


def test_bpe_and_packing(spark, texts):
    odd = [(200 + k, t) for k, t in enumerate(["don't STOP!!'s 'tis x|§y 12ab", "<|endoftext|> x", "café é İ ſ Σας H̱, ½", "a\x1cb\x85c"])]
    rows, lib = texts + odd, Tokenizer.from_file(PATH)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    out = bpe.bpe_round_trip(table(spark, rows), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(own, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.ids for r in bpe.bpe_encode(table(spark, rows), PATH).collect()} == ids
    pieces = packing.pack(table(spark, rows, 40), PATH, size=512, open_windows=4, with_ids=True).collect()
    sequences, docs = {}, {}
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4")
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(own) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append((p.start, own.tolist()))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 512 and (512 - at < 16 or at & (at - 1) == 0)
    for i, own in docs.items():
        copies = sum(j == i for j, _ in rows)
        assert sorted(x for _, part in own for x in part) == sorted([*ids[i], 2] * copies)
    assert packing.pack(table(spark, EMPTY), PATH).count() == 0 and bpe.bpe_round_trip(table(spark, EMPTY), PATH).count() == 0


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    out = simhash.simhash_components(table(spark, texts)).collect()
    fp = {i: brute_fingerprint(t) for i, t in texts}
    label = {i: i for i in fp}
    order = sorted(fp, key=lambda i: (i is None, i or 0))
    changed = True
    while changed:
        changed = False
        for i in order:
            best = min((label[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 2 and label[j] is not None), default=None)
            if best is not None and (label[i] is None or best < label[i]):
                label[i], changed = best, True
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in out) == sorted((str(i), fp[i], label[i]) for i, _ in texts)
    kept = simhash.simhash_dedup(table(spark, texts)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(label[i]) for i in fp if label[i] is not None} | ({"None"} if label[None] is None else set()))
    assert simhash.simhash_components(table(spark, EMPTY)).count() == 0


def test_large_shards_are_split_again(spark):
    """Links by a first tree of few leaves and trees within its leaves connect what all pairs connect."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    near = [base[i] ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64))) for i in rng.integers(0, 700, 400)]
    chain = [np.uint64((1 << k) - 1) for k in range(0, 60, 2)]
    points = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(chain, np.uint64)]))
    given = spark.createDataFrame([(int(v),) for v in points.view(np.int64)], "fp long").repartition(3)
    up = {int(v): int(v) for v in points}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, v in enumerate(points):
        for o in points[i + 1 :][np.bitwise_count(points[i + 1 :] ^ v) <= 2]:
            up[max(top(int(v)), top(int(o)))] = min(top(int(v)), top(int(o)))
    want = {}
    for v in points:
        want.setdefault(top(int(v)), set()).add(int(np.uint64(v).view(np.int64)))
    for shard, sample, bound in ((64, 128, 20), (64, 2000, 100_000)):
        edges = simhash.links(given, 2, shard, sample, bound)
        got = {}
        for r in simhash.components(edges).collect():
            got.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_simhash_keeps_unlike_rows_of_one_id(spark, texts):
    long = [t for i, t in texts if i is not None and i < 25 and len(t.split()) > 60][:5]
    rows = [(1, long[0]), (None, long[0]), (None, long[1]), (None, long[2]), (2, long[3]), (2, long[4]), (3, long[3])]
    kept = simhash.simhash_dedup(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in [rows[0], *rows[2:6]])


def test_vantage_trees_lose_no_link():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for c in centres] + [rng.integers(0, 2**63, 3000, dtype=np.uint64)]))
    tree = simhash.build_tree(points, 64)
    at, leaf, own = simhash.descend(tree, points, 2)
    assert sorted(at[own].tolist()) == list(range(len(points)))
    homes = dict(zip(at[own].tolist(), leaf[own].tolist()))
    where = set(zip(at.tolist(), leaf.tolist()))
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert all((j, homes[i]) in where for i, j in near.tolist())


def test_media(spark, texts):
    out = media.media_columns(table(spark, texts), keep_media=True).collect()
    said = {i: t for i, t in texts}
    for r in out:
        data = (said[r.doc_id] or "").encode()
        padded = data + bytes((-len(data)) % 64 or 64 * (not data))
        assert media.from_wav(bytes(r.media)) == padded and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_sha256) == (len(data), len(padded), zlib.crc32(padded[-64:]), hashlib.sha256(r.media).hexdigest())
        assert len(r.times) == len(r.hashes) and r.times == sorted(r.times)
    same = {r.feature for r in out if r.doc_id in (103, 104, 3)}
    assert len(same) == 1 and media.media_columns(table(spark, EMPTY)).count() == 0


def brute_landmarks(payload):
    """Frame by frame: the transform as sums of cosines and sines, the strongest bin of each band, peaks over both neighbours, pairs."""
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    n = max(1, -(-(len(x) - 256) // 128) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * 128 + 256 - len(x))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    power = [np.abs(turn @ (x[128 * i : 128 * i + 256] * window)) for i in range(n)]
    best = [[max(range(a, b), key=lambda k: (p[k], -k)) for a, b in ((1, 8), (8, 16), (16, 32), (32, 64), (64, 129))] for p in power]
    peaks = []
    for i in range(n):
        for band in range(5):
            own = power[i][best[i][band]]
            before = power[i - 1][best[i - 1][band]] if i else -1
            after = power[i + 1][best[i + 1][band]] if i + 1 < n else -1
            if own > before and own >= after and own > 1:
                peaks.append((i, best[i][band]))
    pairs = [(t, f << 14 | g << 6 | u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 4] if u - t <= 63]
    return sorted(pairs)


def test_media_features_by_brute_force(spark):
    random.seed(21)
    texts = [" ".join(random.choice(["wind", "größe", "night", "a", "of;", "0123"]) for _ in range(n)) for n in (3, 60, 400)]
    for r in media.media_columns(table(spark, list(enumerate(texts)))).collect():
        data = texts[r.doc_id].encode()
        assert list(zip(r.times, r.hashes)) == brute_landmarks(data + bytes(-len(data) % 64)) and r.feature.startswith(f"{len(r.times)}:")


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34!", "en", "s", 6), (None, "the and of", None, "s", 9)], docs.schema)
    both = docs.unionByName(extra)
    out = language_id.language_id(both).join(docs.select("doc_id", "lang", "n_chars"), "doc_id", "left").collect()
    assert {r.lang_pred for r in out if r.doc_id in (10**6, 10**6 + 1)} == {"und"} and len(out) == both.count()
    held = [r for r in out if r.held_out and r.lang and r.n_chars > 100]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in language_id.language_id(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    random.seed(4)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        t = [random.choice(words) for _ in range(random.randint(20, 80))]
        bad = i % 6 == 0
        for _ in range(4 if bad else 0):
            t.insert(random.randrange(len(t)), random.choice(["Zoxic", "zoxian", "wurstle"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "zoxic wurstle " * 9), (1002, "zoxic wurstle " * 9), (None, "abc")]
    label_table = spark.createDataFrame([*labels, (1, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(table(spark, rows), label_table).collect()
    assert len(out) == len(rows)
    truth, said = dict(labels), dict(rows)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(said[r.doc_id][s.start : s.end].lower().startswith(("zox", "wur")) for r in held if truth[r.doc_id] for s in r.spans)
    assert all(r.predicted == (1 if r.doc_id == 1002 else 0) for r in out if r.doc_id is None or r.doc_id >= 1000)
    assert {r.score for r in toxicity.toxicity(table(spark, rows[:5]), label_table.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(table(spark, EMPTY), label_table).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e, bias, stay, enter = rng.normal(size=6), -0.5, 0.8, -0.3
    weight = {}
    for path in range(2**6):
        y = [path >> i & 1 for i in range(6)]
        weight[path] = np.exp(sum((e[t] + bias) * y[t] for t in range(6)) + sum((stay if y[t - 1] else enter) * y[t] for t in range(1, 6)))
    got = toxicity.marginals(e[None, :], np.array([6]), bias, stay, enter)[0]
    for t in range(6):
        on = sum(w for p, w in weight.items() if p >> t & 1)
        assert abs(got[t] - np.log(on / (sum(weight.values()) - on))) < 1e-9


def test_passages(spark, texts):
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, texts)).collect()}
    said = {i: t or "" for i, t in texts}
    for i in (101, 102):
        assert 62 <= out[i]._removed <= 80 and len(out[i]._spans) == 1
    for i in (103, 104, 105):
        assert out[i]._removed == (len(said[i].split()) if len(said[i].split()) >= 50 else 0)
    clean = [i for i in said if i is None or i < 101 or i in (120, 121, 122, 123, 124)]
    assert all(out[i]._removed == 0 and out[i].text == said[i] for i in clean)
    assert substring_dedup.substring_dedup(table(spark, EMPTY)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=40), min_size=1, max_size=5), st.integers(2, 8))
def test_compact_windows(texts, least):
    values = [np.array(t, np.uint64) for t in texts]
    hashes, bounds = np.concatenate(values), np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    windows = list(zip(*[x.tolist() for x in substring_dedup.compact_windows(hashes, bounds, 1, least)]))
    order = (substring_dedup.mix(hashes ^ np.uint64(2 * 0xD6E8FEB86659FD93 % 2**64)) & ~substring_dedup._PLACE) | np.arange(len(hashes), dtype=np.uint64)
    for b, e in zip(bounds, bounds[1:]):  # every subsequence long enough lies in exactly one window, that of its minimum
        for x in range(b, e - least + 1):
            for y in range(x + least - 1, e):
                held = [w for w in windows if w[0] <= x <= w[1] <= y <= w[2]]
                assert len(held) == 1 and held[0][1] == x + int(order[x : y + 1].argmin())


def test_shingle_hashes_tell_words_apart():
    random.seed(1)
    texts = [" ".join(random.choice("abcdefghij") for _ in range(random.randint(0, 60))) for _ in range(40)] + ["", " a  b\nc d\te "]
    hashes, bounds = substring_dedup.shingles(texts, substring_dedup._Powers())
    said = []
    for t in texts:
        words = t.split()
        said += [tuple(words[i : i + 5]) for i in range(max(0, len(words) - 4))]
    assert len(said) == len(hashes) == bounds[-1]
    assert len(set(said)) == len(set(hashes.tolist())) == len(set(zip(said, hashes.tolist())))


def test_stretches_whatever_else_the_earlier_text_holds():
    n = np.arange
    copy = n(56)
    phrase = np.concatenate((n(1000, 1040), [27], n(1100, 1140), copy, n(1200, 1220)))  # its 28th shingle stands earlier, too
    assert substring_dedup.similar_stretches(np.concatenate((n(2000, 2030), copy, n(2100, 2130))), phrase, 46, 0.8) == [(30, 86)]
    moved = np.concatenate((n(28), [1010], n(29, 56)))  # one shingle of the copy is one of another passage
    assert substring_dedup.similar_stretches(moved, phrase, 46, 0.8) == [(0, 56)]
    for own in (np.concatenate(([9001], n(1, 46))), np.concatenate((n(45), [9001]))):  # 50 words, the first or last differs
        assert substring_dedup.similar_stretches(own, n(46), 46, 0.8) == [(0, 46)]
    assert substring_dedup.similar_stretches(np.concatenate((n(40), n(9000, 9006))), n(46), 46, 0.8) == []
    assert substring_dedup.similar_stretches(np.zeros(2000, int), np.zeros(2000, int), 46, 0.8) == [(0, 2000)]


def test_passages_with_unlike_earlier_holders(spark):
    rng = random.Random(5)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shared = say(60)
    held = range(56)
    rows = []  # each signature of the passage stands in unlike passages first: in a document without, one with several, and one with one region
    for at in held:
        phrase = shared[at : at + 5]
        rows += [say(60) + phrase + say(60) for _ in range(40)]
    other = [say(60) for _ in range(2)]
    rows.append(other[0] + [w for at in held for w in say(30) + shared[at : at + 5]] + say(60) + other[1])
    rows.append(other[0] + say(80) + [w for at in held for w in say(30) + shared[at : at + 5]] + say(30))
    first = len(rows)
    rows += [say(50) + other[1] + say(30) + shared + say(50), say(40) + shared + say(40), shared + say(90)]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, [(i, " ".join(t)) for i, t in enumerate(rows)])).collect()}
    assert all(60 <= out[i]._removed <= 66 for i in (first, first + 1, first + 2)), {i: out[i]._removed for i in out}
    assert all(out[i]._removed == 0 for i in range(first - 1))


def test_pipeline_drops_copies_of_paragraphs(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "a first paragraph of some words\n\n\ta second one, also of words\n"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, "\n\n", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in dict(pipeline.STAGES)["line_dedup"](spark, docs, sf_dir).collect()) == [1, 3]


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = pipeline.staged(stage(spark, kept, sf_dir))
        assert kept.columns == pipeline.COLUMNS, name
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
    pieces = pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    lib = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


@pytest.mark.parametrize("void", [False, True])
def test_crowded_keys_and_a_void_bitmap(spark, texts, monkeypatch, void):
    if void:
        monkeypatch.setattr(suffix_dedup, "fits_bitmap", lambda keys: False)
    want = brute_bytes(texts, 50)
    for r in suffix_dedup.suffix_dedup(table(spark, texts), batch_bytes=2000, most=1 if not void else 4096).collect():
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_suffix_tables_are_narrow_and_go_when_used_up(spark, texts, monkeypatch):
    from pathlib import Path

    real, made = suffix_dedup.staged, []

    def kept(df):
        made.append(real(df))
        return made[-1]

    monkeypatch.setattr(suffix_dedup, "staged", kept)
    suffix_dedup.suffix_dedup(table(spark, texts), batch_bytes=2000)
    there = [(t.columns, Path(t._staged_at.removeprefix("file:")).exists()) for t in made]
    assert (["doc_id", "th", "key", "s", "start", "n"], True) in there  # two hashes a segment
    assert [c for c, e in there if not e] == [["key", "s", "n", "owner", "last"], ["key", "s", "n", "owner", "last", "m"], ["key", "s", "owner", "piece", "last", "m"]]


def test_short_phrases_that_documents_share_make_no_segments(spark, monkeypatch):
    """A phrase of 30 bytes is led by equal grams in all documents, but no string of 50 bytes is shared."""
    rng, real, made = random.Random(7), suffix_dedup.staged, []
    say = lambda: "".join(rng.choice("abcdefghij ") for _ in range(80))
    monkeypatch.setattr(suffix_dedup, "staged", lambda df: made.append(real(df)) or made[-1])
    out = suffix_dedup.suffix_dedup(table(spark, [(i, say() + "a phrase of exactly thirty byt" + say()) for i in range(40)]), batch_bytes=2000)
    assert sum(r.n_removed for r in out.collect()) == 0
    assert [t.count() for t in made if t.columns == ["doc_id", "th", "key", "s", "start", "n"]] == [0]


def test_intersections_of_one_document_go_first(spark, monkeypatch):
    """Texts that share 25 words have windows of equal signatures; the intersections that no other text has are not kept for the rounds."""
    rng, real, made = random.Random(5), substring_dedup.staged, []
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, passage = say(25), say(60)
    rows = [(i, f"{say(90)} {common} {say(90)}") for i in range(30)] + [(100 + i, f"{say(70)} {passage} {say(70)}") for i in range(2)]
    monkeypatch.setattr(substring_dedup, "staged", lambda df: made.append(real(df)) or made[-1])
    out = {r.doc_id: r._removed for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert out[101] >= 55 and sum(out.values()) == out[101]
    columns = [t.columns for t in made]
    first = columns.index(["key", "doc_id", "rid", "at"])
    assert first < columns.index(["key", "lead"])  # before any round
    of_one = made[first].groupBy("key").agg(F.count_distinct("doc_id").alias("n")).filter("n = 1").count()
    assert of_one <= 1  # but for chance in the bitmap


def test_languages_whose_rows_repeat(spark):
    rng = random.Random(3)
    known = {letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(50)] for letters in ("äöüzß", "abcde", "xyzwv")}
    say = lambda letters: " ".join(rng.choice(known[letters]) for _ in range(60))
    one = say("äöüzß")
    rows = [(i, one, "de") for i in range(2000)] + [(2000 + i, say("abcde"), "en") for i in range(150)] + [(3000 + i, say("xyzwv"), "fr") for i in range(150)] + [(4000, "", "it"), (4001, None, "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert list(language_id.learn_dictionaries(docs)) == ["de", "en", "fr"]
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id < 4000").collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_toxic_rows_that_repeat(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    toxic = say(20) + " zoxic wurstle zoxic " + say(20)
    rows = [(i, toxic) for i in range(3000)] + [(3000 + i, say(40)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i < 3000)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.toxicity(table(spark, rows), labels).collect()
    assert all(r.predicted for r in out if r.doc_id < 3000) and sum(r.predicted for r in out if r.doc_id >= 3000) <= 6


def test_training_on_long_texts(spark):
    """What comes to the driver is bounded by windows, not by the texts: the fit on a part of the windows still finds the words."""
    rng = random.Random(8)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(120):
        body = say(4000)
        if i % 2:
            for _ in range(60):
                body[rng.randrange(len(body))] = "zoxic"
        rows.append((i, " ".join(body)))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    given = table(spark, rows).select("doc_id", "text").join(labels, "doc_id")
    whole, part = toxicity.learn(given), toxicity.learn(given, most_windows=200)
    assert set(whole.weights) == set(part.weights) and all(abs(whole.weights[f] - part.weights[f]) < 1.0 for f in whole.weights)
    out = toxicity.toxicity(table(spark, rows), labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    e, lengths, stands, shared = rng.normal(size=(3, 5)), np.array([5, 3, 4]), np.array([1.0, 2.0, 0.5]), np.array([-0.4, 0.7, -0.2])
    truth = (rng.random((3, 5)) < 0.5) * (np.arange(5)[None, :] < lengths[:, None])

    def likelihood(e, shared):
        total = 0.0
        for row, n, y, own in zip(e, lengths, truth, stands):
            weigh = lambda path: sum((row[t] + shared[0]) * path[t] for t in range(n)) + sum((shared[1] if path[t - 1] else shared[2]) * path[t] for t in range(1, n))  # noqa: B023, E731
            every = [[p >> t & 1 for t in range(n)] for p in range(2**n)]
            total += own * (weigh(y) - np.log(sum(np.exp(weigh(p)) for p in every)))
        return total

    error, by_shared = toxicity.gradients(e, lengths, truth.astype(float), stands, shared)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert abs((likelihood(e, shared + step) - likelihood(e, shared - step)) / 2e-5 - by_shared[k]) < 1e-6
    for i, t in ((0, 2), (1, 1), (2, 3)):
        step = np.zeros_like(e)
        step[i, t] = 1e-5
        assert abs((likelihood(e + step, shared) - likelihood(e - step, shared)) / 2e-5 - error[i, t]) < 1e-6


def test_passages_against_all_pairs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, held = [], []
    for i in range(160):
        body = say(rng.randint(60, 120))
        if held and rng.random() < 0.6:  # a passage of an earlier text, with some words changed
            source = rng.choice(held)
            at, n = rng.randint(0, len(source) - 60), rng.randint(40, 60)
            part = source[at : at + n]
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        held.append(body)
        rows.append((i, " ".join(body)))
    out = {r.doc_id: r._removed for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    sets = [[frozenset(tuple(w[k : k + 5]) for k in range(x, x + 46)) for x in range(len(w) - 49)] for w in held]
    same = set()
    for i in range(len(held)):
        for j in range(i):
            if any(len(a & b) >= 0.8 * len(a | b) for a in sets[i] for b in sets[j] if a & b):
                same.add(i)
    found = {i for i, n in out.items() if n}
    assert len(same) > 20 and len(found & same) >= 0.9 * len(same) and found <= same


@pytest.mark.parametrize("n_shared", [42, 44])
def test_pairs_of_a_common_phrase_grow_with_the_texts(spark, monkeypatch, n_shared):
    """Texts that share a phrase too short for a passage, and nothing else, are not all compared with each other."""
    rng, real, met = random.Random(9), substring_dedup.staged, []

    def counted(df):
        out = real(df)
        if df.columns == ["rid", "rep"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "staged", counted)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    pairs, shared = [], say(n_shared)
    for n in (40, 120):
        met.clear()
        out = substring_dedup.substring_dedup(table(spark, [(i, f"{say(60)} {shared} {say(60)}") for i in range(n)])).collect()
        assert not any(r._removed for r in out)
        pairs.append(sum(met))
    assert pairs[0] <= 8 * 40 and pairs[1] <= 8 * 120


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=0, max_size=40), st.integers(2, 9), st.booleans())
def test_extensible_runs_by_all_stretches(shared, least, loose):
    n, want = len(shared), set()
    for x in range(n):
        for y in range(x + least, n + 1):
            size, own = y - x, sum(shared[x:y])
            short = 0 if loose else 0.8 * (size + least) / 1.8
            trimmed = size == least or shared[x] and shared[y - 1]  # verified stretches begin and end with shingles of the other text
            if trimmed and own >= max(0.8 * size, short) - 1e-9:
                want.update(range(x, y - least + 1))
    assert set(np.flatnonzero(substring_dedup.extensible(np.array(shared, bool), least, 0.8, loose)).tolist()) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.sets(st.integers(0, 3)), st.integers(2, 6))
def test_extensible_sets_by_all_stretches(values, known, least):
    """No run is missed that lies in a stretch whose set has a share of 0.8 of shared shingles."""
    shared, n = [v in known for v in values], len(values)
    want = set()
    for x in range(n):
        for y in range(x + least, n + 1):
            own = {*values[x:y]}
            if len(own & known) >= 0.8 * len(own) and (y - x == least or shared[x] and shared[y - 1]):
                want.update(range(x, y - least + 1))
    assert want <= set(np.flatnonzero(substring_dedup.extensible_sets(np.array(values, int), np.array(shared, bool), least, 0.8)).tolist())


def test_words_inserted_in_the_middle_of_a_passage():
    n = np.arange
    own = np.concatenate((n(28), n(900, 910), n(32, 60)))  # six words more: 56 of 70 shingles are the same
    assert substring_dedup.similar_stretches(own, n(60), 46, 0.8) == [(0, 66)]


def test_pairs_of_repeated_words_grow_with_the_texts(spark, monkeypatch):
    """Texts of words that are said many times share the runs of common words, and are not all compared with each other."""
    rng, real, met = random.Random(3), substring_dedup.staged, []

    def counted(df):
        out = real(df)
        if df.columns == ["rid", "rep"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "staged", counted)
    rare = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pairs = []
    for n in (40, 120):
        met.clear()
        rows = [(i, " ".join(f"{w} " * rng.randint(20, 40) for w in (rare(), "the", rare(), "and", rare()))) for i in range(n)]
        out = substring_dedup.substring_dedup(table(spark, rows)).collect()
        assert not any(r._removed for r in out)
        pairs.append(sum(met))
    assert pairs[1] <= 8 * 120, pairs


def test_similar_sets_obey_the_bound():
    """Where shingles don't repeat, no two sets of `least` or more with a similarity of 0.8 share fewer than the bound says."""
    least = 46
    for a in range(least, 140):
        for b in range(least, 140):
            both = next((k for k in range(min(a, b) + 1) if k >= 0.8 * (a + b - k) - 1e-12), None)
            if both is not None:
                assert both >= max(0.8 * a, 0.8 * (a + least) / 1.8) - 1e-9


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    said = "a line of some words that is long enough\nand another one " + "to be said " * 30
    rows = [(1, None), (2, ""), (3, said), (3, said), (None, said + "x y z"), (None, None), (4, "ab " * 3000), (5, " \n\t")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, _th string")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == pipeline.COLUMNS and stage(spark, docs.limit(0), sf_dir).count() == 0, name
        kept = out.collect()
        assert 0 < len(kept) <= len(rows) and {r.doc_id for r in kept} <= {i for i, _ in rows}, name
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)
