"""Fill-in-middle, chat formatting and token alignment against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("trustlake.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from trustlake.llm import alignment, chat, common, fim, queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n int, form string, output string, chunk long, part int, keys string, links int, id_ string, h1 string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 7, "x", "y", 1, 2, "k", 3, "i", "h") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    say = lambda n: " ".join(random.choice(["der", "naïve", "tokens,", "größe", "x=1;", "it's", "中文", "🙂", "<|endoftext|>", "</s>", "\t", "a b"]) for _ in range(n))
    rows = [(i, say(random.randint(1, 60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "  two  spaces "), (53, "has <P> mark"), (54, "\u2581 piece"), (55, "ﬁ\x00 b"), (56, say(4000)), (57, rows[3][1]), (57, rows[3][1]), (None, "no id"), (58, "x"), (59, "\n"), (60, " ")]
    return rows


def brute_fim(i, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark, texts):
    rows = texts + [(i, f"text {i} <S <M P>< {i}") for i in range(100, 160)]
    out = fim.fim_transform(table(spark, rows)).withColumn("back", fim.fim_restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in out))) == sorted(str(brute_fim(*r)) for r in rows)
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fim_transform(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.integers(1, 9))
def test_ends_whatever_the_repetitions_of_a_match(text, repeats):
    assert fim.Cutter(".", repeats).ends(text) == list(range(1, len(text) + 1))


def test_other_units():
    assert fim.Cutter(r"\s*\S+|\s+").ends("ab  c d ") == [2, 5, 7, 8]
    with pytest.raises(ValueError):
        fim.Cutter("a").ends("ab")


def test_chat(spark):
    random.seed(6)
    odd = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST] <s>", "", "<", "[INST", " [/INST", "plain\ntext", None, " [/INST][INST] ", "é🙂"]
    rows = [(c, t, random.choice(["user", "assistant", "assistant", "system", None, "[INST] <s>"]), random.choice(odd)) for c in range(60) for t in random.sample(range(9), random.randint(1, 9))]
    rows += [(70, 1, "user", "a"), (70, 1, "user", "a"), (70, None, "assistant", "b"), (None, 0, "assistant", "c"), (None, 1, "user", "d")]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, segments string").repartition(3)
    out = chat.chat_format(d).withColumns({"read": chat.chat_read(F.col("formatted")), "learned": chat.learned_texts(F.col("segments"))}).collect()
    of = {}
    for c, t, r, x in rows:
        of.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(of)
    for r in out:
        turns = [(role, text) for *_, role, text in sorted(of[r.conv_id], key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))]
        assert [tuple(t) for t in r.read] == turns
        assert list(r.learned) == [x for role, x in turns if role == "assistant"]
        assert "".join(s.text for s in r.segments) == r.formatted and r.n_blocks == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        assert sum(s.text.count(c) for s in r.segments if s.label for c in ("<s>", "</s>", "[INST]", "[/INST]")) == 0
    assert chat.chat_format(d.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    d = spark.range(4000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('</s>', id) AS text")
    r = chat.chat_format(d).select(chat.chat_read(F.col("formatted")).alias("t"), chat.learned_texts(F.col("segments")).alias("l")).first()
    assert [t.text for t in r.t] == [f"</s>{i}" for i in range(4000)] and len(r.l) == 2666


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    of = {c: b for c, b in alignment._byte_alphabet().items()}
    return a, {i: bytes(of[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_tokens(libraries, text):
    """(ids, byte ranges) of both tokenizers, or nothing."""
    a, bytes_a, b = libraries
    if not text:
        return None
    ids_a, ids_b, data = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    parts_a = [bytes_a[i] for i in ids_a]
    if b"".join(parts_a) != data or b"".join(parts_b) != data:
        return None
    out = []
    for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
        at, ranges = 0, []
        for i, p in zip(ids, parts):
            ranges.append((i, at, at + len(p)))
            at += len(p)
        out.append(ranges)
    return out


def brute_groups(ta, tb):
    text, at = [], 0
    for end in sorted({e for *_, e in ta} & {e for *_, e in tb}):
        side = lambda t: ",".join(str(i) for i, s, e in t if s >= at and e <= end)
        text.append(f"{side(ta)}|{side(tb)}")
        at = end
    return text


def brute_links(ta, tb):
    return [(i, j) for i, s, e in ta for j, u, v in tb if s < v and u < e]


def test_alignment(spark, texts, libraries, monkeypatch):
    rows = [r for r in texts if r[0] != 56]
    held = [(i, brute_tokens(libraries, t)) for i, t in rows]
    links = [brute_links(*t) if t else [] for _, t in held]
    counts = Counter(p for own in links for p in set(own))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    want = []
    for (i, t), own in zip(held, links):
        groups = brute_groups(*t) if t else []
        n = (len(t[0]), len(t[1])) if t else (0, 0)
        want.append((i, *n, len(groups), len(own), sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), sha(";".join(groups)) if t else ""))
    assert sum(t is None for _, t in held) >= 3 and any(r[5] < r[4] for r in want)
    for rows_of_chunk in (alignment.CHUNK_ROWS, 3):
        monkeypatch.setattr(alignment, "CHUNK_ROWS", rows_of_chunk)
        monkeypatch.setattr(alignment, "KNOWN", 40 if rows_of_chunk == 3 else alignment.KNOWN)
        monkeypatch.setattr(alignment, "small", lambda batches, rows: common.small(batches, min(rows, rows_of_chunk)))
        out = alignment.align_corpus(table(spark, rows), A, B, keep_groups=True).withColumn("typed", alignment.typed_groups(F.col("groups"))).collect()
        assert sorted(map(str, (tuple(r)[:8] for r in out))) == sorted(map(str, want))
    assert all(";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.typed) == r.groups for r in out)
    assert alignment.align_corpus(table(spark, []), A, B).count() == 0


ODD = st.text(alphabet=st.sampled_from(list("ab  \t\n'’.,1é中🙂  ​᠎\x1c\x85▁ﬁ\x00<>|s/")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=3))
def test_fragments_give_the_libraries_tokens(libraries, texts):
    known = alignment.aligner(A, B)
    known.forget()
    for text, numbers in zip(texts, list(known.numbers(texts))):
        whole = brute_tokens(libraries, text)
        assert bool(numbers) == (whole is not None)
        if whole:
            bounds = [0, *known.sizes[:, 3].cumsum()]
            links = [int(x) for n in numbers for x in known.links[bounds[n] : bounds[n + 1]]]
            groups = brute_groups(*whole)
            assert ";".join(known.groups[n] for n in numbers) == ";".join(groups)
            assert sorted(links) == sorted(a << alignment.SHIFT | b for a, b in brute_links(*whole))
            assert known.sizes[numbers].sum(axis=0).tolist() == [len(whole[0]), len(whole[1]), len(groups), len(links)]


def test_long_text(spark, texts, libraries):
    text = next(t for i, t in texts if i == 56) * 40
    out = alignment.align_corpus(table(spark, [(1, text)]), A, B).first()
    ta, tb = brute_tokens(libraries, text)
    n = len({e for *_, e in ta} & {e for *_, e in tb})
    assert (out.n_a, out.n_b, out.n_groups, out.n_links) == (len(ta), len(tb), n, len(ta) + len(tb) - n)


def test_queries_read_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert [queries.QUERIES[q](spark, sf_dir).count() for q in ("op11_fim", "op12_chat", "op13_alignment")] == [n, convs + 1, n]
