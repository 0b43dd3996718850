"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked in the corpus.

A dictionary from cumulative byte end to token index for each tokenizer; the intersection of their keys, sorted, slices both id lists
into groups; inside a slice every pair of tokens whose byte ranges overlap is a link.

A text is taken as space+text and first cut where both tokenizers are certain to start a token: before a space between two characters
that are no white space.  The byte-level one's pattern takes at most one space along with what follows it, and no piece of the other one
has a space after another character (checked when it is loaded; without that, texts stay whole).  So each distinct fragment is encoded
and sliced once in a worker, and a text's alignment is that of its fragments one after another.  If a fragment's tokens don't give its
bytes back, the whole text is encoded instead, and has no tokens if the same holds there.

Corpus counts: texts are dealt with in chunks of bounded size, which are numbered.  A chunk's distinct id pairs, each with the number of
its documents that hold it, are summed over all chunks by a shuffle on the pair; the sums go back to the chunks that asked and meet the
documents' fragment counts there.  So what is shuffled are distinct pairs of chunks, never links; a pair that every document holds is
one row a chunk; no side is broadcast but the highest count of each id of the first vocabulary.

Defined results: a text that is null, empty or not given back by either tokenizer has no tokens, zeros and an empty digest; a row is a
document, so repeated rows count as several; texts of any length are taken whole; null ids are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import _byte_alphabet
from .common import give_back, small, staged

#: A chunk ends when it has so many characters or rows; a worker's known fragments are forgotten beyond so many.
CHUNK_CHARS, CHUNK_ROWS, KNOWN = 2_000_000, 20_000, 200_000
#: Two ids of a pair in one number: a * 2**32 + b.
SHIFT = 32
ROW = (
    "chunk long, part int, id_ {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<int>, "
    "links array<int>, bounds array<int>{more}"
)
#: A space between two characters that are no white space, by either library's reading.
_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")
#: Texts with no white space at either end.
_INNER = re.compile(r"(?s)[^\s\u180e\u200b\ufeff](?:.*[^\s\u180e\u200b\ufeff])?\Z")


#: Fixed value: where a byte-level pre-tokenizer splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments of characters below U+0180 with no white space at either end: all libraries read these alike.
_LATIN = re.compile("[!-~\u00a1-\u017f](?:[\t\n -~\u00a1-\u017f]*[!-~\u00a1-\u017f])?\\Z")


def _ranked(given: dict, token_bytes: dict[int, bytes]) -> Callable[[str], list[int]] | None:
    """The vocabulary of a byte-level BPE file as ranks, if the file's merges come in the order of its ids: the same ids, sooner."""
    model, pre, added = given["model"], given["pre_tokenizer"], {t["id"] for t in given.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"].get(a + b) for a, b in pairs]
    plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and given["normalizer"] is None
    if not plain or merged != list(range(256, 256 + len(merged))):
        return None
    import tiktoken

    ranks = {b: i for i, b in token_bytes.items() if i not in added}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligner:
    """Groups and links of texts under two tokenizers.  Fragments that were met are kept by number: their groups as text, their sizes
    (tokens of either kind, groups, links) and their links."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        of = _byte_alphabet()
        with open(path_a) as f:
            given = json.load(f)
        bytes_a = {i: bytes(of[c] for c in t) for t, i in given["model"]["vocab"].items()}
        self.ranks = _ranked(given, bytes_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)}
        self.cuts = not any(re.search("[^\u2581]\u2581", p) for p in pieces)
        self.bytes, self.lengths, self.inner, self.last = [], [], [], []
        for known, end in ((bytes_a, "|"), (bytes_b, ";")):
            n = max(known) + 1
            self.bytes.append(np.array([known.get(i, b"") for i in range(n)] + [None], object)[:-1])
            self.lengths.append(np.array([len(known.get(i, b"")) for i in range(n)], np.int64))
            self.inner.append(np.array([f"{i}," for i in range(n)], object))
            self.last.append(np.array([f"{i}{end}" for i in range(n)], object))
        self.forget()

    def forget(self) -> None:
        """Drops all fragments; numbers given before are void."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.links, self.n_links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), 0

    def free(self) -> None:
        self.forget()
        give_back()

    def numbers(self, texts: list[str | None]) -> Iterator[list[int]]:
        """For each text the numbers of its fragments; none if it has no tokens."""
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        for at in range(0, len(new), 8192):
            self.known.update(zip(new[at : at + 8192], self._learn(new[at : at + 8192])))
        find = self.known.__getitem__
        for text, fragments in zip(texts, cut):
            found = list(map(find, fragments))
            if found and min(found) < 0:  # bytes differ in a fragment: the whole text decides
                found = self._learn([text]) if len(found) > 1 else [-1]
                found = found if found[0] >= 0 else []
            yield found

    def _learn(self, fragments: list[str]) -> list[int]:
        """The numbers of new fragments, -1 where one does not give its bytes back.  Each stands for itself with a space before it; those
        without white space at their ends are encoded in one text, as they are certain cuts of it too."""
        out, left = [-1] * len(fragments), set(range(len(fragments)))
        for kind, encode in ((_LATIN, self.ranks), (_INNER, self._encode)) if self.cuts else ():
            some = [i for i in sorted(left) if kind.match(fragments[i])] if encode else []
            if self._encoded([fragments[i] for i in some], some, out, encode):
                left.difference_update(some)
        for i in sorted(left):
            self._encoded([fragments[i]], [i], out, self._encode)
        return out

    def _encode(self, text: str) -> list[int]:
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encoded(self, fragments: list[str], places: list[int], out: list[int], encode: Callable[[str], list[int]] | None) -> bool:
        """Numbers the fragments of one text, if both tokenizers give it back and have ends where the fragments end."""
        if not fragments:
            return False
        text, first = " ".join(fragments), len(self.groups)
        data = (" " + text).encode()
        ends = np.cumsum([len(f.encode()) + 1 for f in fragments])
        flat = [np.array(encode(" " + text), np.int64), np.array(self.b.encode(text), np.int64)]
        upto = [np.cumsum(length[ids]) for length, ids in zip(self.lengths, flat)]
        if any(not len(u) or u[-1] != len(data) for u in upto) or any(b"".join(known[ids].tolist()) != data for known, ids in zip(self.bytes, flat)):
            return False
        tokens = [np.searchsorted(u, ends) + 1 for u in upto]
        if any((u[t - 1] != ends).any() for u, t in zip(upto, tokens)):
            return False
        self._slice(flat, upto, [np.diff(t, prepend=0) for t in tokens], ends)
        for n, i in enumerate(places, first):
            out[i] = n
        return True

    def _slice(self, flat: list[np.ndarray], upto: list[np.ndarray], counts: list[np.ndarray], ends: np.ndarray) -> None:
        """Takes the ids of both kinds, the bytes up to each one's end, how many each fragment has, and the fragments' ends: the tokens
        are sliced at the ends that both kinds have."""
        at = [dict(zip(u.tolist(), range(1, len(u) + 1))) for u in upto]
        common = sorted(at[0].keys() & at[1].keys())
        to = [np.fromiter(map(d.__getitem__, common), np.int64, len(common)) for d in at]
        # Of each slice the tokens of the first kind, then those of the second, with the mark that follows each.
        since = [np.concatenate([[0], t[:-1]]) for t in to]
        pieces = np.empty(len(flat[0]) + len(flat[1]), object)
        for side, f in enumerate(flat):
            own = np.arange(len(f))
            of_slice = np.searchsorted(to[side], own, "right")
            marked = self.inner[side][f]
            marked[to[side] - 1] = self.last[side][f[to[side] - 1]]
            pieces[own + (since[1] if side == 0 else to[0])[of_slice]] = marked
        pieces, bounds = pieces.tolist(), [0, *np.cumsum(counts[0] + counts[1]).tolist()]
        self.groups += ["".join(pieces[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]
        # Two ranges overlap in one stretch between neighbouring ends of either kind, and each such stretch lies in one slice.
        both = np.union1d(*upto)
        links = flat[0][np.searchsorted(upto[0], both)] << SHIFT | flat[1][np.searchsorted(upto[1], both)]
        within = lambda places: np.diff(np.searchsorted(places, ends, "right"), prepend=0)
        self.sizes = np.concatenate([self.sizes, np.stack([*counts, within(np.array(common)), within(both)], axis=1)])
        if self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(max(len(links), len(self.links)), np.int64)])
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Chunk:
    """The texts of a chunk, by the numbers of their fragments in an aligner, which has to keep them until the chunk ends."""

    def __init__(self) -> None:
        self.ids, self.digests, self.groups, self.parts, self.chars = [], [], [], [], 0

    def add(self, doc_id, text: str | None, numbers: list[int], aligner: Aligner, keep: bool) -> None:
        groups = ";".join(map(aligner.groups.__getitem__, numbers))
        self.ids.append(doc_id)
        self.digests.append(hashlib.sha256(groups.encode()).hexdigest() if numbers else "")
        self.groups.append(groups if keep else None)
        self.parts.append(np.array(numbers, np.int64))
        self.chars += len(text or "")

    def full(self) -> bool:
        return self.chars >= CHUNK_CHARS or len(self.ids) >= CHUNK_ROWS

    def batches(self, chunk: int, aligner: Aligner, id_type: pa.DataType, keep: bool) -> Iterator[pa.RecordBatch]:
        """A row of the chunk (part 0: keys are its pairs, counts their documents, links and bounds the pairs of each fragment), and one
        of each document (part 1: links are its fragments, counts how often each occurs)."""
        n_docs = len(self.ids)
        fragments, inverse = np.unique(np.concatenate(self.parts), return_inverse=True)
        sizes, starts = aligner.sizes[fragments], np.concatenate([[0], np.cumsum(aligner.sizes[:, 3])])[fragments]
        n = sizes[:, 3]
        bounds = np.concatenate([[0], np.cumsum(n)])
        keys, links = np.unique(aligner.links[_spread(starts, n)], return_inverse=True)

        width = max(1, len(fragments))
        both, times = np.unique(np.repeat(np.arange(n_docs), [len(p) for p in self.parts]) * width + inverse, return_counts=True)
        doc, fragment = both // width, both % width
        totals = np.stack([_sums(doc, times * sizes[fragment, i], n_docs) for i in range(4)])
        at = np.searchsorted(doc, np.arange(n_docs + 1))

        m = n[fragment]
        held = np.unique(np.repeat(doc, m) * max(1, len(keys)) + links[_spread(bounds[fragment], m)]) % max(1, len(keys))
        docs_of = np.bincount(held, minlength=len(keys))

        none = lambda kind, m: pa.nulls(m, kind)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        whole = lambda values, kind: pa.array([values], kind)
        first = [pa.array([chunk]), pa.array([0], pa.int32()), none(id_type, 1), *[none(pa.int64(), 1)] * 4, none(pa.string(), 1), whole(keys, longs), whole(docs_of, ints), whole(links, ints), whole(bounds, ints)]
        cut = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
        ids = pa.array(self.ids, id_type)
        rest = [pa.array([chunk] * n_docs, pa.int64()), pa.array([1] * n_docs, pa.int32()), ids, *[pa.array(t) for t in totals], pa.array(self.digests, pa.string()), none(longs, n_docs), cut(times), cut(fragment), none(ints, n_docs)]
        names = ["chunk", "part", "id_", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts", "links", "bounds"]
        if keep:
            first, rest, names = [*first, none(pa.string(), 1)], [*rest, pa.array(self.groups, pa.string())], [*names, "groups"]
        yield pa.RecordBatch.from_arrays(first, names=names)
        yield pa.RecordBatch.from_arrays(rest, names=names)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), then those from starts[1], and so on."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _sums(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values at each of n places (sorted), in whole numbers."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[np.searchsorted(where, np.arange(n), "right")] - upto[np.searchsorted(where, np.arange(n), "left")]


def align_corpus(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    path_a: a byte-level BPE file of the tokenizers library; path_b: a sentencepiece model.  A pair's count is the number of rows that
    hold it linked; n_best: links whose count is the highest of their first id; count_sum: the sum of the links' counts.  With
    keep_groups also groups, the alignment itself as text (a1,a2|b1;a3|b2,b3), which `typed_groups` turns into arrays."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk, number, kind = aligner(path_a, path_b), Chunk(), TaskContext.get().partitionId() << 32, None
        for b in small(batches, 200):
            kind, texts = b.schema.field("doc_id").type, b.column("text").to_pylist()
            if chunk.ids and (chunk.full() or len(known.known) > KNOWN):
                yield from chunk.batches(number, known, kind, keep_groups)
                chunk, number = Chunk(), number + 1
            if len(known.known) > KNOWN:
                known.forget()
            for doc_id, text, numbers in zip(b.column("doc_id").to_pylist(), texts, known.numbers(texts)):
                chunk.add(doc_id, text, numbers, known, keep_groups)
        if chunk.ids:
            yield from chunk.batches(number, known, kind, keep_groups)
        known.free()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = staged(rows.mapInArrow(run, ROW.format(id=id_type, more=", groups string" if keep_groups else "")))

    asked = made.filter("part = 0").select("chunk", F.explode(F.arrays_zip("keys", "counts")).alias("k")).select("chunk", F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    told = staged(asked.select("chunk", "key", F.sum("n").over(Window.partitionBy("key")).alias("n"), F.shiftright("key", SHIFT).alias("a")))
    top = F.broadcast(told.groupBy("a").agg(F.max("n").alias("top")))  # a row an id of the first vocabulary
    answers = told.join(top, "a").select("chunk", "key", "n", (F.col("n") == F.col("top")).alias("best"))

    def answer(chunk: pa.Table, found: pa.Table) -> pa.Table:
        part = chunk.column("part").to_numpy()
        whole, own = chunk.filter(pa.array(part == 0)), chunk.filter(pa.array(part == 1))
        order = np.argsort(found.column("key").to_numpy())
        values = np.stack([found.column("best").to_numpy(zero_copy_only=False).astype(np.int64), found.column("n").to_numpy()])[:, order]
        links, bounds = (whole.column(c).combine_chunks().flatten().to_numpy() for c in ("links", "bounds"))
        of_fragment = np.diff(np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, links], axis=1)], axis=1)[:, bounds], axis=1)
        lists = own.column("links").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        times, fragment = own.column("counts").combine_chunks().flatten().to_numpy(), lists.flatten().to_numpy()
        n_best, count_sum = (_sums(np.repeat(np.arange(len(own)), n), times.astype(np.int64) * v[fragment], len(own)) for v in of_fragment)
        columns = {"doc_id": own.column("id_")} | {c: own.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.table(columns | {c: own.column(c) for c in ["groups_sha256", *["groups"] * keep_groups]})

    kind = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string{', groups string' * keep_groups}"
    return made.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, kind)


def typed_groups(groups: Column) -> Column:
    """The alignment as an array of (a, b), each an array of ids."""
    ids = lambda text: F.transform(F.split(text, ","), lambda x: x.cast("int"))
    side = lambda g, i: ids(F.element_at(F.split(g, r"\|"), i))
    return F.transform(F.filter(F.split(groups, ";"), lambda g: g != ""), lambda g: F.struct(side(g, 1).alias("a"), side(g, 2).alias("b")))
