"""BPE encoding and decoding with forced boundaries.

A merge can only ever join two bytes that stand side by side inside some vocabulary token, so a byte pair that no token holds can
never be merged over.  Where the tokenizer also starts a new word between the two (the pre-tokenizer is asked about each such pair of
ASCII characters once, when the table is built), the place is a certain cut: the fragments on both sides are encoded independently and
their ids concatenated.  Every text is cut at all certain places; the library encodes each distinct fragment once, and a bounded cache
holds the results.  A text in which an added token (`<|endoftext|>`) occurs is encoded whole.

Decoding: with no decoder in the tokenizer file, the library joins token strings with a space, so decoded fragments are joined likewise.

Defined results: a null text is empty; an empty text, or one of blanks only, has no ids and decodes to an empty string; texts of any
length are cut into fragments, a fragment without cuts is encoded whole; repeated rows give repeated result rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import give_back, small


def _byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable Latin-1 stands for itself, other bytes follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Letters of the Latin blocks below U+0180, but for the dotted capital I, whose lower case is two characters.
_LATIN = re.compile("[a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")
_AS_BYTES = {ord(chr(c)): "".join({b: a for a, b in _byte_alphabet().items()}[x] for x in chr(c).encode()) for c in range(0x80, 0x180)}


def token_pairs(vocabulary: dict[str, int], suffix: str | None) -> set[tuple[int, int]]:
    """The byte pairs that stand side by side inside some token."""
    of = _byte_alphabet()
    found = set()
    for token in vocabulary:
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        values = [of.get(c, -1) for c in body]
        found.update(zip(values, values[1:]))
    return found


class Fragments:
    """Cuts texts at certain places and encodes the fragments."""

    def __init__(self, path: str, cached: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path) as f:
            given = json.load(f)
        model = given["model"]
        self.added = [t["content"] for t in given.get("added_tokens", [])]
        self.spaced = given.get("decoder") is None
        self.cut = self._cuts(token_pairs(model["vocab"], model.get("end_of_word_suffix")))
        self.pattern = re.compile(self._pattern())
        # The short way for Latin letters holds for word-level BPE over bytes that lower-cases and splits at what is no letter.
        self.lowers = self.tokenizer.pre_tokenizer is not None and self._words_alone()
        self.cached, self.known = cached, {}

    def _words_alone(self) -> bool:
        """Whether every Latin letter, alone or between others, is encoded as the model encodes its lower case, as one word."""
        letters = [chr(c) for c in range(65, 0x180) if _LATIN.fullmatch(chr(c))]
        probes = [f"{c}" for c in letters] + [f"Ab{c}cD" for c in letters]
        encoded = self.tokenizer.encode_batch(probes, add_special_tokens=False)
        return all(e.ids == [t.id for t in self.tokenizer.model.tokenize(p.lower().translate(_AS_BYTES))] for p, e in zip(probes, encoded))

    def _cuts(self, inside: set[tuple[int, int]]) -> set[tuple[str, str]]:
        """Pairs of ASCII characters between which every text can be cut."""
        ascii_ = [chr(c) for c in range(9, 127) if chr(c).isprintable() or chr(c).isspace()]
        pre = self.tokenizer.pre_tokenizer

        def parts(text: str) -> bool:
            return pre is not None and any(begin == 1 for _, (begin, _) in pre.pre_tokenize_str(text)) or not text[1].strip() or not text[0].strip()

        def lowered(c: str) -> int:
            return ord(c.lower())

        return {(a, b) for a in ascii_ for b in ascii_ if (lowered(a), lowered(b)) not in inside and (ord(a), ord(b)) not in inside and parts(a.lower() + b.lower())}

    def _pattern(self) -> str:
        """A pattern whose matches are the fragments, blanks between them dropped where the tokenizer drops blanks: letters up to a
        certain cut, marks up to a blank, and whatever else stands between two blanks."""
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        blanks = " \t\n\x0b\x0c\r"
        marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        # A mark is open if it can be kept together with a letter beside it (an apostrophe, say).
        shut = [m for m in marks if all((m, x) in self.cut and (x, m) in self.cut for x in letters)]
        if not all((b, x) in self.cut and (x, b) in self.cut for b in blanks for x in [*letters, *marks, *"0123456789"]):
            return r"(?s).+"
        shut = "".join(map(re.escape, shut)) or "(?!)"
        return rf"[^\W\d_]++(?=[{blanks}{shut}]|$)|[{shut}]+(?=[{blanks}]|$)|[^{blanks}]+"

    def pieces(self, text: str) -> list[str]:
        if any(t in text for t in self.added):
            return [text]
        # Lower case first where that cannot matter (the normaliser lower-cases after composing): fewer distinct fragments.
        return self.pattern.findall(text.lower() if self.lowers and not _OTHER.search(text) else text)

    def free(self) -> None:
        """Forgets the fragments of a task that ends, as its worker may stay for other work."""
        self.known.clear()
        give_back()

    def encode(self, texts: list[str], value: Callable[[list[int], Callable[[], list[str]]], object]) -> Iterator[list]:
        """For each text, value(ids, function that gives the tokens) of each of its fragments; value must be the same at each call of
        one object."""
        cut = [self.pieces(t) for t in texts]
        known = self.known
        if len(known) > self.cached:
            known.clear()
        new = {p for ps in cut for p in ps if p not in known}
        if self.lowers:
            # A run of Latin letters is one word for the pre-tokenizer, so the model can be asked without it.
            model, words = self.tokenizer.model, [p for p in new if _LATIN.fullmatch(p)]
            for p in words:
                found = model.tokenize(p.lower().translate(_AS_BYTES))
                known[p] = value([t.id for t in found], lambda found=found: [t.value for t in found])
            new.difference_update(words)
        rest = list(new)
        for at in range(0, len(rest), 4096):
            for p, e in zip(rest[at : at + 4096], self.tokenizer.encode_batch(rest[at : at + 4096], add_special_tokens=False)):
                known[p] = value(e.ids, lambda e=e: e.tokens)
        for ps in cut:
            yield [known[p] for p in ps]


@lru_cache(maxsize=4)
def fragments(path: str, use: str) -> Fragments:
    """One object for each use, as a cache holds one kind of value."""
    return Fragments(path)


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = fragments(path, "ids")
        for b in small(batches):
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                ids = [[x for part in parts for x in part] for parts in cutter.encode(texts[i:j], lambda ids, _: ids)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        cutter.free()

    return _rows(docs, id_col, text_col).mapInArrow(run, _kind(docs, id_col, "ids array<int>"))


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids, by the library's decode(ids, skip_special_tokens=False); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        for b in small(batches):
            text = [None if ids is None else tokenizer.decode(ids, skip_special_tokens=False) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, _kind(encoded, id_col, "text string"))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256 of each row."""

    def value(ids: list[int], tokens: Callable[[], list[str]]) -> tuple[int, bytes, bytes] | None:
        return (len(ids), " ".join(map(str, ids)).encode(), " ".join(tokens()).encode()) if ids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = fragments(path, "round trip")
        if not cutter.spaced:
            raise ValueError("only tokenizers without a decoder are joined by fragments; use bpe_encode and bpe_decode")
        for b in small(batches):
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                counts, ids, decoded = [], [], []
                for parts in cutter.encode(texts[i:j], value):
                    parts = [p for p in parts if p]
                    counts.append(sum([p[0] for p in parts]))
                    ids.append(hashlib.sha256(b" ".join([p[1] for p in parts])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([p[2] for p in parts])).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        cutter.free()

    return _rows(docs, id_col, text_col).mapInArrow(run, _kind(docs, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _kind(df: DataFrame, id_col: str, rest: str) -> str:
    return f"doc_id {df.schema[id_col].dataType.simpleString()}, {rest}"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
