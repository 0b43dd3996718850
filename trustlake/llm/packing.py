"""Bounded-space online packing of token sequences.

Each partition reads its documents once, keeps at most `open_windows` windows open, and puts a document where it fits best (the open
window with the least room that still suffices).  If none fits and no more may be opened, the fullest is emitted: its gap is filled with
the document's head (unless the gap is below `min_piece` tokens) and the rest goes on.  Documents longer than a window fill windows of
their own first.  At the end the windows left open, at most `open_windows` a partition and with their ids, are merged: groups of 32
partitions at a time, in parallel, round by round until one group is left, so no task ever gets more than 32 x open_windows windows.
The very last, partly filled window is cut at powers of two, which need no padding.

Defined results: a null text is empty, an empty document is its closing id alone; repeated rows are packed as often as they occur; null
doc_ids are carried; texts of any length are cut; an empty table gives an empty result; other columns are ignored.  Which sequence holds
which piece depends on how the input is partitioned; that each id lies in exactly one piece does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import fragments, slices
from .common import small, staged

MERGED_AT_ONCE = 32


class Packer:
    """Places pieces (id, start, token bytes, document's tokens) into windows of `size` tokens of 4 bytes."""

    def __init__(self, size: int, open_windows: int, min_piece: int):
        self.size, self.most, self.min_piece = size, open_windows, min_piece
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def place(self, doc, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Yields the windows that are emitted."""
        at, n = 0, len(ids) // 4
        while n - at >= self.size:
            yield [(doc, start + at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        while at < n:
            rest = n - at
            fits = [w for w in self.open if self.size - w[0] >= rest]
            if not fits and len(self.open) < self.most:
                self.open.append((0, []))
                continue
            into = max(fits or self.open, key=lambda w: w[0])
            self.open.remove(into)
            take = min(rest, self.size - into[0])
            if fits or take >= self.min_piece:
                into[1].append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                into = (into[0] + take, into[1])
                at += take
            if not fits or into[0] == self.size:
                yield into[1]
            else:
                self.open.append(into)

    def cut_last(self) -> Iterator[list]:
        """The open windows, cut into sequences whose lengths are powers of two."""
        for tokens, pieces in self.open:
            room, out = 1 << (tokens.bit_length() - 1) if tokens else 0, []
            for doc, start, ids, total in pieces:
                at, n = 0, len(ids) // 4
                while at < n:
                    take = min(room, n - at)
                    out.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                    at, room, tokens = at + take, room - take, tokens - take
                    if not room:
                        yield out
                        room, out = 1 << (tokens.bit_length() - 1) if tokens else 0, []
        self.open = []


def _schema(kind: T.DataType) -> T.StructType:
    long = T.LongType()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")
    return T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, long) for n in names], T.StructField("open", T.BooleanType()), T.StructField("ids", T.BinaryType())])


class _Rows:
    """Collects piece rows; sequence ids are unique by round, part and count."""

    def __init__(self, kind: pa.Schema, round_: int, part: int, keep_ids: bool):
        self.kind, self.part, self.keep, self.rows, self.next = kind, part, keep_ids, [], round_ << 58 | part << 28

    def add(self, window: list, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, self.part, is_open, ids if is_open or self.keep else None))
            offset += n
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.kind)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.kind)], schema=self.kind)


def _merging(kind: pa.Schema, round_: int, last: bool, size: int, open_windows: int, with_ids: bool):
    def merge(key, table):
        rows, packer = _Rows(kind, round_, int(key[0].as_py()), with_ids), Packer(size, 1 if last else open_windows, 1)
        # Longest first; the rest of the key makes the order independent of how rows arrive.
        for r in sorted(table.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
            for window in packer.place(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]):
                rows.add(window)
        for window in packer.cut_last() if last else [p for _, p in packer.open]:
            rows.add(window, not last)
        return pa.Table.from_batches([rows.batch()], kind)

    return merge


def pack(
    docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, open_windows: int = 16, min_piece: int = 16, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the piece's ids (binary, unsigned
    32-bit little-endian)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _schema(docs.schema[id_col].dataType)
    arrow, end = to_arrow_schema(kind), np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, packer = fragments(path, "packed ids"), Packer(size, open_windows, min_piece)
        rows = _Rows(arrow, 0, TaskContext.get().partitionId(), with_ids)
        for b in small(batches):
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for i, j in slices(texts):
                for doc, parts in zip(ids[i:j], cutter.encode(texts[i:j], lambda ids, _: np.array(ids, "<u4").tobytes())):
                    tokens = b"".join(parts) + end
                    for window in packer.place(doc, 0, tokens, len(tokens) // 4):
                        rows.add(window)
                yield rows.batch()
        cutter.free()
        for _, pieces in packer.open:
            rows.add(pieces, True)
        yield rows.batch()

    pieces = staged(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(first, kind))
    closed, left = [pieces.filter("not open")], pieces.filter("open")
    parts, round_, last = (left.agg(F.max("part")).first()[0] or 0) + 1, 0, False
    while not last:
        parts, round_ = -(-parts // MERGED_AT_ONCE), round_ + 1
        last = parts == 1
        merge = _merging(arrow, round_, last, size, open_windows, with_ids)
        merged = staged(left.groupBy(F.floor(F.col("part") / MERGED_AT_ONCE).alias("part_")).applyInArrow(merge, kind))
        closed.append(merged.filter("not open"))
        left = merged.filter("open")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
