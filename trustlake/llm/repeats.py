"""What the searches for repeated passages share: hashes of stretches, sliding minima, copies of whole texts, and a bitmap of keys that
occur in more than one document.

The bitmap has a fixed size whatever the corpus: it only spares rows whose key is certainly unrepeated a shuffle.  Where a larger
corpus would fill it, the rows are joined with the keys instead; results are the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import sized, staged

#: Bits of the bitmap (a power of two): 2 ** 27 are 16 MB.
BITMAP_BITS = 27
_BUCKET = 4096 * 8  # bits of a row of bitmap_construct_agg


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift, as SplitMix64 does)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of every run of `width` values, by doubling (values: uint64)."""
    done, out, part, size, power = 0, None, values, 1, base
    n = len(values)
    while True:
        if width & size:
            moved = part[done:]
            if out is None:
                out = moved
            else:
                k = min(len(out), len(moved))
                out = out[:k] * np.uint64(pow(base, size, 1 << 64)) + moved[:k]
            done += size
        if done == width:
            return mix(out[: max(0, n - width + 1)])
        part = part[:-size] * np.uint64(power) + part[size:] if len(part) > size else part[:0]
        power = power * power % (1 << 64)
        size *= 2


class Rolling:
    """Polynomial hashes (modulo 2 ** 64) of stretches of bytes, from running sums, so that no stretch is touched by itself.  A byte's
    value is the byte and 1, or one of a table that `seed` draws."""

    def __init__(self, base: int, seed: int | None = None):
        self.base, self.symbol = base, None if seed is None else mix(np.arange(256, dtype=np.uint64) + np.uint64(seed))
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
        if self.symbol is None:
            values = data.astype(np.uint64)
            values += np.uint64(1)
        else:
            values = self.symbol[data]
        values *= self.up[:n]
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def all(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Of every run of `width` bytes; the upper bits are the better mixed ones."""
        out = sums[width:] - sums[:-width] if len(sums) > width else sums[:0].copy()
        out *= self.down[: len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    m, size = values, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if size < width else m


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without copies; doc_id, th of the copies).  rows: doc_id, text, th (64-bit digest, which only tells rows of one doc_id apart).
    A copy has the text (by its SHA-256) of a row with a smaller doc_id, so all that it holds stands there, too."""
    digests = staged(rows.select("doc_id", "th", F.sha2("text", 256).alias("sha")))
    heads = staged(digests.groupBy("sha").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head <> last").select("sha", "head"))
    copied = staged(digests.join(sized(heads), "sha").filter("doc_id > head").select("doc_id", "th").distinct())
    return rows.join(sized(copied), ["doc_id", "th"], "left_anti"), copied


def repeated(keys: DataFrame) -> DataFrame:
    """The keys that occur with more than one doc_id (column key); a hot key is one row per task when shuffled."""
    found = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return found.filter("first <> last").select("key")


def fits_bitmap(keys: DataFrame) -> bool:
    """Whether so few keys (staged) are set that the bitmap spares most rows; else, an exact join has to."""
    return keys.count() <= 1 << (BITMAP_BITS - 2)


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of column key, from one row of 4 KB per bucket."""
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    rows = keys.select(F.floor(bit / _BUCKET).cast("int").alias("bucket"), (bit % _BUCKET).cast("long").alias("bit"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator():
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be in the bitmap."""
    at = keys.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
