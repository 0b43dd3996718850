"""Media columns: lossless 8-bit WAV, short-time Fourier transform, fingerprints of spectral-peak pairs.

A document's payload (its bytes, then zeros up to a positive multiple of 64) is written as unsigned 8-bit mono samples by the `wave`
module and read back from the stored bytes.  Frames of 256 samples every 128, under a Hann window, give a magnitude spectrum; in each
of five bands the strongest bin of a frame is a peak if it is stronger than that of the frames before and after.  Each peak is paired
with the next three peaks within 63 frames: (bin, other bin, distance) makes a hash, stored with its frame number as a time-coded array.

Defined results: a null text is empty, its payload is 64 zeros (no peaks); the last frame is filled up with zeros; long texts are
transformed in runs of frames, so memory is bounded by the payload; repeated rows give repeated result rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import small

FRAME, HOP, RUN = 256, 128, 4096
BANDS = (1, 8, 16, 32, 64, FRAME // 2 + 1)
FAN, FAR = 3, 63
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    stored = io.BytesIO()
    with wave.open(stored, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return stored.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def _strongest(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band, the magnitude and the bin of the strongest bin."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples
    padded[: len(samples)] -= 128
    windows = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    power, where = np.empty((frames, len(BANDS) - 1), np.float32), np.empty((frames, len(BANDS) - 1), np.int32)
    for at in range(0, frames, RUN):
        spectrum = np.abs(np.fft.rfft(windows[at : at + RUN] * _WINDOW, axis=1)).astype(np.float32)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            band = spectrum[:, low:high]
            best = band.argmax(axis=1)
            where[at : at + RUN, k] = best + low
            power[at : at + RUN, k] = band[np.arange(len(best)), best]
    return power, where


def landmarks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame number, hash) of each pair of peaks, in order."""
    power, where = _strongest(samples)
    edge = np.full((1, power.shape[1]), -1, np.float32)
    peak = (power > np.vstack((edge, power[:-1]))) & (power >= np.vstack((power[1:], edge))) & (power > 1)
    time, band = np.nonzero(peak)
    bins = where[time, band]
    times, hashes = [], []
    for k in range(1, FAN + 1):
        apart = time[k:] - time[:-k]
        near = apart <= FAR
        times.append(time[:-k][near])
        hashes.append((bins[:-k].astype(np.int64)[near] << 14) | (bins[k:].astype(np.int64)[near] << 6) | apart[near])
    time, code = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, times, hashes of each row; with
    keep_media also media (the WAV).  times and hashes (array<int>) are the time-coded fingerprints: the frame and the code of each pair
    of peaks, in order; feature: their number and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            at, rows, size = 0, [], 0
            for i, text in enumerate(texts):
                data = (text or "").encode("utf-8")
                payload = data + bytes((-len(data)) % 64 or 64 * (not data))
                stored = to_wav(payload)
                back = from_wav(stored)
                times, hashes = landmarks(np.frombuffer(back, np.uint8))
                feature = f"{len(times)}:{xxhash.xxh64_hexdigest(times.tobytes() + hashes.tobytes())}"
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                rows.append((*row, times, hashes, stored) if keep_media else (*row, times, hashes))
                size += len(stored) + 8 * len(times)
                if size > 8_000_000 or i == len(texts) - 1:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([ids[at : i + 1], *columns], names=["doc_id", *names])
                    at, rows, size = i + 1, [], 0

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "hashes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, hashes array<int>"
    if keep_media:
        names, kinds, schema = [*names, "media"], [*kinds, pa.binary()], schema + ", media binary"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {schema}")
