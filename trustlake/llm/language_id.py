"""Language identification by compression.

For each language seen in training, a raw-content dictionary for zstandard is cut from a bounded sample of its labelled texts.  A text is
encoded with every dictionary (in blocks, so that all of a long text meets the dictionary and not only its beginning) and gets the
language whose encoding is the smallest; where the margin to the second is narrow, `rejected` is set.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if nothing could be learned; ties go to
the language with the most labelled rows, then to the code that sorts first; repeated training rows count once; repeated rows give
repeated result rows; texts of any length are encoded whole, in blocks; an empty table gives an empty result; other columns are never
inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import sampled, small

_LETTER = re.compile(r"[^\W\d_]")


def learn_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 96, dict_bytes: int = 32_000, least_rows: int = 1
) -> dict[str, bytes]:
    """language -> dictionary (lower-cased, as texts are before encoding), the most frequent language first.

    The fit is on a bounded sample: of each language the per_lang distinct texts with the smallest hashes (repeated rows count once), and
    of each of these a stretch of dict_bytes // per_lang code points, from a place that its hash gives; at most dict_bytes are kept.
    Every language with least_rows labelled rows and a text that is not empty is learned."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().filter(F.col("count") >= least_rows).collect()}
    share = max(1, dict_bytes // per_lang)
    place = F.floor(F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.lit(1), F.length("text") - share + 1))).cast("int") + 1
    found = sampled(rows, "lang", per_lang, 3).select("by", "h", F.substring("text", place, F.lit(share)).alias("text")).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda k: (-counts[k], k)):
        texts = [r["text"] for r in sorted((r for r in found if r["by"] == lang), key=lambda r: -r["h"])]
        out[lang] = "\n".join(texts).lower().encode()[-dict_bytes:]
    return out


def predict_language(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.01, block: int = 4096, level: int = 6
) -> DataFrame:
    """doc_id, lang_pred, score (share of the smallest encoding in the weights 2 ** -(bytes over the smallest / 4)), rejected (the
    margin to the second, over the second, is below `narrow`)."""
    langs = list(dictionaries)
    given = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in langs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = []
        for raw in given.value:
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            encoders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for b in small(batches):
            preds, scores, rejected = [], [], []
            for text in b.column("text").to_pylist():
                if not encoders or text is None or not _LETTER.search(text):
                    preds.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                data = memoryview(text.lower().encode("utf-8"))
                sizes = np.zeros(len(encoders))
                for at in range(0, len(data), block):
                    part = data[at : at + block]
                    sizes += [len(e(part)) for e in encoders]
                best = int(sizes.argmin())
                over = np.sort(sizes - sizes[best])
                preds.append(langs[best])
                scores.append(float(1 / np.exp2(-np.minimum(over, 1000) / 4).sum()))
                rejected.append(bool(len(over) > 1 and over[1] < narrow * (sizes[best] + over[1])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def fold(id_col: str, parts: int):
    """crc32 of the id's decimal text, modulo parts; null ids are in no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from the labelled rows outside the held-out fold, predicted for all."""
    learned = learn_dictionaries(docs.filter(fold(id_col, parts) != held_out), text_col, lang_col)
    out = predict_language(docs, learned, id_col, text_col)
    return out.select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
