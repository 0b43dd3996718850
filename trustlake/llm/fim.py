"""Fill-in-middle transformation by repeated-capture matching.

A text is matched once against (unit)*: the regex library keeps the end of every repetition of the group, so match.ends(1) gives the
number of units and, by index, both cut offsets; no unit is walked over in Python.  Which units are cut, and the form, come from a hash
of the row's id, computed by Spark.  A text of more than REPEATS code points is matched in consecutive matches of at most that many
repetitions, each kept whole, as one match holds all its captures in memory at once.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text itself.  A text that holds one of the
marks is plain, so the marks of an output are unambiguous: a mark starts with `<` and ends with `>` and holds neither inside, hence no
occurrence can straddle a mark and the text beside it, and `fim_restore` finds each one by its first occurrence.

Defined results: a null text is empty; an empty text is plain with n = 0; a null id is hashed as an empty one; repeated rows give
repeated result rows; texts of any length are matched whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import small, whole_text

P, S, M = "<P>", "<S>", "<M>"
#: Repetitions that one match keeps at most.
REPEATS = 1 << 20


class Cutter:
    """Numbers of units and offsets of cuts of texts."""

    def __init__(self, unit: str, repeats: int = REPEATS):
        self.whole = regex.compile(f"({unit})*+", regex.DOTALL)
        self.part = regex.compile(f"({unit}){{1,{repeats}}}+", regex.DOTALL)
        self.repeats = repeats

    def ends(self, text: str) -> list[int]:
        """The offsets at which the units end; a tail that no unit matches is an error."""
        if len(text) <= self.repeats:
            found = self.whole.fullmatch(text)
            if found is None:
                raise ValueError("the text is not a sequence of units")
            return found.ends(1)
        out, at = [], 0
        while at < len(text):
            found = self.part.match(text, at)
            if found is None:
                raise ValueError("the text is not a sequence of units")
            out += found.ends(1)
            at = found.end()
        return out


def draws(id_col: str, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:id`, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fim_transform(docs: DataFrame, plain_share: int = 10, spm_share: int = 20, seed: int = 1, unit: str = ".", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output of each row.

    Of 100 rows about plain_share stay plain, and of the others spm_share in a hundred take the form spm.  unit: a pattern whose
    consecutive matches make up every text (. is a code point)."""
    h1, h2, h3, h4 = draws(id_col, seed)
    text = whole_text(text_col)
    marked = text.contains(P) | text.contains(S) | text.contains(M)
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain_share), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit)
        for b in small(batches):
            out = []
            for text, form, h1, h2 in zip(*[b.column(c).to_pylist() for c in ("text", "form", "h1", "h2")]):
                ends = cutter.ends(text)
                n = len(ends)
                if form == "plain":
                    out.append((n, None, None, text))
                    continue
                one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                i, j = ends[one - 1] if one else 0, ends[two - 1] if two else 0
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                out.append((n, i, j - i, P + prefix + S + suffix + M + middle if form == "psm" else S + suffix + P + prefix + M + middle))
            n, i, m, o = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), b.column("form"), pa.array(i, pa.int64()), pa.array(m, pa.int64()), pa.array(o, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, kind)


def fim_restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    head, last = F.substring_index(output, M, 1), F.substring_index(output, M, -1)
    between = lambda mark: F.substring_index(head, mark, -1)
    psm = F.concat(F.substring(F.substring_index(head, S, 1), 1 + len(P), 1 << 30), last, between(S))
    spm = F.concat(between(P), last, F.substring(F.substring_index(head, P, 1), 1 + len(S), 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
