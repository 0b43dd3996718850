"""Exact deduplication, in DataFrame functions only.

A Misra-Gries sketch (`approx_top_k`, merged from one sketch a task) names digests that may be frequent; their exact counts are
then taken (a partial aggregate, so a hot digest costs one row a task), and the verified heavy ones, at most `max_heavy` rows, are
broadcast: their documents are settled on the map side and never shuffled.  All other digests have fewer rows than the sketch's
error bound, so an ordinary shuffle on the digest has no hot key left.

Defined results: a null text counts as empty (and all empty texts are equal); a null doc_id loses ties; fully repeated rows count
as rows of their own, of which exactly one stays; ids may be of any type that has an order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import staged, whole_text

#: The characters that normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text):
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, text)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of the rows whose normalised texts are equal, the one with the most code points in the original text stays, then the smallest id.
    max_heavy and tracked bound the broadcast and the sketch, not the result."""
    text = whole_text(text_col)
    base = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text), 256).alias("text_sha256"), F.length(text).alias("_n"), F.monotonically_increasing_id().alias("_row"))
    )
    # The least struct wins: most code points, then smallest id (null last), then first row.
    best = F.min(F.struct((-F.col("_n")).alias("_neg"), F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")).alias("_best")
    total = F.count(F.lit(1)).alias("group_size")
    rows = base.count()
    suspects = base.agg(F.expr(f"approx_top_k(text_sha256, {max_heavy}, {tracked})").alias("k")).select(F.explode("k").alias("s")).select(F.col("s.item").alias("text_sha256"))
    # A digest that is not among the suspects has at most about rows / tracked rows; lighter suspects take the ordinary way as well.
    # The winners are written once, as a sketch that is merged in another order may name others: both branches have to see the same.
    heavy = F.broadcast(
        staged(base.join(F.broadcast(suspects), "text_sha256", "left_semi").groupBy("text_sha256").agg(total, best).filter(F.col("group_size") > max(2, rows // tracked)).limit(max_heavy))
    )
    frequent = base.join(heavy, "text_sha256")
    rest = base.join(heavy, "text_sha256", "left_anti")
    rest = rest.join(rest.groupBy("text_sha256").agg(total, best), "text_sha256")
    return frequent.unionByName(rest).select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")
