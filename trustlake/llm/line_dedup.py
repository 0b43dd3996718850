"""Line deduplication within a bound of one edit, in DataFrame functions only.

A line is removed if an earlier line (smaller doc_id, then smaller line number) of the corpus is equal to it or at an edit distance
(insert, delete or replace one code point) of at most `max_edits`; the earliest line always stays.  It is a deletion-neighbourhood
join: two lines are one edit apart iff deleting one code point from the longer (from both, if a character was replaced) gives the
same string.  All such variants of a line of L code points would be L strings of L code points, so a line of presumed length l is cut
into blocks, and the variant's key hashes the text before the block, the text after it, and the block less one code point: an edit
lies in one block, so both lines share that key.  Lines that share no "text around a block" with another distinct line have no
partner and emit no variants (an exact filter, over all lines).  Keys carry the deleted position: lines that share variant and
position are all within one edit of each other, so the earliest of them stands for all and no pairs are formed; such a group has at
most one line per character of the alphabet.  Each link is verified with `levenshtein` on the two texts.

Defined results: lines are split at \\n and compared without leading and trailing spaces; blank lines always stay; equal lines of any
length go, and one edit is looked for between lines of at least `min_chars` code points, as most short words are one edit from another; a
null text is a text of one empty line; rows with a null doc_id come last in order, rows that
share a doc_id are ordered by a digest of their texts; whole repeats of a row (same doc_id and text) are one document: they keep and
lose the same lines; an empty table gives an empty result; other columns are passed on untouched, but for
those named like one that is added here (_lines, _exact, _near, _id, _th, _gone), which are replaced or dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import sized, staged, whole_text, without

#: Code points of a block of a long line; shorter lines have two blocks.
BLOCK = 2048


def _piece(line, total, length, step, b, role):
    at = b * step
    n = F.least(step, length - at) - F.lit(role)
    around = F.xxhash64(length, b, F.substring(line, F.lit(1), at), F.substring(line, at + n + 1, total))
    return F.struct(F.lit(role).alias("role"), around.alias("key"), at.alias("at"), n.alias("n"))


def _pieces(line, total, role):
    """array<struct<role,key,at,n>>: for each block of `line` (of `total` code points), the key of what surrounds it.

    role 0: the line loses a code point in the block; role 1: the line is one short of the presumed length, the block is a variant."""
    length = total + F.lit(role)
    halves = F.ceil(length / 2).cast("int")  # spelled out, for speed, as most lines have two blocks
    blocks = F.ceil(length / F.lit(BLOCK)).cast("int")
    step = F.ceil(length / blocks).cast("int")
    many = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: _piece(line, total, length, step, b, role))
    found = F.when(length <= 2 * BLOCK, F.array(*[_piece(line, total, length, halves, F.lit(b), role) for b in (0, 1)])).otherwise(many)
    return F.filter(found, lambda p: p["n"] + F.lit(role) > 0)


def _all_pieces(line, total):
    return F.concat(_pieces(line, total, 0), _pieces(line, total, 1))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 10) -> DataFrame:
    """The lines that go: doc_id, th (digest of the document's text), line_no (from 0), reason 'exact' or 'near', keep_id, keep_line."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    text = whole_text(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    lines = source.select("doc_id", "th", F.posexplode(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))).alias("line_no", "line"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("line_no").alias("line_no"))
    lines = lines.select("doc_id", "th", "line_no", "line", F.length("line").alias("n")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    none = F.array().cast("array<bigint>")
    keys = F.when(F.col("n") >= min_chars, F.transform(_all_pieces(F.col("line"), F.col("n")), lambda p: p["key"])).otherwise(none) if max_edits else none
    # A line is known by two independent hashes.
    base = staged(lines.select("doc_id", "th", "line_no", F.xxhash64("line", "n").alias("lh"), F.xxhash64(F.lit(7), "line").alias("lh2"), keys.alias("keys")))
    first = staged(base.groupBy("lh", "lh2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    exact = base.join(sized(first), ["lh", "lh2"]).filter(place > F.col("first")).select("doc_id", "th", "line_no", F.lit("exact").alias("reason"), F.col("first").alias("to"))
    if not max_edits:
        return exact.distinct().select("doc_id", "th", "line_no", "reason", F.col("to.doc_id").alias("keep_id"), F.col("to.line_no").alias("keep_line"))

    spread = base.select("doc_id", "th", "line_no", "lh", "lh2", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("z")).filter("a <> z").select("key")
    candidates = spread.join(shared, "key").groupBy("lh", "lh2").agg(F.min(place).alias("first"), F.collect_set("key").alias("hits"))
    candidates = staged(candidates.select(F.struct("lh", "lh2").alias("lh"), "first", "hits"))
    # A line's text is fetched from its first document only, however many copies that has.
    per_doc = candidates.groupBy(F.col("first.doc_id").alias("wanted_id"), F.col("first.th").alias("wanted_th"))
    per_doc = sized(staged(per_doc.agg(F.collect_list(F.struct("lh", "first", "hits")).alias("wanted"))))
    texts = staged(
        source.join(per_doc, (F.col("th") == F.col("wanted_th")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("w"))
        .select("w.lh", "w.first", "w.hits", F.trim(F.get("all", F.col("w.first.line_no"))).alias("line"))
        .dropDuplicates(["lh"])
    )
    pieces = texts.select("lh", "first", "line", "hits", F.explode(_all_pieces(F.col("line"), F.length("line"))).alias("p")).filter(F.array_contains("hits", F.col("p.key")))
    block = F.substring(F.col("line"), F.col("p.at") + 1, F.col("p.n"))
    cut = lambda i: F.xxhash64(F.col("p.key"), F.concat(F.substring(F.col("block"), F.lit(1), i), F.substring(F.col("block"), i + 2, F.col("p.n"))))
    pieces = pieces.withColumn("block", block)
    variants = pieces.filter("p.role = 0").select("lh", "first", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("p.n") - 1), cut)).alias("pos", "variant"))
    wholes = pieces.filter("p.role = 1").select("lh", "first", F.lit(-1).alias("pos"), F.xxhash64(F.col("p.key"), F.col("block")).alias("variant"))
    links = F.struct(F.col("first").alias("first"), F.col("lh").alias("lh"))
    by_variant, by_position = Window.partitionBy("variant"), Window.partitionBy("variant", "pos")
    met = variants.unionByName(wholes).select(
        "lh", "first", F.when(F.col("pos") >= 0, F.least(F.min(F.when(F.col("pos") < 0, links)).over(by_variant), F.min(links).over(by_position)))
        .otherwise(F.min(F.when(F.col("pos") >= 0, links)).over(by_variant)).alias("to"),
    ).filter(F.col("to.first") < F.col("first"))
    line_of = texts.select("lh", "line")
    checked = (
        met.select("lh", F.col("to.lh").alias("to_lh"), F.col("to.first").alias("to")).distinct()
        .join(line_of, "lh").join(line_of.select(F.col("lh").alias("to_lh"), F.col("line").alias("to_line")), "to_lh")
        .filter(F.levenshtein("line", "to_line", max_edits).between(0, max_edits))
        .groupBy("lh").agg(F.min("to").alias("to"))
    )
    checked = staged(checked.select("lh.lh", "lh.lh2", "to"))
    near = base.select("doc_id", "th", "line_no", "lh", "lh2").join(sized(checked), ["lh", "lh2"]).select("doc_id", "th", "line_no", F.lit("near").alias("reason"), "to")
    # A later copy of a near line is both: it counts as exact.
    both = exact.unionByName(near).groupBy("doc_id", "th", "line_no").agg(F.min(F.struct("reason", "to")).alias("r"))
    return both.select("doc_id", "th", "line_no", "r.reason", F.col("r.to.doc_id").alias("keep_id"), F.col("r.to.line_no").alias("keep_line"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 10) -> DataFrame:
    """docs without the lines that go, in text_col (null becomes empty), with _lines, _exact and _near: the line counts of each row."""
    docs = without(docs, "_id", "_th", "_gone", "_exact", "_near", "_lines")
    gone = line_decisions(docs, id_col, text_col, max_edits, min_chars).groupBy("doc_id", "th").agg(
        F.collect_list("line_no").alias("_gone"), F.count_if(F.col("reason") == "exact").alias("_exact"), F.count_if(F.col("reason") == "near").alias("_near")
    )
    gone = sized(staged(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_gone", "_exact", "_near")))
    text = whole_text(text_col)
    joined = docs.join(gone, (F.xxhash64(text) == F.col("_th")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(*[left.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.size(lines).cast("long").alias("_lines"), zero("_exact"), zero("_near"))
