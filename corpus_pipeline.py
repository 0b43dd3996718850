"""A corpus through five stages; each takes (spark, docs, sf_dir) and works on all that the stage before it kept.

toxicity: documents scored at 0.3 or more go.  line_dedup: lines that repeat an earlier line (equal, or within one edit) go, and documents
left blank by that.  simhash: one document of each component of near-equal fingerprints stays, that of the smallest doc_id.
substring_dedup: passages of 50 words or more that repeat an earlier document's go.  packing: sequences of at most 4096 tokens.

Defined results: columns besides those of documents are dropped, so clashing names do no harm; a null text counts as empty and, like an
empty or blank one, loses nothing by lines, is one of the documents with the zero fingerprint, of which one stays, and is packed as its end
token; rows that share a doc_id, or have none, are decided each by itself in the first three stages, and are never a repeat of each other
in the fourth; of exact repeats of a row one stays; very long texts are taken whole; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustlake.llm.common import staged
from trustlake.llm.line_dedup import line_dedup
from trustlake.llm.packing import pack
from trustlake.llm.queries import tokenizer_path
from trustlake.llm.simhash import simhash_dedup
from trustlake.llm.substring_dedup import substring_dedup
from trustlake.llm.toxicity import without_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs.select(*COLUMNS))
    emptied = (F.col("_exact") + F.col("_near") > 0) & F.col("text").rlike(r"\A\s*\z")
    return _counted(out.filter(~emptied))


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs.select(*COLUMNS))


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup(docs.select(*COLUMNS)))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", _toxicity), ("line_dedup", _line_dedup), ("simhash", _simhash), ("substring_dedup", _substring_dedup), ("packing", _packing)]

#: SQL expresses neither the tagger nor the window packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
