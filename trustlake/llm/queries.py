"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_corpus
from .bpe import bpe_round_trip
from .chat import BEGIN, CLOSE, END, OPEN, chat_format, chat_read, learned_texts
from .exact_dedup import exact_dedup
from .fim import fim_restore, fim_transform
from .language_id import language_id
from .line_dedup import line_dedup
from .media import media_columns
from .packing import pack
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir), tokenizer_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.size("_spans").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim_transform(_documents(spark, sf_dir))
    restored = fim_restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = chat_format(rows.unionByName(planted)).select("conv_id", "formatted", chat_read(F.col("formatted")).alias("turns"), F.array_join(learned_texts(F.col("segments")), "").alias("learned"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_suffix_dedup, op3_language_id, op4_bpe, op5_toxicity, op6_packing, op7_substring_dedup, op8_media, op9_line_dedup, op10_simhash, op11_fim, op12_chat, op13_alignment,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        h AS (SELECT doc_id, length(t) AS n, sha256(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM d),
        k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS r
              FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM k""",
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        m AS (SELECT doc_id, no, raw, trim(raw, ' ') AS line, (doc_id, no) AS place FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS no, unnest(a) AS raw FROM d)),
        f AS (SELECT line, length(line) AS n, min(place) AS first FROM m WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
        v AS (SELECT line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM f WHERE n >= 10)),
        near AS (SELECT line FROM v JOIN (SELECT v, i, min(first) AS least FROM v GROUP BY 1, 2) USING (v, i) WHERE least < first
            UNION SELECT v.line FROM v JOIN f ON f.line = v.v WHERE f.n >= 10 AND f.first < v.first
            UNION SELECT f.line FROM f JOIN v ON f.line = v.v WHERE f.n >= 10 AND v.first < f.first),
        g AS (SELECT doc_id, no, raw, CASE WHEN f.first < place THEN 'exact' WHEN near.line IS NOT NULL THEN 'near' END AS reason FROM m LEFT JOIN f USING (line) LEFT JOIN near ON near.line = m.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (reason = 'exact') AS n_exact, count(*) FILTER (reason = 'near') AS n_near,
            length(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (reason IS NULL), '')) AS n_chars_kept,
            sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (reason IS NULL), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op11_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        e AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS y,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                   WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        c AS (SELECT *, substr(t, 1, least(x, y)) AS p, substr(t, 1 + least(x, y), greatest(x, y) - least(x, y)) AS m, substr(t, 1 + greatest(x, y)) AS s FROM e)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM c""",
    "op12_chat": rf"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS marks,
              len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) AS role_marks FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(text) + marks + {len(BEGIN + END)} + CASE WHEN before IS DISTINCT FROM role THEN length(role) + role_marks + {len(OPEN + CLOSE)} ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id""",
}
