"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import alignment, bpe, chat, fingerprints, langid, licenses, line_dedup, ngram_join, packing, pieces, quality_rules, ranked_search, suffix_dedup
from cohortspark.llm._common import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(documents(spark, sf_dir), forms=("kept",))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), TOKENIZER)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(documents(spark, sf_dir), TOKENIZER, PIECES)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_round_trip(documents(spark, sf_dir), PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_line_dedup, op4_ngram_jaccard_join, op5_language_id, op6_packing, op7_quality_rules, op8_chat_formatting, op9_license_scans, op10_fingerprints, op11_ranked_search, op12_alignment, op13_sentencepiece)}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), p AS (
  SELECT *, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM t
), ends AS (
  SELECT pos, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY pos, prefix
), kept AS (
  SELECT * FROM ends e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = e.pos AND p.prefix = e.prefix)
)
SELECT k.conv_id, k.pos AS n_turns, k.n_copies,
  string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept k JOIN t ON k.conv_id = t.conv_id GROUP BY k.conv_id, k.pos, k.n_copies
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term
), s AS (
  SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0
), x AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d
), f AS (
  SELECT doc_id, n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, n_docs
), c AS (
  SELECT f.doc_id, f.term, w.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + ((25 * f.n * s.n_docs) // s.n_terms)))) AS part
  FROM f JOIN w USING (term), s
), r AS (
  SELECT q.item_id, c.doc_id, sum(q.times * c.part)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY q.item_id, c.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20
""",
}
