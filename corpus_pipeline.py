"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. ``language_id``: documents without letters (null and empty texts too) go; of the others those without a language get the predicted one.
2. ``line_dedup``: fuzzy copies of lines go, but for the first; documents left without a word go with their last line.
3. ``ngram_jaccard_join``: of documents that hang together by near-equal shingle sets the row with the smallest id (and hash of its text, where ids are the same or null) stays.
4. ``suffix_dedup``: passages of 50 bytes or more that a document with a smaller id holds are cut out.
5. ``packing``: what is left, as pieces of power-of-two length.

Nulls in other columns pass through; ``n_chars`` is counted anew after a text changed.
A null id is an id like others, last in the third stage's order; a repeated row stays
once from there on; very long texts are processed whole; columns that documents do not
have are left out by the first stage; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import langid, line_dedup, ngram_join, packing, suffix_dedup
from cohortspark.llm._common import documents, join_by_key, row_key, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame) -> DataFrame:
    """Columns of documents, with ``n_chars`` of the text as it is now, without documents that have no word left."""
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    found = langid.identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    told = F.coalesce("lang", F.nullif("lang_pred", F.lit("und"))).alias("lang")
    return found.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select("doc_id", "text", told, "source", "n_chars")


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(line_dedup.line_dedup(docs, keep=("lang", "source")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id and hash stays, null ids last; so do rows without a group of their own. A repeated row stays once."""
    rows = ngram_join.placed_rows(docs).where("size > 0").select("root", "rid", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid").alias("rank"))
    first = rows.groupBy("root").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = join_by_key(rows, first.select("root", "first"), "root", first.select("root", "n"))
    gone = gone.where(F.col("rid") != F.col("first.rid")).select("rid").distinct()
    left = docs.withColumn("rid", row_key(docs)).join(gone, "rid", "left_anti")
    return left.dropDuplicates(["rid"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of a character that was cut in two go as well."""
    return with_text(suffix_dedup.suffix_dedup(docs, keep=("lang", "source"), forms=("text",)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", deduplicate_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_documents),
]

#: MinHash candidates, language models and suffix sorting are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
