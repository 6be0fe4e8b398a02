"""Corpus pipeline over `documents`: language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next. All
but the last return the columns of documents. Rows with a null doc_id or text pass as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import langid, minhash, packing, pii
from tracemill.llm.runtime import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language or with an unsure one go."""
    named = langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model"), COLUMNS)
    return named.where("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id."""
    return minhash.keep_first(docs.select(COLUMNS), words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    found = pii.find(docs, pii.fit(docs.select("doc_id", "text")), COLUMNS, mask=True)
    return found.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("bigint"), "n_chars").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in its sequence, whatever its length; no documents give no rows."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
