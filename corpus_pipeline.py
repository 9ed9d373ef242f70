"""A corpus pipeline of five operators: each stage reads what its predecessor wrote.

Defined results: rows with null or empty texts, or without a letter, end at the first stage; rows with a null id pass
all stages, are duplicates of nothing and lose no passage; of repeated rows one stays; extra columns of documents are
dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import language, packing, pii, simhash, substrings
from vectorloom.llm.common import stored
from vectorloom.llm.registry import pii_key, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects; the others take the language predicted."""
    judged = language.annotate(docs.select(*COLUMNS), language.train(docs))
    return judged.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what an earlier document has; a character that a cut splits goes too, and so do documents of which nothing stays."""
    found = substrings.cut(docs, carry=F.struct("lang", "source"))
    return _counted(found.select("doc_id", "text", "carry.lang", "carry.source")).where(F.length(F.trim("text")) > 0)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data and secrets."""
    return _counted(pii.surrogates(docs.select(*COLUMNS), key=pii_key(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows."""
    return packing.pieces_digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other, each over a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
