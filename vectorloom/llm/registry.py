"""Queries over whole tables with production parameters, one an operator, and their SQL where SQL can express it."""

from __future__ import annotations

from vectorloom.llm import embeddings, language, media, oracles, packing, pages, pieces, pii, quality, simhash, substrings
from vectorloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.class_digest(table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pieces_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_embeddings(spark, sf_dir):
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op5_wrapper(spark, sf_dir):
    return pages.text_digest(table(spark, sf_dir, "pages"))


def op6_substrings(spark, sf_dir):
    return substrings.cut_digest(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark, sf_dir):
    return language.language_digest(table(spark, sf_dir, "documents"))


#: Only for the invented texts of these queries; a session that sets a key of its own is obeyed.
DEMONSTRATION_KEY = "not a secret"


def pii_key(spark) -> str:
    return spark.conf.get(pii.KEY_SETTING, DEMONSTRATION_KEY)


def op9_pii(spark, sf_dir):
    return pii.surrogate_digest(table(spark, sf_dir, "documents"), pii_key(spark))


def op10_pieces(spark, sf_dir):
    return pieces.pieces_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_media, op2_simhash, op3_packing, op4_embeddings, op5_wrapper, op6_substrings, op7_quality, op8_language, op9_pii, op10_pieces)}


def oracle_sql() -> dict:
    return {"op2_simhash": oracles.SIMHASH, "op4_embeddings": oracles.EMBEDDINGS, "op6_substrings": oracles.SUBSTRINGS}
