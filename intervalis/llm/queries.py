"""One query for each operator of this package, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac_media, html_extract, language_id, ngram_join, packing, quality_rules, sp_sampling, suffix_dedup, toxicity, warc_index
from .common import crc_remainder, table


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = language_id.fit(documents)
    found = language_id.identify(documents.select("doc_id", "text"), network)
    return found.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = flac_media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return flac_media.media_digests(stored)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of every document."""
    return sp_sampling.sample(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), ["doc_id"])


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, directory, folder = warc_index.archive(pages)
    return warc_index.look_up(pages.select("url", "page_id"), directory, folder)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_flac_media": op8_flac_media,
    "op9_sentencepiece_sampling": op9_sentencepiece_sampling,
    "op10_warc_index": op10_warc_index,
}
