"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each result as Parquet to the shared folder and reads it again, so no plan
spans two stages and a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalis.llm import ngram_join, packing, quality_rules, suffix_dedup, toxicity
from intervalis.llm.common import discard, materialize, table
from intervalis.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject. The labels name documents of this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model, keep_text=True).where("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, and once if its row is repeated.

    Rows without a doc_id are compared too, by a key from their text that is larger than any doc_id, so they stay only where no
    row with an id is like them. Rows that share an id but not their text stay or go together.
    """
    key = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    keyed = docs.select(*COLUMNS, key.alias("_key"))
    first = ngram_join.link(keyed, "_key").where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    kept = keyed.join(first, "_key", "left_semi").withColumn("_text", F.xxhash64("text"))
    return kept.dropDuplicates(["_key", "_text"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that occur elsewhere in a run of 200."""
    cut = suffix_dedup.remove(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: The first stage is a trained model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
