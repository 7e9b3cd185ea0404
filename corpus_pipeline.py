"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import language_id, minhash_dedup, mixing, piece_codec, substring_dedup
from tapeworks.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learned from these documents' own labels, a missing language filled in; texts without a letter and long unsure ones go."""
    return language_id.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words; rows without an id stay."""
    gone = minhash_dedup.near_duplicates(docs, size=5).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too; a text that loses nothing stays as it is."""
    return substring_dedup.strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where the mix takes a part, its first words."""
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every text."""
    return piece_codec.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixture),
    ("sentencepiece", token_ids),
]

#: Language identification learns a network, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
