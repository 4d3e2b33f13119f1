"""The corpus pipeline: stages that each read what the stage before them wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.decontaminate import without_items
from emberline.llm.ngram_join import one_of_each
from emberline.llm.packing import pack_documents
from emberline.llm.substring_dedup import remove_repeats
from emberline.llm.tokens import vocabulary
from emberline.llm.toxicity import without_toxic
from emberline.session import Scratch, release_driver


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a chain fitted on the labels doesn't judge toxic."""
    release_driver(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    release_driver(spark)
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without windows of words that occur elsewhere among them."""
    release_driver(spark)
    return remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    release_driver(spark)
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens from all documents that are left."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Tokenizing, linear models and singular vectors are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
