"""The queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import chat, cross_polytope, decontaminate, filter_audit, hard_negatives, html_text, language_id, line_dedup, ngram_join, packing, records, substring_dedup, toxicity
from emberline.llm.tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return language_id.identify_documents(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 35 words that occur elsewhere."""
    judged = substring_dedup.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in record files, read back from them."""
    return records.encode_to_records(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors to every vector whose id is divisible by 100."""
    vectors = cross_polytope.usable(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return cross_polytope.nearest_neighbours(vectors.where("id % 100 = 0"), vectors, k=10)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of five-word shingles are similar."""
    return ngram_join.shingle_components(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, over all documents."""
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are judged toxic, with the probability of each category; all documents are judged."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, chain).where("toxic").select("doc_id", "p_low_quality", "p_toxic", "p_severe")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that three or more of them hold."""
    left = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents of each language, in every order."""
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, from all vectors."""
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(vectors.select("vec_id", "embedding", label.alias("label")), "vec_id", "embedding", "label")
    return hard_negatives.mine(rows.where("id % 50 = 0"), rows)


_QUERIES = (
    op1_language_id,
    op2_chat_format,
    op3_substring_dedup,
    op4_token_records,
    op5_nearest_neighbours,
    op6_ngram_jaccard,
    op7_html_text,
    op8_decontamination,
    op9_toxicity,
    op10_best_fit_packing,
    op11_line_dedup,
    op12_filter_audit,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
