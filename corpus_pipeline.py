"""The corpus pipeline: documents pass quality rules, line dedup, near-duplicate removal and decontamination, and what
is left is packed into sequences. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import decontam, line_dedup, ngram_join, packing, weak_rules
from memspark.llm.common import materialize, table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules keep; null and empty texts go. Repeated rows are judged alike."""
    return weak_rules.kept(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that earlier ones hold. What loses lines must still hold the 50 words that the
    quality rules ask for, so no text goes on that is empty or a scrap of itself; documents that lose none stay."""
    return line_dedup.deduplicated(docs, least_words=50)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates; null ids and ids with several texts are told
    apart by text, and of repeated rows one stays."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null items have none."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with the sequence and place of each; every row is a document of its own."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: EM, near duplicates and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet and read again by the next. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
