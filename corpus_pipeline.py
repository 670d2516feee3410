"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. `run` writes each stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postern.llm import byte_bpe, decontamination, ngram_join, pii, quality_rules
from postern.llm.common import table, write_table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the count rules or the fitted classifier reject go."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return byte_bpe.op5(docs)


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("PII", personal_data), ("byte-level BPE", token_ids)]
#: SQL cannot express the fitted classifiers and the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
