"""The thin opN_<name> queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postern.llm import byte_bpe, decontamination, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_output, warc
from postern.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lambda s, d: lm_scoring.op1(table(s, d, "documents")),
        "op2_token_output": lambda s, d: token_output.op2(table(s, d, "documents")),
        "op3_substring_dedup": lambda s, d: substring_dedup.op3(table(s, d, "documents")),
        "op4_ngram_join": lambda s, d: ngram_join.op4(table(s, d, "documents")),
        "op5_byte_bpe": lambda s, d: byte_bpe.op5(table(s, d, "documents")),
        "op6_quality_classifier": lambda s, d: quality_classifier.op6(table(s, d, "documents"), table(s, d, "labels")),
        "op7_decontamination": lambda s, d: decontamination.op7(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_warc": lambda s, d: warc.op8(table(s, d, "pages")),
        "op9_pii": lambda s, d: pii.op9(table(s, d, "documents")),
        "op10_quality_rules": lambda s, d: quality_rules.op10(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": decontamination.OP7_SQL, "op8_warc": warc.OP8_SQL}
