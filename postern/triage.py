"""The whole way: raw messages to scored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postern.functions.domains import SUFFIX_LIST
from postern.operators.parse import parse
from postern.operators.rules import findings
from postern.operators.scoring import score_rows
from postern.sources import messages


def triage(raw: DataFrame, org_domains: tuple[str, ...] = (), dns_txt: DataFrame | None = None, suffix_list: str = SUFFIX_LIST) -> DataFrame:
    """Parsed, judged and scored messages: one row each, no shuffle (a DNS snapshot is joined on the sender)."""
    return score_rows(findings(parse(raw, suffix_list), org_domains, dns_txt))


def analyze_bytes(spark: SparkSession, raw: bytes, source: str = "<memory>", org_domains: tuple[str, ...] = ()) -> DataFrame:
    return triage(messages.in_memory(spark, [(source, raw)]), org_domains)


def analyze_file(spark: SparkSession, path: str, org_domains: tuple[str, ...] = ()) -> DataFrame:
    return triage(messages.read_file(spark, path), org_domains)


def analyze_paths(spark: SparkSession, *paths: str, org_domains: tuple[str, ...] = (), dns_txt: DataFrame | None = None) -> DataFrame:
    return triage(messages.scan(spark, *paths), org_domains, dns_txt)
