"""Deterministic mail built from the driver's tables, so that rules fire on them.

The tables hold no mail; these expressions give the same values in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.catalog import INDICATORS

IDS = [x[0] for x in INDICATORS]
PHRASES = ["verify your account", "act now", "wire transfer", "iban", "legal action", "keep this confidential", "dear customer", "nothing here"]
AUTH = ["spf=pass; dkim=pass; dmarc=pass", "spf=fail smtp.mailfrom=x; spf=pass; dkim=none", "spf=softfail; dkim=fail; dmarc=fail", "dkim=neutral; dkim=temperror; spf=none", "nothing"]
ENDINGS = ["pdf.exe", "zip", "docm", "html", "lnk", "iso", "txt", "pdf", "js", "png"]
MIMES = ["application/pdf", "application/zip", "text/plain", "application/octet-stream", "image/png"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], number):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values)).cast("int") + 1)


def sql_pick(values: list[str], number: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({number} AS BIGINT) % {len(values)} + 1]"


def message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id: eight events make a message."""
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).cast("string").alias("msg_id")).distinct()


#: What an event says of its message: an indicator, or (two times of three) nothing.
SAID = IDS + [""] * (2 * len(IDS))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, indicator_id: what a message's events say; some messages' say nothing."""
    k = F.col("event_id")
    said = table(spark, sf_dir, "events").select(F.floor(k / 8).cast("string").alias("msg_id"), pick(SAID, F.floor(k * 5 / 3)).alias("indicator_id"))
    return said.where("indicator_id <> ''").distinct()


MESSAGES_SQL = "SELECT DISTINCT CAST(event_id // 8 AS VARCHAR) AS msg_id FROM events"
FINDINGS_SQL = f"SELECT DISTINCT * FROM (SELECT CAST(event_id // 8 AS VARCHAR) AS msg_id, {sql_pick(SAID, 'floor(event_id * 5 / 3)')} AS indicator_id FROM events) WHERE indicator_id <> ''"
SENDERS = ["example.org", "micros0ft.tk", "gmail.com", "mail.example.co.uk", "paypa1-secure.xyz"]
LINKS = ['<a href="https://login.paypal.com.evil.top/login/verify?next=https://x.example">paypal.com</a>', '<a href="http://192.0.2.9/account/update">here</a>', '<a href="https://bit.ly/x">more</a>', '<a href="https://example.org/news">news</a>', '<img src="https://cdn.example.com/a.png">']


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, content, ord: a raw message for each customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    crlf = "\r\n"
    day = F.format_string("%02d", k % 28 + 1)
    domain = pick(SENDERS, k)
    name = pick(["Ann Example", "Microsoft Support", "Pat Boss CFO", "DHL Billing", "help@bank.com desk"], k / 3)
    link = pick(LINKS, k / 2)
    body = F.concat(F.lit("<html><body><p>"), pick(PHRASES, k), F.lit(". "), pick(PHRASES, k / 5), F.lit("</p>"), link, F.lit('<div style="display:none">hidden words that only a filter would ever read here</div>'), F.lit("</body></html>"))
    head = F.concat_ws(
        crlf,
        F.concat(F.lit("Received: from a.example (a.example [192.0.2.1]) by mx.example-corp.com with ESMTP id 1; "), day, F.lit(" Mar 2026 10:00:05 +0000")),
        F.concat(F.lit("Received: from b.example by a.example with ESMTP id 2; "), day, F.lit(" Mar 2026 10:00:00 +0000")),
        F.concat(F.lit("Authentication-Results: mx; "), pick(AUTH, k)),
        F.concat(F.lit("From: \""), name, F.lit("\" <user"), k.cast("string"), F.lit("@"), domain, F.lit(">")),
        F.concat(F.lit("Reply-To: r@"), pick(["example.org", "other.example"], k)),
        F.lit("To: team@example-corp.com"),
        F.concat(F.lit("Subject: "), pick(["Re: your order", "Invoice", "[EXTERNAL] notice", "Urgent"], k)),
        F.concat(F.lit("Date: "), day, F.lit(" Mar 2026 10:00:05 +0000")),
        F.concat(F.lit("Message-ID: <"), k.cast("string"), F.lit("@"), domain, F.lit(">")),
        F.lit('Content-Type: text/html; charset="utf-8"'),
    )
    # Parsing and judging cost milliseconds a message: spread them before, not after.
    return c.repartition(spark.sparkContext.defaultParallelism).select(F.concat(F.lit("customer-"), k.cast("string")).alias("source"), F.concat(head, F.lit(crlf * 2), body).cast("binary").alias("content"), k.cast("long").alias("ord"))
