"""The indicator catalogue: one row a rule, as a small dimension."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.intel import CATEGORIES, SEVERITY_RANK

_BAND = {"AUTH": "authentication", "HDR": "headers", "URL": "urls", "ATT": "attachments", "CNT": "content"}

# Id | severity | weight | techniques | name | (own words) what it means.
_ROWS = """
AUTH-001|high|18|T1566.002 T1656|SPF hard fail|The envelope domain's SPF policy does not allow the sending address.
AUTH-002|medium|8|T1656|SPF soft fail or neutral|SPF neither passed nor failed outright.
AUTH-003|high|15|T1656|DKIM signature failed|A signature is there but does not verify.
AUTH-004|low|4||No DKIM signature|Nothing vouches for the body.
AUTH-005|critical|22|T1566.002 T1656|DMARC evaluation failed|By the From domain's own policy this mail is not its.
AUTH-006|medium|7||No authentication results present|No receiving server recorded a verdict, or the record was removed.
AUTH-007|high|14|T1656|DMARC identifier alignment mismatch|What passed authentication is another organisation than the visible sender.
AUTH-008|medium|6||Sender domain publishes no DMARC record|The DNS snapshot has no DMARC policy for the sender.
AUTH-009|high|12||SPF record ends in +all|The domain lets any host send in its name.
HDR-001|medium|10|T1656|Reply-To points to a different domain|Answers would go to another organisation.
HDR-002|medium|8|T1656|Return-Path does not match From|Bounces go to another organisation.
HDR-003|high|14|T1656|Display name contains a conflicting address|The name shows an address that is not the sender's.
HDR-004|high|15|T1656|Display name impersonates a known brand|A brand is named that does not own the sending domain.
HDR-005|low|5||Message-ID domain does not match sender|Another organisation minted the message id.
HDR-006|low|4||Message-ID missing or malformed|No valid message id.
HDR-007|low|4||Bulk or scripted mailer fingerprint|A mailer header names a mass-mailing or scripting tool.
HDR-008|low|3||Implausible delay in the Received chain|A relay's clock runs backwards or a hop took hours.
HDR-009|low|5||Date header disagrees with delivery time|The claimed date is a day or more off the delivery.
HDR-010|medium|7||Truncated or absent Received chain|One relay or none.
HDR-011|low|5||Recipient does not appear in To or Cc|The organisation's recipient is not among the visible ones.
HDR-012|medium|9|T1656 T1585.002|Corporate identity claimed from a freemail account|A company role writes from a consumer mailbox.
HDR-013|medium|8|T1656|Subject carries a spoofed reply or external marker|A reply without a thread, or a forged external banner.
URL-001|critical|20|T1566.002 T1204.001|Link text displays a different domain than its target|The text names one site, the link leads to another.
URL-002|high|13|T1566.002|Internationalised (punycode) hostname|The host is encoded and may render as something familiar.
URL-003|high|14|T1566.002|Mixed-script or homoglyph hostname|Letters of several scripts in one host.
URL-004|high|15|T1566.002 T1656|Hostname is a lookalike of a known brand|One or two edits from a brand's domain.
URL-005|high|13|T1566.002|Link points at a bare IP address|No host name at all.
URL-006|medium|8||URL shortener conceals the destination|The destination is not visible.
URL-007|medium|7||High-abuse top-level domain|A top-level domain with much abuse.
URL-008|medium|9|T1598.003|Credential-harvest keywords in the URL path|Two or more sign-in words in the path.
URL-009|medium|9|T1566.002|Open-redirect style parameter|A parameter carries another absolute address.
URL-010|medium|10|T1656|Brand name buried in a long subdomain chain|A brand, or very many labels, before a foreign domain.
URL-011|low|5||Action link served over plain HTTP|A sign-in link without encryption.
URL-012|high|16|T1027.006|data: or javascript: URI in message body|Code or a document inside the link.
URL-013|high|14|T1566.002|Userinfo obfuscation in the URL authority|What stands before the @ is decoration.
ATT-001|critical|25|T1566.001 T1204.002|Directly executable attachment|Opening it runs a program.
ATT-002|critical|22|T1036.007 T1204.002|Double file extension|A harmless extension in front of a running one.
ATT-003|high|16|T1566.001 T1204.002|Macro-enabled Office document|A document format that can carry macros.
ATT-004|medium|8|T1566.001|Archive attachment|Content that scanners may not see.
ATT-005|medium|10||Declared content type contradicts the file extension|Type and name disagree.
ATT-006|critical|20|T1566.001|Password-protected archive with the password in the body|The key travels beside the locked file.
ATT-007|critical|22|T1566.001 T1204.002|Script attachment|An interpreter would run it.
ATT-008|critical|24|T1036.002|Right-to-left override in the filename|The shown name is reversed.
ATT-009|high|15|T1027.006 T1566.001|HTML attachment|A page that opens outside the mail filter.
ATT-010|high|17|T1553.005 T1566.001|Disk-image or container attachment|Files inside lose their download mark.
ATT-011|critical|21|T1204.002|Windows shortcut attachment|It can start any program with any arguments.
CNT-001|low|6||Urgency and time pressure|Wording that hurries the reader.
CNT-002|medium|9|T1598.003|Credential-harvest phrasing|Wording that asks for a sign-in or password.
CNT-003|high|12|T1656|Payment or wire-transfer request|Two or more terms of a money instruction.
CNT-004|high|13||Hidden text in the HTML body|Text that is there but not shown.
CNT-005|medium|10||Zero-width or invisible characters|Characters that break words without showing.
CNT-006|critical|20|T1598.003|Credential form embedded in the message body|The mail itself asks for secrets.
CNT-007|medium|9||Body is essentially a single image|A picture and hardly any text.
CNT-008|medium|11||Plain-text and HTML parts disagree|The two versions say different things.
CNT-009|info|3||Generic salutation|No name in the greeting.
CNT-010|medium|8||Threatened consequence|Loss or legal action as a lever.
CNT-011|medium|9|T1656|Reply solicitation with no links or attachments|Short, without payload, asks for an answer.
CNT-012|high|12|T1656|Requests secrecy or bypassing normal process|Asks to keep quiet or to skip a step.
"""

SCHEMA = "id string, name string, category string, severity string, weight int, description string, attack array<string>"


def _parse(line: str) -> tuple:
    key, severity, weight, attack, name, meaning = line.split("|")
    if not 0 <= int(weight) <= 40 or severity not in SEVERITY_RANK:
        raise ValueError(f"{key}: weights are 0 to 40 and severities {list(SEVERITY_RANK)}")
    return key, name, _BAND[key.split("-")[0]], severity, int(weight), meaning, attack.split()


INDICATORS = tuple(_parse(x) for x in _ROWS.strip().splitlines())
BY_ID = {x[0]: x for x in INDICATORS}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INDICATORS), SCHEMA).withColumn("severity_rank", F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))[F.col("severity")])


def stats(spark: SparkSession) -> DataFrame:
    """Rules, weight and critical rules of each category."""
    return catalog(spark).groupBy("category").agg(F.count("*").alias("rules"), F.sum("weight").alias("weight"), F.sum((F.col("severity") == "critical").cast("int")).alias("critical"))


def listing(fmt: str = "table") -> str:
    """The catalogue as `table`, `json` or `markdown` text."""
    if fmt == "json":
        names = [f.split()[0] for f in SCHEMA.replace("array<string>", "array").split(", ")]
        return json.dumps([dict(zip(names, x, strict=True)) for x in INDICATORS], indent=2, ensure_ascii=False)
    if fmt == "markdown":
        parts = []
        for category, title in CATEGORIES.items():
            rows = [f"| {i} | {n} | {s} | {w} | {', '.join(a) or '-'} |" for i, n, c, s, w, _, a in INDICATORS if c == category]
            parts.append("\n".join([f"## {title}", "", "| ID | Name | Severity | Weight | ATT&CK |", "|-|-|-|-|-|", *rows]))
        return "\n\n".join(parts) + "\n"
    return "\n".join(f"{i:9} {s:9} {w:3}  {n}" for i, n, _, s, w, _, _ in INDICATORS)
