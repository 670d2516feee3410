"""What leaves the engine: observables, JSON reports, summaries, HTML pages and text."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.catalog import BY_ID
from postern.functions.scripts import arrow, defang_address, defang_any, defang_text
from postern.functions.text import defang_domain, defang_email, defang_ip, defang_url
from postern.intel import CATEGORIES

SCHEMA_TAG = "postern/report/1.0"
#: Types of observables in the order in which they are listed.
TYPES = ("url", "domain", "sender-domain", "ip-src", "sha256")


def iocs(reports: DataFrame, defanged: bool = True) -> DataFrame:
    """source, ord, type, value, pos: each message's observables, distinct and sorted within their type."""
    lists = (
        F.transform("urls", lambda u: u["url"]),
        F.transform("urls", lambda u: u["registered_domain"]),
        F.array("from_domain"),
        F.transform("hops", lambda h: h["from_ip"]),
        F.transform("attachments", lambda a: a["sha256"]),
    )
    own = [F.array_sort(F.array_distinct(F.filter(x, lambda v: v != ""))) for x in lists]
    tagged = F.flatten(F.array(*(F.transform(x, _tag(k)) for k, x in enumerate(own))))
    flat = reports.select("source", "ord", F.posexplode(tagged).alias("pos", "i")).select("source", "ord", F.col("i.type").alias("type"), F.col("i.value").alias("value"), "pos")
    if not defanged:
        return flat
    v = F.col("value")
    return flat.withColumn("value", F.when(F.col("type") == "url", defang_url(v)).when(F.col("type").isin("domain", "sender-domain"), defang_domain(v)).when(F.col("type") == "ip-src", defang_ip(v)).otherwise(v))


def _tag(k: int):
    return lambda v: F.struct(F.lit(TYPES[k]).alias("type"), v.alias("value"))


def merged_iocs(found: DataFrame) -> DataFrame:
    """type, value once for a whole batch, in the order of first appearance (`ord`, `pos`)."""
    return found.groupBy("type", "value").agg(F.min(F.struct("ord", "pos")).alias("first"))


def summary(reports: DataFrame, defanged: bool = True) -> DataFrame:
    """The seven summary columns a message, in input order by `ord`."""
    subject = F.left("subject", F.lit(120))
    text = arrow(defang_text, "string")
    return reports.select("ord", "source", "verdict", "score", (text(subject) if defanged else subject).alias("subject"), (defang_email(F.col("from_address")) if defanged else F.col("from_address")).alias("from"), F.slice(F.transform("findings", lambda f: f["indicator_id"]), 1, 5).alias("top_indicators"), F.col("attack_techniques").alias("attack"))


def _finding(f: dict) -> dict:
    key, name, category, severity, weight, description, attack = BY_ID[f["indicator_id"]]
    return {"id": key, "name": name, "category": category, "severity": severity, "weight": weight, "description": description, "attack": attack, "evidence": f["evidence"], "detail": json.loads(f["detail"])}


def as_dict(row: dict, generated_at: str = "", defanged: bool = True, online: bool = False) -> dict:
    """A report of twelve sections from a row of scored messages (as Python values)."""
    same = lambda x: x
    dots = (lambda x: x.replace(".", "[.]")) if defanged else same
    prose = defang_text if defanged else same
    address = (lambda a: "[@]".join([a.rpartition("@")[0], dots(a.rpartition("@")[2])]) if "@" in a else dots(a)) if defanged else same
    ip = (lambda x: x.replace(":", "[:]") if ":" in x else dots(x)) if defanged else same
    url = defang_address if defanged else same
    message = {"subject": prose(row["subject"]), "from_display": row["from_display"], "from_address": address(row["from_address"]), "from_domain": dots(row["from_domain"]), "reply_to": address(row["reply_to"]), "return_path": dots(row["return_path"]), "to": [address(a) for a in row["to"]], "cc": [address(a) for a in row["cc"]], "date": row["date_header"], "message_id": row["message_id"], "size_bytes": row["raw_size"], "hop_count": len(row["hops"])}
    hops = [{"index": h["index"], "from_host": h["from_host"], "from_ip": ip(h["from_ip"]), "by_host": h["by_host"], "protocol": h["with_proto"], "timestamp": h["iso"], "delay_seconds": h["delay_seconds"]} for h in row["hops"]]
    found = [_finding(f) for f in row["findings"]]
    listed = [("url", sorted({u["url"] for u in row["urls"]}), url), ("domain", sorted({u["registered_domain"] for u in row["urls"]}), dots), ("sender-domain", [row["from_domain"]], dots), ("ip-src", sorted({h["from_ip"] for h in row["hops"]}), ip), ("sha256", sorted({a["sha256"] for a in row["attachments"]}), same)]
    return {
        "schema": SCHEMA_TAG,
        "generated_at": generated_at,
        "source": row["source"],
        "online_checks": online,
        "verdict": {"label": row["verdict"], "score": row["score"], "breakdown": row["breakdown"]},
        "message": message,
        "hops": hops,
        "findings": [defang_any(f) for f in found] if defanged else found,
        "attack_techniques": row["attack_techniques"],
        "attachments": [{k: a[k] for k in ("filename", "content_type", "size", "md5", "sha1", "sha256", "is_inline")} for a in row["attachments"]],
        "urls": [{"url": url(u["url"]), "scheme": u["scheme"], "host": dots(u["host"]), "registered_domain": dots(u["registered_domain"]), "path": prose(u["path"]), "source": u["source"], "anchor_text": prose(u["anchor_text"])} for u in row["urls"]],
        "iocs": [{"type": kind, "value": change(v)} for kind, values, change in listed for v in values if v],
    }


def _page(report: dict) -> str:
    """A self-contained page; everything from the message is escaped."""
    e = lambda x: html.escape(str(x), quote=True)
    v, m = report["verdict"], report["message"]
    sections = []
    for category, title in CATEGORIES.items():
        rows = "".join(f"<tr><td>{e(f['id'])}<td>{e(f['severity'])}<td>{e(f['weight'])}<td>{e(f['name'])}<br><small>{e(f['evidence'])}</small></tr>" for f in report["findings"] if f["category"] == category)
        if rows:
            sections.append(f"<h2>{e(title)}</h2><table>{rows}</table>")
    facts = "".join(f"<tr><th>{e(k)}<td>{e(', '.join(x) if isinstance(x, list) else x)}</tr>" for k, x in m.items())
    listed = "".join(f"<tr><td>{e(i['type'])}<td><code>{e(i['value'])}</code></tr>" for i in report["iocs"])
    return f'<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>{e(v["label"])}: {e(m["subject"])}</title><style>body{{font:15px sans-serif;max-width:60em;margin:2em auto}}td,th{{text-align:left;padding:.2em .6em;vertical-align:top}}</style><h1>{e(v["label"])} ({e(v["score"])}/100)</h1><table>{facts}</table>{"".join(sections)}<h2>Observables</h2><table>{listed}</table><p>{e(", ".join(report["attack_techniques"]) or "no techniques")}</html>'


def _line(report: dict) -> str:
    """A plain-text report: verdict with a bar, message, findings by category, observables, techniques."""
    v, m = report["verdict"], report["message"]
    filled = round(v["score"] * 40 / 100)
    out = [f"{v['label'].upper()}  {v['score']}/100  [{'#' * filled}{'.' * (40 - filled)}]", f"From     {m['from_display']} <{m['from_address']}>", f"Subject  {m['subject']}", f"To       {', '.join(m['to'][:4]) or '-'}"]
    for category, title in CATEGORIES.items():
        own = [f for f in report["findings"] if f["category"] == category]
        out += [f"-- {title}"] * bool(own) + [f"  {f['id']} {f['severity']:8} {f['weight']:3}  {f['evidence']}" for f in own]
    for kind, most in (("url", 15), ("domain", 15), ("ip-src", 10), ("sha256", 15)):
        out += [f"  {kind:13} {i['value']}" for i in [i for i in report["iocs"] if i["type"] == kind][:most]]
    return "\n".join([*out, "ATT&CK   " + (", ".join(report["attack_techniques"]) or "-")])


RENDERERS = {"json": lambda r: json.dumps(r, indent=2, ensure_ascii=False), "html": _page, "text": _line, "iocs": lambda r: json.dumps(r["iocs"], indent=2, ensure_ascii=False)}


def rendered(reports: DataFrame, fmt: str = "json", generated_at: str = "", defanged: bool = True) -> DataFrame:
    """source, ord, report: each report as text, made where its row is."""
    columns = ["source", "ord", "subject", "from_display", "from_address", "from_domain", "reply_to", "return_path", "to", "cc", "date_header", "message_id", "raw_size", "hops", "urls", "attachments", "findings", "score", "verdict", "breakdown", "attack_techniques"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [RENDERERS[fmt](as_dict(r, generated_at, defanged)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("ord"), pa.array(texts, pa.string())], ["source", "ord", "report"])

    return reports.select(*columns).mapInArrow(rows, "source string, ord long, report string")


def batch_table(reports: DataFrame) -> DataFrame:
    """File, verdict, score and top indicators, worst first."""
    top = F.array_join(F.slice(F.transform("findings", lambda f: f["indicator_id"]), 1, 5), ", ")
    return reports.select(F.regexp_extract("source", r"([^/\\]*)$", 1).alias("file"), "verdict", "score", F.when(top == "", "-").otherwise(top).alias("top_indicators"), "ord").orderBy(F.desc("score"), "ord").drop("ord")


#: Messages whose first appearances are numbered by one task.
NUMBERED = 10_000


def merged_in_order(found: DataFrame) -> DataFrame:
    """`merged_iocs` numbered within each type by first appearance: within runs of NUMBERED messages, and from where the runs before end."""
    placed = merged_iocs(found).withColumn("run", F.floor(F.col("first.ord") / NUMBERED))
    within = Window.partitionBy("type", "run").orderBy("first.ord", "first.pos", "value")
    # A row a type and run: small enough for one task a type.
    before = placed.groupBy("type", "run").count().select("type", "run", F.coalesce(F.sum("count").over(Window.partitionBy("type").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.withColumn("k", F.row_number().over(within)).join(before, ["type", "run"]).select("type", "value", (F.col("k") + F.col("before")).alias("n"))


def failures(reports: DataFrame) -> DataFrame:
    """source, ord, error of the messages that could not be parsed."""
    return reports.where("error is not null").select("source", "ord", "error")
