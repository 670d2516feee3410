"""Registered queries of the triage engine and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postern import catalog as cat
from postern import intel
from postern.functions import domains, scripts, text
from postern.operators import parse, report, rules, scoring
from postern.plans import judged
from postern.plans import synthetic as syn
from postern.plans.synthetic import pick, sql_pick, table
from postern.streaming import state
from postern.triage import triage

ORG = ("example-corp.com",)


def _q(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_CATALOG_SQL = "(VALUES " + ", ".join(f"('{i}', '{c}', '{s}', {intel.SEVERITY_RANK[s]}, {w}, [{_q(a)}]::VARCHAR[])" for i, _, c, s, w, _, a in cat.INDICATORS) + ") AS c(id, category, severity, severity_rank, weight, attack)"
_SCORED_SQL = f"""
f AS ({syn.FINDINGS_SQL}), m AS ({syn.MESSAGES_SQL}),
j AS (SELECT f.*, c.* FROM f JOIN {_CATALOG_SQL} ON f.indicator_id = c.id),
b AS (SELECT msg_id, bool_or(category = 'authentication' AND id NOT IN ('AUTH-004', 'AUTH-008')) AS bad FROM j GROUP BY 1),
w AS (SELECT j.*, bad, CASE WHEN category = 'content' AND NOT bad THEN CAST(round(weight * 0.4) AS INT) ELSE weight END AS own FROM j JOIN b USING (msg_id)),
s AS (SELECT m.msg_id, CAST(coalesce(sum(own), 0) AS INT) AS raw_weight, CAST(coalesce(sum(weight - own), 0) AS INT) AS discount, CAST(count(DISTINCT category) AS INT) AS n_categories, NOT coalesce(bool_or(bad), false) AS authentication_clean,
      CAST(count(id) AS INT) AS finding_count, coalesce(bool_or(severity = 'critical'), false) AS critical FROM m LEFT JOIN w USING (msg_id) GROUP BY 1),
t AS (SELECT *, CAST(least(100, raw_weight + [0, 0, 3, 8, 14, 20][n_categories + 1]) AS INT) AS score FROM s),
r AS (SELECT *, CASE WHEN score >= 75 THEN 'Malicious' WHEN score >= 45 THEN 'Likely Phishing' WHEN critical THEN 'Likely Phishing' WHEN score >= 20 THEN 'Suspicious' ELSE 'Benign' END AS verdict, critical AND score < 45 AS critical_floor_applied FROM t)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_table(syn.message_ids(spark, sf_dir), syn.findings(spark, sf_dir))


def score_verdict(spark, sf):
    b = F.col("breakdown")
    return _scored(spark, sf).select("msg_id", "score", "verdict", b["raw_weight"].alias("raw_weight"), b["discount"].alias("discount"), F.size(b["categories"]).alias("n_categories"), b["authentication_clean"].alias("authentication_clean"), b["finding_count"].alias("finding_count"), b["critical_floor_applied"].alias("critical_floor_applied"))


def explain_lines(spark, sf):
    return _scored(spark, sf).select("msg_id", text.explain(F.col("verdict"), F.col("score"), F.col("breakdown")).alias("line"))


def attack_techniques(spark, sf):
    return _scored(spark, sf).select("msg_id", F.array_join("attack_techniques", ",").alias("techniques"))


def verdict_counts(spark, sf):
    return _scored(spark, sf).groupBy("verdict").agg(F.count("*").alias("messages"), F.max("score").alias("worst"), F.max(scoring.verdict_rank(F.col("verdict"))).alias("rank"))


def ranked_top(spark, sf):
    """The twenty worst messages (a top-k report), with their five first indicators."""
    order = F.struct((-F.col("severity_rank")).alias("s"), (-F.col("weight")).alias("w"), F.col("id"))
    found = syn.findings(spark, sf).join(F.broadcast(cat.catalog(spark)), F.col("indicator_id") == F.col("id"))
    top = found.groupBy("msg_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]), 1, 5), ",").alias("top_indicators"))
    worst = _scored(spark, sf).select("msg_id", "score", "verdict").orderBy(F.desc("score"), "msg_id").limit(20)
    return worst.join(top, "msg_id", "left")


def findings_by_category(spark, sf):
    found = syn.findings(spark, sf).join(F.broadcast(cat.catalog(spark)), F.col("indicator_id") == F.col("id"))
    order = F.struct((-F.col("severity_rank")).alias("s"), (-F.col("weight")).alias("w"), F.col("id"))
    return found.groupBy("msg_id", "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]), ",").alias("ids"))


def catalogue(spark, sf):
    return cat.catalog(spark).select("id", "category", "severity", "severity_rank", "weight", F.array_join("attack", ",").alias("attack"))


def catalogue_stats(spark, sf):
    return cat.stats(spark)


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def hop_delay(spark, sf):
    """Hops newest first: the delay to the next older one, and the first that is out of range."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.row_number().over(w).alias("hop"), (_micros() - F.lead(_micros()).over(w)).alias("delay_us"))
    odd = F.col("delay_us") > intel.MAX_HOP_SECONDS * 1000000
    return e.groupBy("user_id").agg(F.count("*").alias("hops"), F.sum("delay_us").alias("total_us"), F.min(F.when(odd, F.col("hop"))).cast("long").alias("first_odd"))


def url_parts(spark, sf):
    """Host parts of every page's address, each distinct host split once."""
    p = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)).alias("host"))
    hosts = p.select("host").distinct().select("host", domains.split_udf()(F.col("host")).alias("h"))
    return p.join(hosts, "host").select("page_id", "host", F.col("h.subdomain").alias("subdomain"), F.col("h.domain").alias("label"), F.col("h.suffix").alias("suffix"), F.col("h.registered").alias("registered_domain"))


def host_abuse(spark, sf):
    """Pages of hosts with a high-abuse ending, a shortener, or a brand outside its own domains."""
    u = url_parts(spark, sf)
    brand = rules.brand_in(F.col("subdomain"))["name"]
    return u.select("page_id", F.substring_index("suffix", ".", -1).isin(intel.HIGH_ABUSE_TLDS).alias("abuse_tld"), F.col("registered_domain").isin(intel.URL_SHORTENERS).alias("shortener"), F.coalesce(brand, F.lit("")).alias("brand"))


def defang(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.defang_url(url).alias("inert"), text.refang(text.defang_url(url)).alias("live"), text.defang_email(F.concat(F.lit("a.b@"), F.regexp_extract(url, "://([^/]+)", 1))).alias("email"))


def defang_prose(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(scripts.arrow(scripts.defang_text, "string")(F.col("text")), 256).alias("inert_sha256"))


def email_iocs(spark, sf):
    hits = table(spark, sf, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(text.addresses(F.col("text"))).alias("value"))
    return hits.groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def ipv4_iocs(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), 0)
    hits = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("ip"))
    return hits.select("ip", "doc_id", domains.is_ipv4(F.col("ip")).alias("valid"), text.defang_ip(F.col("ip")).alias("inert")).groupBy("ip", "valid", "inert").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"))


def html_text(spark, sf):
    t = text.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


def lookalike(spark, sf):
    label = F.concat(pick(["micros0ft", "paypa1", "netfliix", "amazom", "example", "googl", "dropbox", "linkedln", "faceb00k"], F.col("c_custkey")), F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(""))
    best = rules.lookalike(F.col("label"))
    return table(spark, sf, "customer").select("c_custkey", label.alias("label")).select("c_custkey", "label", F.coalesce(best["distance"], F.lit(0)).alias("distance"), F.coalesce(best["brand"], F.lit("")).alias("brand"))


_NAMES = ["Microsoft Support", "Your Apple ID", "first class groups", "PayPal or Google", "Ann Example", "netflixbilling team", "USPS parcel"]


def brand_substring(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", pick(_NAMES, F.col("s_suppkey")).alias("display")).select("s_suppkey", "display", rules.brand_in(F.col("display"))["name"].alias("brand"))


_PATHS = ["/account/login?next=/", "/Verify/Billing/update", "/news/2026/item", "/sign-in/token", "/a/b/c.html?session=1&otp=2"]


def path_terms(spark, sf):
    path = pick(_PATHS, F.col("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(rules.credential_terms(path), ",").alias("terms"))


def lexicon_hits(spark, sf):
    body = F.concat_ws(" ", pick(syn.PHRASES, F.col("doc_id")), F.col("lang"), pick(syn.PHRASES, F.col("doc_id") / 3), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *(F.array_join(F.array_sort(text.lexicon_hits(n, body)), ",").alias(n) for n in ("urgency", "credentials", "financial", "threat", "secrecy", "salutation")))


def auth_worst(spark, sf):
    a = rules.auth_results(pick(syn.AUTH, F.col("o_orderkey") / 2))
    return table(spark, sf, "orders").select("o_orderkey", a["spf"].alias("spf"), a["dkim"].alias("dkim"), a["dmarc"].alias("dmarc"))


def part_similarity(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.left("text", F.lit(intel.SIMILARITY_CHARS))).alias("t"))
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.round(text.similarity(F.col("a.t"), F.col("b.t")) * 1000).cast("long").alias("per_mille"))


def attachment_class(spark, sf):
    name = F.concat(F.col("p_name"), F.lit("."), pick(syn.ENDINGS, F.col("p_partkey")))
    p = table(spark, sf, "part").select("p_partkey", name.alias("name"), pick(syn.MIMES, F.col("p_partkey") / 3).alias("declared"))
    ext = text.extension(F.col("name"))
    return p.select("p_partkey", ext.alias("ext"), rules.attachment_class(ext)["rule"].alias("rule"), rules.double_extension(F.col("name"))["real"].alias("runs_as"), rules.mime_mismatch(ext, F.col("declared")).isNotNull().alias("mismatch"))


def hashes(spark, sf):
    b = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def invisible_chars(spark, sf):
    """Words broken by invisible characters: counts, and the text that rules read."""
    head = F.concat(F.lit("ur\u200bg\u00adent "), F.when(F.col("doc_id") % 2 == 0, "\u202eabc\u200b").otherwise("plain"))
    t = F.concat(head, F.col("text"))
    found = text.find_invisible(t)
    return table(spark, sf, "documents").select("doc_id", F.aggregate(found, F.lit(0), lambda s, x: s + x["count"]).cast("long").alias("total"), found[0]["codepoint"].alias("most"), F.length(text.strip_invisible(t)).cast("long").alias("kept"))


def script_classes(spark, sf):
    """How many documents hold letters of each script."""
    held = scripts.arrow(lambda t: sorted(scripts.scripts_in(t)), "array<string>")
    return table(spark, sf, "documents").select(F.explode(held(F.col("text"))).alias("script")).groupBy("script").count()


def source_labels(spark, sf):
    name = F.concat(F.lit("C:\\mail\\"), F.lit("<"), F.col("p_name"), F.lit(">?/"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.col("p_name"), F.lit("|.eml"))))
    return table(spark, sf, "part").select("p_partkey", text.source_label(name).alias("label"))


def address_domains(spark, sf):
    a = pick(_ADDRESSES, F.col("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", domains.address_domain(a).alias("domain"))


def offered_load(spark, sf):
    """Requests of each client in the minute before each request, itself included (what is offered, not what is let in)."""
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-59, 0)
    return table(spark, sf, "events").select("event_id", "user_id", F.floor(_micros() / 1000000).alias("s")).withColumn("load", F.count("*").over(w)).select("event_id", "load")


def rate_limit(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").cast("long").alias("request"), (_micros() / 1e6).alias("at"))
    return state.rate_limit(e, limit=3, window=86400.0)


def html_facts(spark, sf):
    kind = "anchors int, links int, images int, hidden int, visible long, forms boolean, inputs int, sources int"

    @F.pandas_udf(kind)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            found = [parse.harvest(h or "") for h in pages]
            yield pd.DataFrame([(len(f.anchors), sum(bool(a["href"]) for a in f.anchors), f.image_count, len(f.hidden_text), f.visible_text_len, f.has_form, len(f.input_types), len(f.sources)) for f in found], columns=[c.split()[0] for c in kind.split(", ")])

    return table(spark, sf, "pages").select("page_id", facts(F.col("html")).alias("f")).select("page_id", "f.*")


def _reports(spark, sf) -> DataFrame:
    return triage(syn.mail(spark, sf), ORG)


def full_triage(spark, sf):
    b = F.col("breakdown")
    return _reports(spark, sf).select("source", "ord", "score", "verdict", F.array_join(F.transform("findings", lambda f: f["indicator_id"]), ",").alias("indicators"), b["raw_weight"].alias("raw_weight"), b["discount"].alias("discount"), F.array_join("attack_techniques", ",").alias("techniques"), F.col("error"))


def triage_iocs(spark, sf):
    return report.iocs(parse.parse(syn.mail(spark, sf))).select("source", "type", "value", "pos")


def merged_iocs(spark, sf):
    return report.merged_in_order(report.iocs(parse.parse(syn.mail(spark, sf))))


def summary_report(spark, sf):
    return report.summary(_reports(spark, sf)).withColumns({"top_indicators": F.array_join("top_indicators", ","), "attack": F.array_join("attack", ",")})


def json_report(spark, sf):
    return report.rendered(_reports(spark, sf), "json", "2026-01-01T00:00:00+00:00").select("source", F.get_json_object("report", "$.verdict.label").alias("label"), F.length("report").alias("n_chars"))


_RULES_SQL = "CASE " + " ".join(f"WHEN ext IN ({_q(es)}) THEN '{r}'" for r, _, es in intel.CLASSES) + " END"
_MIME_SQL = " OR ".join(f"(ext = '{e}' AND declared NOT IN ({_q(ts)}))" for e, ts in intel.EXPECTED_MIME.items())
_NEAR = [(k, n, ds[0].split(".")[0]) for k, (n, ds) in enumerate(intel.BRANDS.items()) if len(ds[0].split(".")[0]) >= intel.LOOKALIKE_LENGTH]
_BRANDS_SQL = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(intel.BRANDS)) + ") AS b(ord, brand)"


def _lexicon_sql(name: str) -> str:
    """The phrases that stand in `body` as words: found plainly first, then by their borders."""
    quote = judged.quoted
    border = lambda t: rf"(?i)(^|[^\pL\pN_]){re.sub(r'([^\w\s])', r'\\\1', t)}($|[^\pL\pN_])"
    told = ", ".join(f"CASE WHEN contains(low, {quote(t)}) AND regexp_matches(body, {quote(border(t))}) THEN {quote(t)} END" for t in intel.LEXICONS[name])
    return f"array_to_string(list_sort(list_filter([{told}], lambda t: t IS NOT NULL)), ',') AS {name}"


_MARKS = "[" + ", ".join(f"chr({c})" for c in intel.INVISIBLE) + "]"
_MARK_NAMES = "[" + ", ".join(f"'U+{c:04X}'" for c in intel.INVISIBLE) + "]"
_ADDRESSES = ["Ann@Example.ORG", "no address", "x@a@b.example>", "", "tail@ Space.Example "]
_LABELS = ["micros0ft", "paypa1", "netfliix", "amazom", "example", "googl", "dropbox", "linkedln", "faceb00k"]
_MECH = ("spf", "dkim", "dmarc")
_AUTH_RE = r"\b(spf|dkim|dmarc)\s*=\s*(pass|fail|softfail|neutral|none|temperror|permerror|policy|bestguesspass)"


_HOSTS_SQL = r"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages), s AS (SELECT *, string_split(host, '.') AS l FROM h)"
_INERT_SQL = "replace(replace(replace(replace(v, 'https://', 'hxxps[://]'), 'http://', 'hxxp[://]'), '.', '[.]'), '@', '[@]')"


def _iocs_sql() -> str:
    """Observables of the synthesised mail: its one link, the link's domain, the sender's domain and the first relay's address."""
    link = f"regexp_extract({sql_pick(syn.LINKS, 'floor(c_custkey / 2)')}, '(?:href|src)=\"([^\"]+)\"', 1)"
    host = "regexp_extract(url, '://([^/]+)', 1)"
    domain = f"CASE WHEN regexp_full_match({host}, '[0-9.]+') THEN '' ELSE regexp_extract({host}, '([^.]+\\.[^.]+)$', 1) END"
    rows = f"[{{'k': 1, 'type': 'url', 'v': url}}, {{'k': 2, 'type': 'domain', 'v': {domain}}}, {{'k': 3, 'type': 'sender-domain', 'v': {sql_pick(syn.SENDERS, 'c_custkey')}}}, {{'k': 4, 'type': 'ip-src', 'v': '192.0.2.1'}}]"
    return f"WITH m AS (SELECT c_custkey, {link} AS url FROM customer), i AS (SELECT 'customer-' || c_custkey AS source, c_custkey AS ord, unnest({rows}, recursive := true) FROM m), p AS (SELECT source, ord, type, {_INERT_SQL} AS value, CAST(row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS INT) AS pos FROM i WHERE v <> '')"


_IOCS_SQL = _iocs_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (score_verdict, explain_lines, attack_techniques, verdict_counts, ranked_top, findings_by_category, catalogue, catalogue_stats, hop_delay, url_parts, host_abuse, defang, defang_prose, email_iocs, ipv4_iocs, html_text, lookalike, brand_substring, path_terms, lexicon_hits, auth_worst, part_similarity, attachment_class, hashes, invisible_chars, script_classes, source_labels, address_domains, offered_load, rate_limit, html_facts, full_triage, triage_iocs, merged_iocs, summary_report, json_report)
    return {f.__name__: f for f in own} | judged.queries()


def oracle_sql() -> dict[str, str]:
    return judged.oracle_sql() | {
        "score_verdict": f"WITH {_SCORED_SQL} SELECT msg_id, score, verdict, raw_weight, discount, n_categories, authentication_clean, finding_count, critical_floor_applied FROM r",
        "explain_lines": f"WITH {_SCORED_SQL} SELECT msg_id, verdict || ' - score ' || score || '/100 (' || finding_count || ' indicator(s) across ' || n_categories || ' category(ies); weight ' || raw_weight || CASE WHEN [0, 0, 3, 8, 14, 20][n_categories + 1] > 0 THEN '; +' || [0, 0, 3, 8, 14, 20][n_categories + 1] || ' corroboration' ELSE '' END || CASE WHEN discount <> 0 THEN '; -' || discount || ' discounted (sender authenticated cleanly)' ELSE '' END || CASE WHEN critical_floor_applied THEN '; floored by a critical indicator' ELSE '' END || ')' AS line FROM r",
        "attack_techniques": f"WITH {_SCORED_SQL}, a AS (SELECT DISTINCT msg_id, unnest(attack) AS t FROM j) SELECT m.msg_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS techniques FROM m LEFT JOIN a USING (msg_id) GROUP BY 1",
        "verdict_counts": f"WITH {_SCORED_SQL} SELECT verdict, count(*) AS messages, max(score) AS worst, CAST(list_position(['Benign', 'Suspicious', 'Likely Phishing', 'Malicious'], verdict) - 1 AS INT) AS rank FROM r GROUP BY verdict",
        "ranked_top": f"WITH {_SCORED_SQL}, x AS (SELECT msg_id, id, row_number() OVER (PARTITION BY msg_id ORDER BY severity_rank DESC, weight DESC, id) AS k FROM j), i AS (SELECT msg_id, string_agg(id, ',' ORDER BY k) AS top_indicators FROM x WHERE k <= 5 GROUP BY 1) SELECT r.msg_id, score, verdict, top_indicators FROM (SELECT * FROM r ORDER BY score DESC, msg_id LIMIT 20) r LEFT JOIN i USING (msg_id)",
        "findings_by_category": f"WITH {_SCORED_SQL} SELECT msg_id, category, count(*) AS n, string_agg(id, ',' ORDER BY severity_rank DESC, weight DESC, id) AS ids FROM j GROUP BY 1, 2",
        "catalogue": f"SELECT id, category, severity, severity_rank, weight, array_to_string(attack, ',') AS attack FROM {_CATALOG_SQL}",
        "catalogue_stats": f"SELECT category, count(*) AS rules, CAST(sum(weight) AS BIGINT) AS weight, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical FROM {_CATALOG_SQL} GROUP BY 1",
        "hop_delay": f"WITH e AS (SELECT user_id, row_number() OVER w AS hop, epoch_us(ts) - lead(epoch_us(ts)) OVER w AS delay_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) SELECT user_id, count(*) AS hops, CAST(sum(delay_us) AS BIGINT) AS total_us, min(hop) FILTER (delay_us > {intel.MAX_HOP_SECONDS * 1000000}) AS first_odd FROM e GROUP BY 1",
        "url_parts": _HOSTS_SQL + r" SELECT page_id, host, array_to_string(l[1 : len(l) - 2], '.') AS subdomain, l[len(l) - 1] AS label, l[len(l)] AS suffix, l[len(l) - 1] || '.' || l[len(l)] AS registered_domain FROM s",
        "defang": r"WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) SELECT page_id, replace(replace(regexp_replace(regexp_replace(url, '(?i)https://', 'hxxps[://]', 'g'), '(?i)http://', 'hxxp[://]', 'g'), '.', '[.]'), '@', '[@]') AS inert, url AS live, replace('a.b', '.', '.') || '[@]' || replace(host, '.', '[.]') AS email FROM p",
        "email_iocs": r"WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pM\pN_.!#$%&''*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS v FROM documents) SELECT lower(v) AS value, count(*) AS n, min(doc_id) AS first_doc FROM h GROUP BY 1",
        "ipv4_iocs": r"WITH h AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS ip FROM documents) SELECT ip, regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') AS valid, replace(ip, '.', '[.]') AS inert, min(doc_id) AS first_doc, count(*) AS docs FROM h GROUP BY ip",
        "html_text": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM t",
        "lookalike": f"WITH l AS (SELECT c_custkey, {sql_pick(_LABELS, 'c_custkey')} || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END AS label FROM customer), d AS (SELECT l.*, levenshtein(label, b.target) AS d, b.ord, b.brand FROM l, (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)}, {chr(39)}{t}{chr(39)})' for k, n, t in _NEAR)}) AS b(ord, brand, target)), n AS (SELECT c_custkey, min(d * 100 + ord) AS best FROM d WHERE d BETWEEN 1 AND 2 GROUP BY 1) SELECT l.c_custkey, label, CAST(coalesce(best // 100, 0) AS INT) AS distance, coalesce((SELECT brand FROM {_BRANDS_SQL} WHERE b.ord = best % 100), '') AS brand FROM l LEFT JOIN n USING (c_custkey)",
        "brand_substring": f"WITH s AS (SELECT s_suppkey, {sql_pick(_NAMES, 's_suppkey')} AS display FROM supplier) SELECT s_suppkey, display, (SELECT arg_min(brand, ord) FROM {_BRANDS_SQL} WHERE contains(lower(display), brand)) AS brand FROM s",
        "path_terms": f"SELECT o_orderkey, array_to_string(list_sort(list_filter([{_q(intel.CREDENTIAL_PATH_TERMS)}], lambda t: list_contains(regexp_split_to_array(lower({sql_pick(_PATHS, 'o_orderkey')}), '[^a-z0-9]+'), t))), ',') AS terms FROM orders",
        "lexicon_hits": f"WITH d AS (SELECT doc_id, concat_ws(' ', {sql_pick(syn.PHRASES, 'doc_id')}, lang, {sql_pick(syn.PHRASES, 'floor(doc_id / 3)')}, text) AS body FROM documents), l AS (SELECT *, lower(body) AS low FROM d) SELECT doc_id, {', '.join(_lexicon_sql(n) for n in ('urgency', 'credentials', 'financial', 'threat', 'secrecy', 'salutation'))} FROM l",
        "auth_worst": f"WITH o AS (SELECT o_orderkey, {sql_pick(syn.AUTH, 'floor(o_orderkey / 2)')} AS a FROM orders), m AS (SELECT a, regexp_extract_all(a, '{_AUTH_RE}', 1) AS ms, regexp_extract_all(a, '{_AUTH_RE}', 2) AS rs FROM (SELECT DISTINCT a FROM o)), u AS (SELECT a, ms[k] AS m, rs[k] AS r, k FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m)), w AS (SELECT a, m, arg_max(r, CASE r {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in intel.AUTH_RANK.items())} END * 1000 - k) AS r FROM u GROUP BY 1, 2) SELECT o_orderkey, {', '.join(f'(SELECT r FROM w WHERE w.a = o.a AND w.m = {chr(39)}{m}{chr(39)}) AS {m}' for m in _MECH)} FROM o",
        "part_similarity": f"WITH t AS (SELECT conv_id, turn, lower(left(text, {intel.SIMILARITY_CHARS})) AS t FROM conversations), c AS (SELECT conv_id, turn, ch, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(t, '')) AS ch FROM t) GROUP BY ALL), s AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.ch = b.ch GROUP BY 1, 2) SELECT x.conv_id, x.turn, CAST(round(CASE WHEN length(x.t) + length(y.t) = 0 THEN 1.0 ELSE 2.0 * coalesce(shared, 0) / (length(x.t) + length(y.t)) END::DOUBLE * 1000) AS BIGINT) AS per_mille FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN s ON s.conv_id = x.conv_id AND s.turn = x.turn",
        "attachment_class": f"WITH p AS (SELECT p_partkey, p_name || '.' || {sql_pick(syn.ENDINGS, 'p_partkey')} AS name, {sql_pick(syn.MIMES, 'floor(p_partkey / 3)')} AS declared FROM part), e AS (SELECT *, lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,8}})$', 1)) AS ext, lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,8}})\\s*\\.([A-Za-z0-9]{{1,8}})$', 1)) AS decoy FROM p) SELECT p_partkey, ext, {_RULES_SQL} AS rule, CASE WHEN decoy IN ({_q(intel.DECOY)}) AND ext IN ({_q(intel.EXECUTABLE + intel.SCRIPT)}) THEN ext END AS runs_as, declared <> 'application/octet-stream' AND ({_MIME_SQL}) AS mismatch FROM e",
        "hashes": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents",
        "invisible_chars": f"WITH d AS (SELECT doc_id, 'ur' || chr(8203) || 'g' || chr(173) || 'ent ' || CASE WHEN doc_id % 2 = 0 THEN chr(8238) || 'abc' || chr(8203) ELSE 'plain' END || text AS t FROM documents), c AS (SELECT doc_id, t, list_transform({_MARKS}, lambda m: length(t) - length(replace(t, m, ''))) AS n FROM d) SELECT doc_id, CAST(list_sum(n) AS BIGINT) AS total, {_MARK_NAMES}[list_position(n, list_max(n))] AS most, length(list_reduce(list_prepend(t, {_MARKS}), lambda x, m: replace(x, m, ''))) AS kept FROM c",
        "source_labels": r"""WITH n AS (SELECT p_partkey, 'C:\mail\<' || p_name || '>?/' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || '|.eml' END AS name FROM part), b AS (SELECT p_partkey, trim(regexp_replace(regexp_extract(name, '([^/\\]*)$', 1), '[<>:"|?*[:cntrl:]]', '', 'g')) AS base FROM n) SELECT p_partkey, CASE WHEN base = '' THEN 'message.eml' ELSE left(base, 120) END AS label FROM b""",
        "address_domains": f"WITH a AS (SELECT c_custkey, {sql_pick(_ADDRESSES, 'c_custkey')} AS a FROM customer) SELECT c_custkey, CASE WHEN contains(a, '@') THEN lower(rtrim(trim(list_last(string_split(a, '@'))), '>')) ELSE '' END AS domain FROM a",
        "host_abuse": _HOSTS_SQL + f", u AS (SELECT page_id, l[len(l)] AS suffix, l[len(l) - 1] || '.' || l[len(l)] AS registered, array_to_string(l[1 : len(l) - 2], '.') AS subdomain FROM s) SELECT page_id, suffix IN ({_q(intel.HIGH_ABUSE_TLDS)}) AS abuse_tld, registered IN ({_q(intel.URL_SHORTENERS)}) AS shortener, coalesce((SELECT arg_min(brand, ord) FROM {_BRANDS_SQL} WHERE contains(subdomain, brand)), '') AS brand FROM u",
        "triage_iocs": f"{_IOCS_SQL} SELECT source, type, value, pos FROM p",
        "merged_iocs": f"{_IOCS_SQL}, g AS (SELECT type, value, min(ord * 100 + pos) AS first FROM p GROUP BY 1, 2) SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY first, value) AS n FROM g",
        "offered_load": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS load FROM events",
    }
