"""The 58 rules over synthesised messages, a query a category, and SQL that works out the same from the same fields.

The driver's tables hold no mail, so each customer gets a message whose fields vary with its key; every
field takes each of its values beside many combinations of the others. Spark nests the fields as parsed
messages are and asks the rules; the SQL states what each rule is about over the flat fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern import intel
from postern.functions import domains, text
from postern.operators import parse, rules
from postern.plans.synthetic import table

OWN = ("example-corp.com",)
#: Fields: name to (values, keys that share a value before the next one comes).
Fields = dict[str, tuple[list, int]]


def quoted(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(quoted, value)) + "]" + ("::VARCHAR[]" if not value else "")
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def literal(value) -> Column:
    return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value)


def flat(spark: SparkSession, sf: str, fields: Fields) -> DataFrame:
    k = F.col("c_custkey")
    chosen = (F.element_at(F.array(*map(literal, values)), (F.floor(k / every) % len(values)).cast("int") + 1).alias(name) for name, (values, every) in fields.items())
    return table(spark, sf, "customer").select("c_custkey", *chosen)


def flat_sql(fields: Fields) -> str:
    chosen = (f"([{', '.join(map(quoted, values))}])[CAST(c_custkey // {every} % {len(values)} AS INT) + 1] AS {name}" for name, (values, every) in fields.items())
    return "SELECT c_custkey, " + ", ".join(chosen) + " FROM customer"


def ids(found: list[Column], more: Column | None = None) -> Column:
    """The ids of the findings, sorted and joined."""
    every = F.array_compact(F.array(*(f["indicator_id"] for f in found)))
    every = F.concat(every, F.transform(more, lambda f: f["indicator_id"])) if more is not None else every
    return F.array_join(F.array_sort(every), ",").alias("ids")


def ids_sql(predicates: dict[str, str], more: str = "[]") -> str:
    every = ", ".join(f"CASE WHEN {p} THEN '{rule}' END" for rule, p in predicates.items())
    return f"array_to_string(list_sort(list_concat(list_filter([{every}], lambda x: x IS NOT NULL), {more})), ',') AS ids"


def listed(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def headers_of(**named: str) -> Column:
    """A header map of fields by header name; an empty field is an absent header."""
    every = F.create_map(*(x for name, field in named.items() for x in (F.lit(name.replace("_", "-")), F.array(F.col(field)))))
    return F.map_filter(every, lambda _, v: v[0] != "")


def judged(messages: DataFrame, analyzer: Callable[[rules.Org], list[Column]], more: Column | None = None) -> DataFrame:
    org = rules.Org(OWN)
    found = ids(analyzer(org), more)
    return org.holding(messages).select("c_custkey", found)


# ------------------------------------------------------------------ authentication

_PLACES = ["", "example.org", "mail.example.org", "bad.test"]
_OWNERS = ["", "example.org", "example.org", "bad.test"]
AUTH: Fields = {
    "told": (["", "mx; spf=pass; dkim=pass; dmarc=pass", "mx; spf=fail a; SPF=Pass; dkim=none", "mx; spf = softfail; dkim=fail; dmarc=fail", "dkim=neutral; dkim=temperror; spf=none", "nothing", "mx; spf=permerror; dkim=permerror; dmarc=permerror", "xspf=fail spf=neutral; dkim=policy; dmarc=bestguesspass"], 1),
    "received": (["", "Pass (ok)", "fail x", "SoftFail y", "bogus z"], 8),
    "signed": (["", "v=1; d=example.org"], 3),
    "sender": (["example.org", "other.example", ""], 2),
    "spf_domain": (_PLACES, 3),
    "spf_owner": (_OWNERS, 3),
    "dkim_domain": (_PLACES, 5),
    "dkim_owner": (_OWNERS, 5),
    "checked": ([True, False], 3),
    "policy": ([False, True], 4),
    "txt": ([[], ["v=spf1 +all"], ["v=spf1 -all"], ["V=SPF1 include:x all ", "v=spf1 ~all", "spf all", "v=spf1 all"]], 7),
}


def rules_authentication(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf, AUTH).withColumns({
        "headers": headers_of(authentication_results="told", received_spf="received", dkim_signature="signed"),
        "from_domain": F.col("sender"),
        "org": F.struct("sender", "spf_domain", F.col("spf_owner").alias("spf"), "dkim_domain", F.col("dkim_owner").alias("dkim")),
        "dns": F.struct("checked", F.col("policy").alias("has_dmarc"), "txt"),
    })
    return judged(rules.with_auth(f), rules.authentication, rules.dns_findings())


def _auth_sql() -> str:
    mechanism = "(?i)\\b(spf|dkim|dmarc)\\s*=\\s*(pass|fail|softfail|neutral|none|temperror|permerror|policy|bestguesspass)"
    rank = "CASE r " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in intel.AUTH_RANK.items()) + " END"
    known = lambda m, d: f"({m} = 'pass' AND {d}_domain <> '')"
    aligned = lambda m: f"({known(m, m)} AND {m}_owner = sender AND sender <> '')"
    has = "(told <> '' OR received <> '')"
    record = "lower(t) LIKE 'v=spf1%' AND regexp_matches(t, '[+]?all\\s*$') AND NOT regexp_matches(t, '[-~?]all\\s*$')"
    return f"""
WITH f AS ({flat_sql(AUTH)}), b AS (SELECT *, concat_ws(' ; ', nullif(told, ''), nullif(received, '')) AS blob FROM f),
m AS (SELECT blob, regexp_extract_all(blob, '{mechanism}', 1) AS ms, regexp_extract_all(blob, '{mechanism}', 2) AS rs FROM (SELECT DISTINCT blob FROM b)),
u AS (SELECT blob, lower(ms[k]) AS m, lower(rs[k]) AS r, k FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m)),
w AS (SELECT blob, m, arg_max(r, {rank} * 1000 - k) AS r FROM u GROUP BY 1, 2),
a AS (SELECT b.*, lower(regexp_extract(received, '^\\s*(\\S*)', 1)) AS word, (SELECT r FROM w WHERE w.blob = b.blob AND m = 'spf') AS spf0, coalesce((SELECT r FROM w WHERE w.blob = b.blob AND m = 'dkim'), '') AS dkim, coalesce((SELECT r FROM w WHERE w.blob = b.blob AND m = 'dmarc'), '') AS dmarc FROM b),
c AS (SELECT *, coalesce(spf0, CASE WHEN word IN {listed(rules._SPF_WORDS)} THEN word END, '') AS spf FROM a)
SELECT c_custkey, {ids_sql({
    "AUTH-001": f"{has} AND spf = 'fail'", "AUTH-002": f"{has} AND spf IN ('softfail', 'neutral', 'permerror')", "AUTH-003": f"{has} AND dkim IN ('fail', 'permerror')",
    "AUTH-004": f"{has} AND signed = '' AND dkim IN ('', 'none')", "AUTH-005": f"{has} AND dmarc IN ('fail', 'permerror')", "AUTH-006": f"NOT {has}",
    "AUTH-007": f"{has} AND sender <> '' AND ({known('spf', 'spf')} OR {known('dkim', 'dkim')}) AND NOT ({aligned('spf')} OR {aligned('dkim')})",
    "AUTH-008": f"{has} AND sender <> '' AND checked AND NOT policy",
}, f"CASE WHEN {has} AND sender <> '' THEN list_transform(list_filter(txt, lambda t: {record}), lambda t: 'AUTH-009') ELSE [] END")} FROM c"""  # fmt: skip


# ------------------------------------------------------------------ headers

HEADERS: Fields = {
    "display": (["", "Ann Example", "PayPal Service", "boss@bank.test", "Pat CFO", "first groups", "Accounts Payable", "IT  Help Microsoft", "hrx"], 1),
    "embedded": ([[], ["boss@bank.test"], ["a@example.org"], ["a@gmail.com", "x@other.test"]], 9),
    "sender": (["example.org", "gmail.com", "paypal.com", "", "example-corp.com"], 2),
    "reply": (["", "example.org", "mailinator.com", "gmail.com"], 3),
    "returned": (["", "example.org", "bounce.example.org", "other.test"], 5),
    "returned_owner": (["", "example.org", "example.org", "other.test"], 5),
    "mid": (["", "<1@example.org>", "garbage", "<2@relay.test>"], 4),
    "mid_domain": (["", "example.org", "", "relay.test"], 4),
    "mailer": (["", "PHPMailer 6", "Outlook"], 7),
    "agent": (["", "Bulk  Mail 2"], 11),
    "script": (["", "1:smtplib.py", "1:x.php"], 13),
    "n_hops": ([0, 1, 2, 3], 6),
    "delay0": ([None, 5.0, -30.0, -61.0, 21601.0, 21600.0, -60.0], 1),
    "delay1": ([21600.5, None, 1.0], 7),
    "epoch0": ([None, 1000000.0], 3),
    "epoch1": ([990000.0, None], 6),
    "date": (["", "Mon, 4 May"], 2),
    "date_epoch": ([None, 1000000.0, 1086400.0, 1086401.0, 903600.0], 4),
    "to": ([[], ["team@example-corp.com"], ["x@other.test", "y@a.test"]], 5),
    "cc": ([[], ["z@example-corp.com"]], 15),
    "delivered": (["", "me@example-corp.com"], 2),
    "original": (["", "z@q.test"], 4),
    "subject": (["", "Re: hello", "[EXTERNAL] note", "FW : x", "plain", "  aw:\tx", "regards: x", "re: [ Caution ] y"], 3),
    "answers": (["", "<x@y>"], 24),
    "thread": (["", "<y@z>"], 48),
}


def _owner(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def rules_headers(spark: SparkSession, sf: str) -> DataFrame:
    hop = lambda k: F.struct(F.lit(k).alias("index"), F.lit("").alias("raw"), F.col(f"delay{k}").alias("delay_seconds") if k < 2 else F.lit(7.0).alias("delay_seconds"), F.col(f"epoch{k}").alias("epoch") if k < 2 else F.lit(5.0).alias("epoch"), F.lit("").alias("iso"))
    embedded = F.transform("embedded", lambda a: F.struct(a.alias("address"), _owner(a).alias("registered")))
    f = flat(spark, sf, HEADERS).withColumns({
        "headers": headers_of(x_mailer="mailer", user_agent="agent", x_php_originating_script="script", delivered_to="delivered", x_original_to="original", in_reply_to="answers", references="thread"),
        "from_domain": F.col("sender"), "from_address": F.when(F.col("sender") == "", "").otherwise(F.concat(F.lit("a@"), "sender")), "from_display": F.col("display"), "reply_to": F.col("reply"), "return_path": F.col("returned"),
        "message_id": F.col("mid"), "date_header": F.col("date"), "hops": F.slice(F.array(hop(0), hop(1), hop(2)), F.lit(1), F.col("n_hops")),
        "org": F.struct("sender", F.col("reply").alias("reply_domain"), "reply", F.col("returned_owner").alias("return_path"), F.col("mid_domain").alias("message_id_domain"), F.col("mid_domain").alias("message_id"), embedded.alias("embedded")),
    })
    return judged(f, rules.headers)


_BRANDS_SQL = "(VALUES " + ", ".join(f"({k}, '{name}', {quoted(sorted({*ds, *rs}))})" for k, name, ds, rs in rules._BRANDS) + ") AS b(ord, brand, domains)"


def _headers_sql() -> str:
    own = "sender = 'example-corp.com'"
    named = "(display <> '' AND sender <> '')"
    hop = lambda k, test: f"(n_hops > {k} AND {test.replace('?', f'delay{k}')})"
    odd = f"(? < -60 OR ? > {intel.MAX_HOP_SECONDS})"
    newest = "CASE WHEN n_hops > 0 AND epoch0 IS NOT NULL THEN epoch0 WHEN n_hops > 1 AND epoch1 IS NOT NULL THEN epoch1 WHEN n_hops > 2 THEN 5.0 END"
    inside = "len(list_filter(list_concat(\"to\", cc), lambda a: a LIKE '%@example-corp.com')) > 0"
    bulk = " OR ".join(f"regexp_matches({x}, {quoted(intel.BULK_MAILER)})" for x in ("mailer", "agent", "script"))
    return f"""
WITH f AS ({flat_sql(HEADERS)}), d AS (SELECT f.*, CASE WHEN sender = '' THEN '' ELSE 'a@' || sender END AS address, (SELECT arg_min(domains, ord) FROM {_BRANDS_SQL} WHERE contains(lower(display), brand)) AS owned FROM f)
SELECT c_custkey, {ids_sql({
    "HDR-001": "sender <> '' AND reply <> '' AND reply <> sender", "HDR-002": "sender <> '' AND returned <> '' AND returned_owner <> sender",
    "HDR-003": f"{named} AND len(list_filter(embedded, lambda a: a <> address AND split_part(a, '@', 2) <> sender)) > 0",
    "HDR-004": f"{named} AND owned IS NOT NULL AND NOT list_contains(owned, sender) AND NOT {own}", "HDR-005": "mid_domain <> '' AND sender <> '' AND mid_domain <> sender",
    "HDR-006": "mid = '' OR mid_domain = ''", "HDR-007": bulk, "HDR-008": f"{hop(0, odd)} OR {hop(1, odd)}",
    "HDR-009": f"date <> '' AND abs(date_epoch - ({newest})) > {intel.MAX_SKEW_SECONDS}", "HDR-010": "n_hops <= 1",
    "HDR-011": f"len(\"to\") + len(cc) = 0 OR NOT ({inside}) AND (delivered <> '' OR original <> '')",
    "HDR-012": f"{named} AND sender IN {listed(intel.FREEMAIL_DOMAINS)} AND regexp_matches(lower(display), {quoted(intel.ROLE)})",
    "HDR-013": f"subject <> '' AND (regexp_matches(subject, {quoted(intel.EXTERNAL_BANNER)}) AND NOT {own} OR regexp_matches(subject, {quoted(intel.REPLY_PREFIX)}) AND answers = '' AND thread = '')",
})} FROM d"""  # fmt: skip


# ------------------------------------------------------------------ links

_LINKS = [
    ("https://example.org/news", "html-anchor", "news"), ("https://evil.top/a", "html-anchor", "paypal.com"), ("https://www.paypal.com/a", "html-anchor", "www.paypal.com"), ("http://xn--pypal-4ve.com/", "plain-text", ""),
    ("https://micros0ft.com/x", "html-anchor", "x"), ("https://microsoft.com/login/verify", "html-anchor", "x"), ("https://amazom.co.uk/", "plain-text", ""), ("http://192.0.2.9/account/update", "html-anchor", "here"),
    ("https://bit.ly/x", "plain-text", ""), ("https://shop.zip/", "plain-text", ""), ("https://a.test.xyz/login/verify?x=1", "html-anchor", "x"), ("https://good.example.com/go?NEXT=https%3A%2F%2Fevil.test", "html-anchor", "x"),
    ("https://good.example.com/go?next=home", "html-anchor", "x"), ("https://login.paypal.com.evil.org/", "html-anchor", "x"), ("https://a.b.c.d.example.net/", "plain-text", ""), ("https://a.b.c.paypal.com/", "plain-text", ""),
    ("http://example.net/secure/otp", "html-form", ""), ("http://example.net/plain", "html-form", ""), ("data:text/html,<b>", "html-src", ""), ("javascript:alert(1)", "html-anchor", "x"), ("ftp://user@example.net/", "plain-text", ""),
    ("https://paypal.com@evil.test/a@b", "html-anchor", "x"), ("https://team.example-corp.com.example.net/token/reset", "html-anchor", "x"), ("https://x.example-corp.com/login/verify", "html-anchor", "portal.example-corp.com"), ("https://pаypal.com/", "html-anchor", "а"),
]
_USED = ("source", "anchor_text", "registered_domain", "claimed_suffix", "claimed_domain", "host", "mixed", "label", "is_ip", "suffix", "subdomain", "path", "scheme", "authority", "redirect_key")
_KINDS = parse.URL


def _described() -> list[dict]:
    parser = parse.Parser(domains.load_rules())
    return [{"ord": k, **u} for k, u in enumerate(parser.url(*link[:2], link[2]) for link in _LINKS)]


def _link(u: dict) -> Column:
    kinds = {"string": "string", "int32": "int", "bool": "boolean"}
    marks = F.array(*(F.struct(*(F.lit(c[n]).alias(n) for n in ("char", "name", "script"))) for c in u["confusables"])).cast("array<struct<char:string,name:string,script:string>>")
    return F.struct(*((marks if f.name == "confusables" else F.lit(u[f.name]).cast(kinds[str(f.type)])).alias(f.name) for f in _KINDS))


LINKS: Fields = {"n": ([2, 1, 3, 0], 1), "first": (list(range(len(_LINKS))), 1), "second": (list(range(len(_LINKS))), 7), "third": ([18, 3, 24, 9, 1], 2)}


def rules_urls(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf, LINKS).withColumn("known", F.array(*map(_link, _described())))
    chosen = F.slice(F.array(*(F.element_at("known", F.col(c) + 1) for c in ("first", "second", "third"))), F.lit(1), F.col("n"))
    return judged(f.select("c_custkey", chosen.alias("urls")), rules.urls)


def _urls_sql() -> str:
    rows = ", ".join("(" + ", ".join([str(u["ord"]), str(len(u["confusables"])), *(quoted(u[c]) for c in _USED)]) + ")" for u in _described())
    near = ", ".join(f"({k}, {quoted(ds[0].split('.')[0])})" for k, _, ds, _ in rules._BRANDS if len(ds[0].split(".")[0]) >= intel.LOOKALIKE_LENGTH)
    legit = f"(registered_domain IN {listed(intel.LEGITIMATE_DOMAINS)} OR registered_domain = 'example-corp.com')"
    terms = f"len(list_filter({quoted(list(intel.CREDENTIAL_PATH_TERMS))}, lambda t: list_contains(regexp_split_to_array(lower(path), '[^a-z0-9]+'), t)))"
    fires = {
        "URL-001": "source = 'html-anchor' AND anchor_text <> '' AND registered_domain <> '' AND claimed_suffix <> '' AND claimed_domain <> '' AND claimed_domain <> registered_domain",
        "URL-002": "contains(host, 'xn--')", "URL-003": "mixed AND marks > 0",
        "URL-004": f"registered_domain <> '' AND NOT {legit} AND EXISTS (SELECT 1 FROM (VALUES {near}) AS x(k, target) WHERE levenshtein(label, target) BETWEEN 1 AND {intel.LOOKALIKE_DISTANCE})",
        "URL-005": "is_ip", "URL-006": f"registered_domain IN {listed(intel.URL_SHORTENERS)}", "URL-007": f"list_last(string_split(suffix, '.')) IN {listed(intel.HIGH_ABUSE_TLDS)}",
        "URL-008": f"NOT {legit} AND {terms} >= 2", "URL-009": "redirect_key IS NOT NULL",
        "URL-010": f"subdomain <> '' AND NOT {legit} AND (EXISTS (SELECT 1 FROM {_BRANDS_SQL} WHERE contains(lower(subdomain), brand)) OR len(string_split(subdomain, '.')) >= 4)",
        "URL-011": f"scheme = 'http' AND NOT is_ip AND {terms} > 0", "URL-012": "scheme IN ('data', 'javascript', 'vbscript')", "URL-013": "contains(authority, '@')",
    }
    told = ", ".join(f"CASE WHEN {p} THEN '{rule}' END" for rule, p in fires.items())
    return f"""
WITH u(ord, marks, {", ".join(_USED)}) AS (VALUES {rows}), r AS (SELECT ord, list_filter([{told}], lambda x: x IS NOT NULL) AS fired FROM u),
f AS ({flat_sql(LINKS)}), c AS (SELECT c_custkey, unnest(list_slice([first, second, third], 1, n)) AS ord FROM f), h AS (SELECT DISTINCT c_custkey, unnest(fired) AS id FROM c JOIN r USING (ord))
SELECT f.c_custkey, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM f LEFT JOIN h USING (c_custkey) GROUP BY 1"""


# ------------------------------------------------------------------ attachments

_FILES = ["invoice.pdf", "invoice.pdf.exe", "photo.jpg .scr", "setup.EXE", "run.js", "macro.docm", "disk.iso", "open.lnk", "page.html", "bundle.zip", "bundle.tar.gz", "notes.txt", "cod‮fdp.exe", "README", "a.b.c", "sheet.xlsx", "x.pdf.pdf", "old.doc", "tool.msi", "x.7z"]
FILES: Fields = {
    "n": ([1, 2, 0], 1), "first": (_FILES, 1), "second": (_FILES, 3), "kind1": (["application/pdf", "", "application/octet-stream", "text/plain", "application/zip", "image/png"], 2), "kind2": (["text/html", "application/x-msdownload"], 5),
    "words": (["the password is 123", "see the file", "PassCode is x", "passwordless"], 4), "subject": (["report", "password: y"], 16),
}


def rules_attachments(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, kind, k: F.struct(F.lit(k).alias("ord"), F.col(name).alias("filename"), F.col(kind).alias("content_type"), F.lit(1234).cast("long").alias("size"), *(F.lit("").alias(h) for h in ("md5", "sha1", "sha256")), F.lit(False).alias("is_inline"))
    f = flat(spark, sf, FILES)
    return judged(f.select("c_custkey", F.slice(F.array(one("first", "kind1", 0), one("second", "kind2", 1)), F.lit(1), F.col("n")).alias("attachments"), F.col("words").alias("body_text"), "subject"), rules.attachments)


def _attachments_sql() -> str:
    of_class = "CASE " + " ".join(f"WHEN ext IN {listed(es)} THEN '{rule}'" for rule, _, es in intel.CLASSES) + " END"
    expected = " OR ".join(f"(ext = '{e}' AND kind NOT IN {listed(ts)})" for e, ts in intel.EXPECTED_MIME.items())
    locked = f"ext IN {listed(intel.ARCHIVE)} AND hits > 0"
    fires = {
        "ATT-008": "contains(name, chr(8238))", "ATT-002": f"decoy IN {listed(intel.DECOY)} AND ext2 IN {listed([*intel.EXECUTABLE, *intel.SCRIPT])}",
        "ATT-005": f"kind <> '' AND kind <> 'application/octet-stream' AND ({expected})", "ATT-006": locked,
    }
    told = ", ".join([of_class, *(f"CASE WHEN {p} THEN '{rule}' END" for rule, p in fires.items())])
    return f"""
WITH f AS (SELECT *, {terms_sql("archive_password", "words || chr(10) || subject")} AS hits FROM ({flat_sql(FILES)})),
a AS (SELECT c_custkey, hits, unnest(list_slice([first, second], 1, n)) AS name, unnest(list_slice([kind1, kind2], 1, n)) AS kind FROM f),
e AS (SELECT *, lower(regexp_extract(trim(name), '\\.([A-Za-z0-9]{{1,8}})$', 1)) AS ext, lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,8}})\\s*\\.([A-Za-z0-9]{{1,8}})$', 1)) AS decoy, lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,8}})\\s*\\.([A-Za-z0-9]{{1,8}})$', 2)) AS ext2 FROM a),
h AS (SELECT DISTINCT c_custkey, unnest(list_filter([{told}], lambda x: x IS NOT NULL)) AS id FROM e)
SELECT f.c_custkey, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM f LEFT JOIN h USING (c_custkey) GROUP BY 1"""


def terms_sql(name: str, body: str) -> str:
    """How many phrases of a lexicon stand in a text as words."""
    escaped = (re.sub(r"([^\w\s])", r"\\\1", t) for t in intel.LEXICONS[name])
    return "(" + " + ".join(f"CAST(regexp_matches({body}, {quoted(rf'(?i)(^|[^\pL\pN_]){t}($|[^\pL\pN_])')}) AS INT)" for t in escaped) + ")"


# ------------------------------------------------------------------ content

_LONG = "The committee met on Tuesday and agreed on the plan for the autumn, with thanks to all who came to help."
CONTENT: Fields = {
    "subject": (["Minutes", "Act now"], 1),
    "opening": (["", "Dear customer,", "Hello Ann,", "dear customers"], 2),
    "ask": (["", "verify your account", "a wire transfer", "a wire transfer with the IBAN", "it will be closed", "keep this confidential", "urgently"], 1),
    "odd": (["", "​​​​⁠", "​­", "‮​‍﻿­"], 3),
    "rest": (["", _LONG, "Are you available today? Let me know when you are back.", "zzzz qqqq xxxx " * 8], 7),
    "html": (["", _LONG, "11111 22222 33333 44444 " * 5, "short"], 5),
    "has_form": ([False, True], 2),
    "inputs": ([[], ["text"], ["password", "name:pwd"], ["text", "name:shipping"]], 4),
    "hidden": ([[], ["hidden words"], ["hidden words of some length", "and some more of them"]], 6),
    "images": ([0, 1, 3], 2),
    "shown": ([0, 119, 120, 500], 3),
    "n_urls": ([0, 1], 11),
    "n_files": ([0, 0, 1], 13),
}


def rules_content(spark: SparkSession, sf: str) -> DataFrame:
    f = flat(spark, sf, CONTENT).withColumns({
        "body_text": F.concat("opening", F.lit(" "), "ask", F.lit(" "), "odd", F.lit(" "), "rest"), "body_html": F.col("html"), "html_as_text": text.html_to_text(F.col("html")),
        "urls": F.array_repeat(F.lit(1), F.col("n_urls")), "attachments": F.array_repeat(F.lit(1), F.col("n_files")),
        "html_facts": F.struct("has_form", F.col("inputs").alias("input_types"), F.array().cast("array<string>").alias("form_actions"), F.col("hidden").alias("hidden_text"), F.col("images").alias("image_count"), F.col("shown").alias("visible_text_len")),
    })
    f = f.withColumn("raw_body", F.concat_ws("\n", "subject", "body_text", "html_as_text")).withColumn("body", text.strip_invisible(F.col("raw_body")))
    plain = F.lower(text.collapse(F.col("body_text")))
    f = f.withColumn("part_similarity", F.when((F.length(plain) >= 80) & (F.length("html_as_text") >= 80), text.similarity(plain, F.lower("html_as_text"))))
    return judged(f, rules.content)


def _content_sql() -> str:
    marks = "[" + ", ".join(f"chr({c})" for c in intel.INVISIBLE) + "]"
    count = lambda t, c: f"length({t}) - length(replace({t}, {c}, ''))"
    shared = f"list_sum(list_transform(list_distinct(string_split(plain, '')), lambda c: least({count('plain', 'c')}, {count('page', 'c')})))"
    phrases = {"CNT-001": ("urgency", 1), "CNT-002": ("credentials", 1), "CNT-003": ("financial", 2), "CNT-010": ("threat", 1), "CNT-012": ("secrecy", 1), "CNT-009": ("salutation", 1)}
    return f"""
WITH f AS (SELECT *, opening || ' ' || ask || ' ' || odd || ' ' || rest AS body_text, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS as_text FROM ({flat_sql(CONTENT)})),
r AS (SELECT *, subject || chr(10) || body_text || chr(10) || as_text AS raw, lower(trim(regexp_replace(body_text, '\\s+', ' ', 'g'))) AS plain, lower(as_text) AS page FROM f),
d AS (SELECT *, list_reduce(list_prepend(raw, {marks}), lambda t, c: replace(t, c, '')) AS body, list_sum(list_transform({marks}, lambda c: {count("raw", "c")})) AS total FROM r),
c AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS line FROM d)
SELECT c_custkey, {ids_sql({
    **{rule: f"{terms_sql(name, 'body')} >= {least}" for rule, (name, least) in phrases.items()},
    "CNT-005": "total >= 5", "CNT-006": f"has_form AND len(list_filter(inputs, lambda t: regexp_matches(t, {quoted(intel.SENSITIVE_INPUT)}))) > 0",
    "CNT-004": "coalesce(list_sum(list_transform(hidden, lambda t: length(t))), 0) > 40", "CNT-007": f"images >= 1 AND shown < {intel.IMAGE_ONLY_TEXT} AND html <> ''",
    "CNT-008": f"length(plain) >= 80 AND length(page) >= 80 AND 2.0 * {shared} / (length(plain) + length(page)) < {intel.PART_SIMILARITY}",
    "CNT-011": f"n_urls = 0 AND n_files = 0 AND length(line) > 20 AND length(line) < 900 AND regexp_matches(line, {quoted('(?i)' + intel.SOLICITATION)})",
})} FROM c"""  # fmt: skip


def queries() -> dict:
    return {f.__name__: f for f in (rules_authentication, rules_headers, rules_urls, rules_attachments, rules_content)}


def oracle_sql() -> dict[str, str]:
    return {"rules_authentication": _auth_sql(), "rules_headers": _headers_sql(), "rules_urls": _urls_sql(), "rules_attachments": _attachments_sql(), "rules_content": _content_sql()}
