"""Native text functions: defanging, phrases, invisible characters, tags, extensions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postern import intel


def sql_literal(value) -> str:
    """A value as Spark SQL writes it: a large table of fixed values is one expression to parse, not a call for each value."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in value.items()) + ")"
    return f"cast(array({', '.join(map(sql_literal, value))}) as array<string>)" if isinstance(value, list | tuple) else str(value)


def lit_array(values) -> Column:
    """Strings, or dicts as structs."""
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def lit_map(values: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in values.items()) + ")")


def within(column: Column, values) -> Column:
    """Whether a column's value is one of many fixed ones."""
    return F.array_contains(lit_array(values), column)


def defang_url(url: Column) -> Column:
    """Schemes, dots and @ made inert, also in nested addresses."""
    out = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)https://", "hxxps[://]")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)http://", "hxxp[://]"), r"(?i)ftp://", "fxp[://]")
    return F.replace(F.replace(out, F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))


def defang_domain(domain: Column) -> Column:
    return F.replace(F.coalesce(domain, F.lit("")), F.lit("."), F.lit("[.]"))


def defang_ip(ip: Column) -> Column:
    return F.when(F.contains(ip, F.lit(":")), F.replace(ip, F.lit(":"), F.lit("[:]"))).otherwise(defang_domain(ip))


def defang_email(address: Column) -> Column:
    local = F.substring(address, F.lit(1), F.length(address) - F.length(F.substring_index(address, "@", -1)) - 1)
    return F.when(F.contains(address, F.lit("@")), F.concat(local, F.lit("[@]"), defang_domain(F.substring_index(address, "@", -1)))).otherwise(defang_domain(address))


def refang(text: Column) -> Column:
    out = text
    for inert, live in (("[://]", "://"), ("[.]", "."), ("[@]", "@"), ("[:]", ":")):
        out = F.replace(out, F.lit(inert), F.lit(live))
    return F.regexp_replace(F.regexp_replace(out, r"(?i)hxxp(s?)://", "http$1://"), r"(?i)fxp://", "ftp://")


def lexicon_pattern(name: str) -> str:
    """Longest phrase first, on word boundaries."""
    terms = sorted(intel.LEXICONS[name], key=lambda t: -len(re.escape(t)))
    return r"(?iuU)(?<!\w)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in terms) + r")(?!\w)"


def lexicon_hits(name: str, text: Column, limit: int = 6) -> Column:
    """Distinct phrases in order of appearance, lower-cased."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(lexicon_pattern(name)), 1), F.lower)), 1, limit)


def addresses(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + intel.ADDRESS), 0), F.lower)


def _invisible() -> str:
    return "".join(map(chr, intel.INVISIBLE))


def strip_invisible(text: Column) -> Column:
    return F.translate(text, _invisible(), "")


def find_invisible(text: Column) -> Column:
    """array<struct<codepoint, name, count>> of those present, most frequent first, ties in list order."""
    found = F.array(*(F.struct(F.lit(f"U+{c:04X}").alias("codepoint"), F.lit(n).alias("name"), (F.length(text) - F.length(F.replace(text, F.lit(chr(c)), F.lit("")))).alias("count"), F.lit(k).alias("ord")) for k, (c, n) in enumerate(intel.INVISIBLE.items())))
    some = F.filter(found, lambda x: x["count"] > 0)
    ranked = F.array_sort(F.transform(some, lambda x: F.struct((-x["count"]).alias("o"), x["ord"].alias("k"), x.alias("x"))))
    return F.transform(ranked, lambda r: F.struct(r["x"]["codepoint"].alias("codepoint"), r["x"]["name"].alias("name"), r["x"]["count"].alias("count")))


def html_to_text(html: Column) -> Column:
    """Tags to blanks, white space collapsed; entities and script content stay as they are."""
    return collapse(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " "))


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.btrim(name), intel.EXTENSION, 1))


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(path), r"[^a-z0-9]+"), lambda t: t != ""))


def similarity(a: Column, b: Column) -> Column:
    """Twice the shared characters (as multisets) over all characters of both: an upper bound of how alike two texts are."""
    chars = lambda t: F.split(F.substring(t, 1, intel.SIMILARITY_CHARS), "")
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    xs, ys = F.filter(chars(a), lambda c: c != ""), F.filter(chars(b), lambda c: c != "")
    shared = F.aggregate(F.array_intersect(xs, ys), F.lit(0), lambda s, c: s + F.least(count(xs, c), count(ys, c)))
    return F.when(F.size(xs) + F.size(ys) == 0, 1.0).otherwise(2.0 * shared / (F.size(xs) + F.size(ys)))


def source_label(name: Column) -> Column:
    """Base name without control characters and < > : " | ? *, 120 characters at most."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1), r'[<>:"|?*\p{Cntrl}]', "")
    return F.when(F.btrim(base) == "", F.lit("message.eml")).otherwise(F.left(F.btrim(base), F.lit(120)))


def explain(verdict: Column, score: Column, b: Column) -> Column:
    """One line of rationale from a breakdown struct."""
    parts = F.concat_ws(
        "; ",
        F.concat(b["finding_count"].cast("string"), F.lit(" indicator(s) across "), F.size(b["categories"]).cast("string"), F.lit(" category(ies)")),
        F.concat(F.lit("weight "), b["raw_weight"].cast("string")),
        F.when(b["corroboration_bonus"] != 0, F.concat(F.lit("+"), b["corroboration_bonus"].cast("string"), F.lit(" corroboration"))),
        F.when(b["discount"] != 0, F.concat(F.lit("-"), b["discount"].cast("string"), F.lit(" discounted (sender authenticated cleanly)"))),
        F.when(b["critical_floor_applied"], F.lit("floored by a critical indicator")),
    )
    return F.concat(verdict, F.lit(" - score "), score.cast("string"), F.lit("/100 ("), parts, F.lit(")"))
