"""The 58 rules as SQL expressions over a parsed message: each is a finding struct or NULL.

Findings of a message are built as one array in a projection, so no message is ever exploded, joined or
shuffled to be judged. Rules on links and attachments take the first that fires.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern import intel
from postern.catalog import INDICATORS
from postern.functions import domains
from postern.functions.text import collapse, extension, find_invisible, html_to_text, lexicon_hits, lit_array, lit_map, path_tokens, strip_invisible, within

FINDING = "struct<indicator_id:string,evidence:string,detail:string>"
_BRANDS = [(k, name, list(ds), [r for d in ds if (r := domains.registered_domain(d, domains.load_rules()))]) for k, (name, ds) in enumerate(intel.BRANDS.items())]


def finding(rule: str, when: Column, evidence: Column, **detail: Column) -> Column:
    packed = F.to_json(F.struct(*(c.alias(n) for n, c in detail.items()))) if detail else F.lit("{}")
    return F.when(when, F.struct(F.lit(rule).alias("indicator_id"), evidence.alias("evidence"), packed.alias("detail")))


def say(template: str, *values: Column) -> Column:
    """The template with its {} filled in."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [F.coalesce(value.cast("string"), F.lit("")), F.lit(text)]
    return F.concat(*out)


def header(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.try_element_at("headers", F.lit(name)), F.lit(1)), F.lit(""))


def header_all(name: str) -> Column:
    return F.coalesce(F.try_element_at("headers", F.lit(name)), F.array().cast("array<string>"))


def first_of(array: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(array, predicate), F.lit(1))


def same_org(a: Column, b: Column) -> Column:
    """Two registered domains, equal and not empty."""
    return (a == b) & (a != "")


def brands() -> Column:
    return lit_array([{"ord": k, "name": n, "domains": ds, "registered": rs} for k, n, ds, rs in _BRANDS])


class Org:
    """The organisation's own domains, as given and as registered; and what its rules work out once for several findings."""

    def __init__(self, own: tuple[str, ...] = ()) -> None:
        self.held: dict[str, Column] = {}
        self.later: dict[str, Column] = {}
        self.given = [d.lower() for d in own]
        self.registered = [r for d in self.given if (r := domains.registered_domain(d, domains.load_rules()))]

    def once(self, name: str, column: Column, of_held: bool = False) -> Column:
        """A column to stand in for an expression that findings use many times over: plans stay small, and it is worked out once.

        of_held: the expression uses columns that stand in for others.
        """
        (self.later if of_held else self.held)[f"_held_{name}"] = column
        return F.col(f"_held_{name}")

    def holding(self, df: DataFrame) -> DataFrame:
        """The rows with all that `once` was told."""
        df = df.withColumns(self.held) if self.held else df
        return df.withColumns(self.later) if self.later else df

    def owns(self, registered: Column) -> Column:
        return registered.isin(self.registered) if self.registered else F.lit(False)


# ------------------------------------------------------------------ authentication


def auth_results(blob: Column) -> Column:
    """struct<spf, dkim, dmarc>: each mechanism's worst result, the first of equals; NULL where there is none."""
    names, results = (F.transform(F.regexp_extract_all(blob, F.lit(intel.AUTH_RESULT), g), F.lower) for g in (1, 2))
    rank = F.create_map(*(F.lit(x) for kv in intel.AUTH_RANK.items() for x in kv))
    every = F.transform(F.arrays_zip(names.alias("m"), results.alias("r")), lambda x, k: F.struct(F.element_at(rank, x["r"]).alias("rank"), (-k).alias("first"), x["r"].alias("r"), x["m"].alias("m")))
    worst = lambda mechanism: F.array_max(F.filter(every, lambda x: x["m"] == mechanism))["r"].alias(mechanism)
    return F.struct(*map(worst, ("spf", "dkim", "dmarc")))


_SPF_WORDS = ("pass", "fail", "softfail", "neutral", "none", "permerror", "temperror")


def with_auth(parsed: DataFrame) -> DataFrame:
    raw = F.concat(header_all("authentication-results"), header_all("arc-authentication-results"), header_all("received-spf"))
    told = auth_results(F.concat_ws(" ; ", raw))
    first_words = F.transform(header_all("received-spf"), lambda h: F.lower(F.regexp_extract(h, r"^\s*(\S*)", 1)))
    spf = F.coalesce(told["spf"], first_of(first_words, lambda w: w.isin(*_SPF_WORDS)))
    return parsed.withColumn("auth", F.struct(F.size(raw).alias("headers"), spf.alias("spf"), told["dkim"].alias("dkim"), told["dmarc"].alias("dmarc")))


def authentication(org: Org) -> list[Column]:
    auth, o = F.col("auth"), F.col("org")
    has = auth["headers"] > 0
    spf, dkim, dmarc = (F.coalesce(auth[m], F.lit("")) for m in ("spf", "dkim", "dmarc"))
    known = lambda d: F.when(d == "", "unknown").otherwise(d)
    signed = F.size(header_all("dkim-signature")) > 0
    passing = F.array_compact(F.array(*(F.when((r == "pass") & (o[f"{m}_domain"] != ""), F.struct(F.lit(m.upper()).alias("mechanism"), o[f"{m}_domain"].alias("domain"), o[m].alias("r"))) for m, r in (("spf", spf), ("dkim", dkim)))))
    aligned = F.exists(passing, lambda p: same_org(p["r"], o["sender"]))
    shown = F.transform(passing, lambda p: F.struct(p["mechanism"].alias("mechanism"), p["domain"].alias("domain")))
    sender = F.col("from_domain")
    no_dmarc = F.col("dns")["checked"] & ~F.col("dns")["has_dmarc"]
    return [
        finding("AUTH-001", has & (spf == "fail"), say("Authentication-Results reports spf={}", spf), spf_domain=known(o["spf_domain"])),
        finding("AUTH-002", has & spf.isin("softfail", "neutral", "permerror"), say("Authentication-Results reports spf={}", spf), spf_domain=known(o["spf_domain"])),
        finding("AUTH-003", has & dkim.isin("fail", "permerror"), say("Authentication-Results reports dkim={}", dkim), dkim_domain=known(o["dkim_domain"])),
        finding("AUTH-004", has & ~signed & dkim.isin("", "none"), F.lit("No DKIM-Signature header on the message")),
        finding("AUTH-005", has & dmarc.isin("fail", "permerror"), say("Authentication-Results reports dmarc={}", dmarc)),
        finding("AUTH-006", ~has, F.lit("Neither Authentication-Results nor Received-SPF is present"), headers_checked=lit_array(("Authentication-Results", "Received-SPF", "ARC-Authentication-Results"))),
        finding("AUTH-007", has & (sender != "") & (F.size(passing) > 0) & ~aligned, say("{}, but From: shows {}", F.array_join(F.transform(passing, lambda p: F.concat(p["mechanism"], F.lit(" authenticated "), p["domain"])), ", "), sender), from_domain=sender, authenticated=shown),
        finding("AUTH-008", has & (sender != "") & no_dmarc, say("No _dmarc TXT record found for {}", sender), domain=sender),
    ]


def dns_findings() -> Column:
    """AUTH-009, once for each permissive SPF record of the snapshot (the one rule that can repeat)."""
    open_records = F.filter(F.col("dns")["txt"], lambda t: F.lower(t).startswith("v=spf1") & t.rlike(r"[+]?all\s*$") & ~t.rlike(r"[-~?]all\s*$"))
    found = F.transform(open_records, lambda t: F.struct(F.lit("AUTH-009").alias("indicator_id"), F.concat(F.lit("SPF record permits all senders: "), F.left(t, F.lit(160))).alias("evidence"), F.to_json(F.struct(F.col("from_domain").alias("domain"), F.left(t, F.lit(300)).alias("record"))).alias("detail")))
    return F.when((F.col("auth")["headers"] > 0) & (F.col("from_domain") != ""), F.coalesce(found, F.array().cast(f"array<{FINDING}>"))).otherwise(F.array().cast(f"array<{FINDING}>"))


# ------------------------------------------------------------------ headers


def headers(org: Org) -> list[Column]:
    o, sender, address, display = F.col("org"), F.col("from_domain"), F.col("from_address"), F.col("from_display")
    named = (display != "") & (sender != "")
    reply = o["reply_domain"]
    embedded = org.once("embedded", first_of(o["embedded"], lambda e: (e["address"] != address) & ~same_org(e["registered"], o["sender"])))
    brand = org.once("display_brand", first_of(brands(), lambda b: F.contains(F.lower(display), b["name"])))
    owned = F.array_contains(brand["domains"], o["sender"]) | F.array_contains(brand["registered"], o["sender"]) | org.owns(o["sender"])
    role = F.regexp_extract(F.lower(display), intel.ROLE, 0)
    mid, mid_domain = F.col("message_id"), o["message_id_domain"]
    mailer = org.once("mailer", first_of(F.array(*(F.struct(F.lit(n).alias("n"), header(n).alias("v")) for n in ("x-mailer", "user-agent", "x-php-originating-script"))), lambda h: h["v"].rlike(intel.BULK_MAILER)))
    hops = F.col("hops")
    odd = org.once("odd_hop", first_of(hops, lambda h: (h["delay_seconds"] < -60) | (h["delay_seconds"] > intel.MAX_HOP_SECONDS)))
    late = odd["delay_seconds"]
    told = F.when(late < -60, say("Hop {} is timestamped {}s *before* the hop that preceded it", odd["index"], F.format_string("%d", F.bround(F.abs(late), 0).cast("long")))).otherwise(say("Hop {} sat for {}h before the next relay", odd["index"], F.format_string("%.1f", late / 3600)))
    newest = org.once("newest_hop", first_of(hops, lambda h: h["epoch"].isNotNull()))
    skew = F.abs(F.col("date_epoch") - newest["epoch"])
    visible = F.array_union(F.col("to"), F.col("cc"))
    delivered = F.when(header("delivered-to") != "", header("delivered-to")).otherwise(header("x-original-to"))
    inside = F.exists(visible, lambda a: domains.address_domain(a).isin(org.given)) if org.given else F.lit(False)
    subject = F.col("subject")
    banner = subject.rlike(intel.EXTERNAL_BANNER) & F.lit(bool(org.given)) & ~org.owns(o["sender"])
    orphan = subject.rlike(intel.REPLY_PREFIX) & (header("in-reply-to") == "") & (header("references") == "")
    return [
        finding("HDR-001", (sender != "") & (reply != "") & ~same_org(o["reply"], o["sender"]), say("From: {} but Reply-To: {}", address, F.col("reply_to")), from_domain=sender, reply_to_domain=reply, reply_to_is_freemail=within(reply, intel.FREEMAIL_DOMAINS), reply_to_is_disposable=within(reply, intel.DISPOSABLE_DOMAINS)),
        finding("HDR-002", (sender != "") & (F.col("return_path") != "") & ~same_org(o["return_path"], o["sender"]), say("Return-Path domain {} != From domain {}", F.col("return_path"), sender), return_path_domain=F.col("return_path"), from_domain=sender),
        finding("HDR-003", named & embedded.isNotNull(), say('Display name reads "{}" but the real sender is {}', display, address), display_name=display, embedded_address=embedded["address"], actual_address=address),
        finding("HDR-004", named & brand.isNotNull() & ~owned, say('Display name claims "{}" but the message was sent from {}', display, o["sender"]), display_name=display, claimed_brand=brand["name"], sender_domain=o["sender"], legitimate_domains=brand["domains"]),
        finding("HDR-005", (mid_domain != "") & (sender != "") & ~same_org(o["message_id"], o["sender"]), say("Message-ID was issued by {}, sender domain is {}", mid_domain, sender), message_id_domain=mid_domain, from_domain=sender),
        F.coalesce(finding("HDR-006", mid == "", F.lit("Message-ID header is absent")), finding("HDR-006", mid_domain == "", say("Malformed Message-ID: {}", F.left(mid, F.lit(120))), message_id=mid)),
        finding("HDR-007", mailer.isNotNull(), say("{}: {}", mailer["n"], F.left(mailer["v"], F.lit(120))), header=mailer["n"], value=F.left(mailer["v"], F.lit(200))),
        finding("HDR-008", odd.isNotNull(), told, hop_index=odd["index"], delay_seconds=late, raw=F.left(odd["raw"], F.lit(200))),
        finding("HDR-009", (F.col("date_header") != "") & (skew > intel.MAX_SKEW_SECONDS), say("Date: header is {}h from the delivering hop's timestamp", F.format_string("%.1f", skew / 3600)), date_header=F.col("date_header"), delivery_time=newest["iso"], skew_seconds=skew),
        finding("HDR-010", F.size(hops) <= 1, say("Received chain contains {} hop(s)", F.size(hops)), hop_count=F.size(hops)),
        F.coalesce(finding("HDR-011", F.lit(bool(org.given)) & (F.size(visible) == 0), F.lit("Message has no To or Cc recipients at all")), finding("HDR-011", F.lit(bool(org.given)) & (F.size(visible) > 0) & ~inside & (delivered != ""), say("Delivered to {} which appears in neither To nor Cc", delivered), delivered_to=delivered, to=F.col("to"), cc=F.col("cc"))),
        finding("HDR-012", named & within(o["sender"], intel.FREEMAIL_DOMAINS) & (role != ""), say('Display name asserts "{}" from freemail account {}', role, address), display_name=display, role_claimed=role, freemail_domain=o["sender"]),
        F.coalesce(finding("HDR-013", (subject != "") & banner, say('Subject carries an external-sender banner from outside the org: "{}"', F.left(subject, F.lit(100))), subject=F.left(subject, F.lit(200))), finding("HDR-013", (subject != "") & orphan, say('Subject "{}" implies a reply, but there is no In-Reply-To or References header', F.left(subject, F.lit(80))), subject=F.left(subject, F.lit(200)))),
    ]


# ------------------------------------------------------------------ links


def lookalike(label: Column) -> Column:
    """struct<distance, ord, brand, canonical>: the nearest brand within two edits but not equal, the first of equals."""
    near = [{"ord": k, "brand": n, "canonical": ds[0], "core": ds[0].split(".")[0]} for k, n, ds, _ in _BRANDS]
    targets = lit_array([x for x in near if len(x["core"]) >= intel.LOOKALIKE_LENGTH])
    every = F.transform(targets, lambda t: F.struct(F.levenshtein(label, t["core"], intel.LOOKALIKE_DISTANCE).alias("distance"), t["ord"].alias("ord"), t["brand"].alias("brand"), t["canonical"].alias("canonical")))
    return F.array_min(F.filter(every, lambda x: x["distance"].between(1, intel.LOOKALIKE_DISTANCE)))


def brand_in(text: Column) -> Column:
    return first_of(brands(), lambda b: F.contains(F.lower(text), b["name"]))


def credential_terms(path: Column) -> Column:
    return F.array_sort(F.array_intersect(path_tokens(path), lit_array(intel.CREDENTIAL_PATH_TERMS)))


def urls(org: Org) -> list[Column]:
    every = F.col("urls")
    legit = lambda u: within(u["registered_domain"], intel.LEGITIMATE_DOMAINS) | org.owns(u["registered_domain"])
    hit = lambda name, p: org.once(name, first_of(every, p))
    dots = lambda s: F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    anchor = hit("url_anchor", lambda u: (u["source"] == "html-anchor") & (u["anchor_text"] != "") & (u["registered_domain"] != "") & (u["claimed_suffix"] != "") & (u["claimed_domain"] != "") & (u["claimed_domain"] != u["registered_domain"]))
    puny = hit("url_puny", lambda u: F.contains(u["host"], F.lit("xn--")))
    mixed = hit("url_mixed", lambda u: u["mixed"] & (F.size(u["confusables"]) > 0))
    like = hit("url_like", lambda u: (u["registered_domain"] != "") & ~legit(u) & lookalike(u["label"]).isNotNull())
    near = org.once("near_brand", lookalike(like["label"]), True)
    ip = hit("url_ip", lambda u: u["is_ip"])
    short = hit("url_short", lambda u: within(u["registered_domain"], intel.URL_SHORTENERS))
    tld = hit("url_tld", lambda u: within(F.substring_index(u["suffix"], ".", -1), intel.HIGH_ABUSE_TLDS))
    ending = F.substring_index(tld["suffix"], ".", -1)
    cred = hit("url_cred", lambda u: ~legit(u) & (F.size(credential_terms(u["path"])) >= 2))
    terms = org.once("path_terms", credential_terms(cred["path"]), True)
    redirect = hit("url_redirect", lambda u: u["redirect_key"].isNotNull())
    deep = hit("url_deep", lambda u: (u["subdomain"] != "") & ~legit(u) & (brand_in(u["subdomain"]).isNotNull() | (dots(u["subdomain"]) >= 3)))
    brand = org.once("subdomain_brand", brand_in(deep["subdomain"]), True)
    plain = hit("url_plain", lambda u: (u["scheme"] == "http") & ~u["is_ip"] & (F.size(credential_terms(u["path"])) > 0))
    inline = hit("url_inline", lambda u: u["scheme"].isin("data", "javascript", "vbscript"))
    user = hit("url_user", lambda u: F.contains(u["authority"], F.lit("@")))
    real = F.substring_index(user["authority"], "@", -1)
    decoy = F.left(user["authority"], F.length(user["authority"]) - F.length(real) - 1)
    whose = F.transform(F.slice(mixed["confusables"], 1, 3), lambda c: F.concat(F.lit("'"), c["char"], F.lit("' ("), c["name"], F.lit(", "), c["script"], F.lit(")")))
    return [
        finding("URL-001", anchor.isNotNull(), say('Link text shows "{}" but the href resolves to {}', anchor["claimed_host"], anchor["host"]), anchor_text=F.left(anchor["anchor_text"], F.lit(200)), claimed_domain=anchor["claimed_domain"], actual_domain=anchor["registered_domain"], url=anchor["url"]),
        finding("URL-002", puny.isNotNull(), F.concat(say("Host {} is punycode", puny["host"]), F.when(puny["rendered"] != "", say(' and renders as "{}"', puny["rendered"])).otherwise(F.lit(""))), host=puny["host"], renders_as=puny["rendered"], url=puny["url"]),
        finding("URL-003", mixed.isNotNull(), say("Host {} mixes Unicode scripts: {}", F.when(mixed["rendered"] != "", mixed["rendered"]).otherwise(mixed["host"]), F.array_join(whose, ", ")), host=mixed["host"], rendered=F.when(mixed["rendered"] != "", mixed["rendered"]).otherwise(mixed["host"]), confusables=mixed["confusables"]),
        finding("URL-004", like.isNotNull(), say("Registered domain {} is {} character(s) from {}", like["registered_domain"], near["distance"], near["canonical"]), registered_domain=like["registered_domain"], resembles=near["canonical"], brand=near["brand"], edit_distance=near["distance"], url=like["url"]),
        finding("URL-005", ip.isNotNull(), say("Link targets the IP address {}", ip["host"]), ip=ip["host"], url=ip["url"]),
        finding("URL-006", short.isNotNull(), say("{} shortener hides the true destination of {}", short["registered_domain"], short["url"]), shortener=short["registered_domain"], url=short["url"], note=F.lit("Not resolved: fetching the link would confirm delivery to the sender.")),
        finding("URL-007", tld.isNotNull(), say("Link uses the .{} TLD ({})", ending, tld["registered_domain"]), tld=ending, registered_domain=tld["registered_domain"]),
        finding("URL-008", cred.isNotNull(), say("Path on {} contains {}", cred["registered_domain"], F.array_join(F.slice(terms, 1, 5), ", ")), registered_domain=cred["registered_domain"], terms=terms, path=F.left(cred["path"], F.lit(200))),
        finding("URL-009", redirect.isNotNull(), say("{} carries a redirect parameter {}={}", redirect["registered_domain"], redirect["redirect_key"], F.left(redirect["redirect_value"], F.lit(100))), host=redirect["host"], parameter=redirect["redirect_key"], destination=F.left(redirect["redirect_value"], F.lit(200))),
        F.coalesce(finding("URL-010", deep.isNotNull() & brand.isNotNull(), say('Subdomain "{}" advertises {} but the domain is {}', deep["subdomain"], brand["name"], deep["registered_domain"]), subdomain=deep["subdomain"], brand=brand["name"], registered_domain=deep["registered_domain"], legitimate_domains=brand["domains"], url=deep["url"]), finding("URL-010", deep.isNotNull(), say('Unusually deep subdomain chain: "{}.{}"', deep["subdomain"], deep["registered_domain"]), subdomain=deep["subdomain"], depth=dots(deep["subdomain"]) + 1, registered_domain=deep["registered_domain"])),
        finding("URL-011", plain.isNotNull(), say("Action link served over plain HTTP: {}", F.left(plain["url"], F.lit(160))), url=plain["url"]),
        finding("URL-012", inline.isNotNull(), say("{}: URI present in the message body", inline["scheme"]), scheme=inline["scheme"], snippet=F.left(inline["url"], F.lit(200))),
        finding("URL-013", user.isNotNull(), say('Everything before the @ ("{}") is ignored; the browser connects to {}', F.left(decoy, F.lit(80)), real), decoy=F.left(decoy, F.lit(120)), real_host=real, url=user["url"]),
    ]


# ------------------------------------------------------------------ attachments


def attachment_class(ext: Column) -> Column:
    """struct<rule, label> of the first class that holds the extension, NULL for none."""
    out = F.lit(None).cast("struct<rule:string,label:string>")
    for rule, label, extensions in reversed(intel.CLASSES):
        out = F.when(within(ext, extensions), F.struct(F.lit(rule).alias("rule"), F.lit(label).alias("label"))).otherwise(out)
    return out


def double_extension(name: Column) -> Column:
    """struct<decoy, real> where a harmless extension stands before one that runs, else NULL."""
    decoy, real = (F.lower(F.regexp_extract(name, intel.DOUBLE_EXTENSION, g)) for g in (1, 2))
    return F.when(within(decoy, intel.DECOY) & within(real, [*intel.EXECUTABLE, *intel.SCRIPT]), F.struct(decoy.alias("decoy"), real.alias("real")))


def mime_mismatch(ext: Column, declared: Column) -> Column:
    """The expected types where the declared one is another (and says anything at all), else NULL."""
    expected = F.try_element_at(lit_map({e: list(ts) for e, ts in intel.EXPECTED_MIME.items()}), ext)
    return F.when((declared != "") & (declared != "application/octet-stream") & ~F.array_contains(expected, declared), expected)


def attachments(org: Org) -> list[Column]:
    every = F.col("attachments")
    hits = org.once("password_phrases", lexicon_hits("archive_password", F.concat_ws("\n", "body_text", "subject")))
    hit = lambda name, p: org.once(name, first_of(every, p))
    ext = lambda a: extension(a["filename"])
    sums = lambda a: {"sha256": a["sha256"], "md5": a["md5"]}
    rtlo = hit("file_rtlo", lambda a: F.contains(a["filename"], F.lit(intel.RTLO)))
    shown = F.replace(rtlo["filename"], F.lit(intel.RTLO), F.lit(""))
    turned = extension(F.reverse(shown))
    twice = hit("file_twice", lambda a: double_extension(a["filename"]).isNotNull())
    both = org.once("both_extensions", double_extension(twice["filename"]), True)
    wrong = hit("file_wrong", lambda a: mime_mismatch(ext(a), a["content_type"]).isNotNull())
    expected = org.once("expected_types", mime_mismatch(ext(wrong), wrong["content_type"]), True)
    locked = hit("file_locked", lambda a: within(ext(a), intel.ARCHIVE))
    out = [
        finding("ATT-008", rtlo.isNotNull(), say("Filename contains U+202E; it displays as one thing and is another: '{}'", F.replace(rtlo["filename"], F.lit(intel.RTLO), F.lit("\\u202e"))), filename=rtlo["filename"], filename_without_rtlo=shown, real_extension=F.when(turned != "", turned).otherwise(extension(shown)), **sums(rtlo)),
        finding("ATT-002", twice.isNotNull(), say('"{}" presents as .{} but is a .{}', twice["filename"], both["decoy"], both["real"]), filename=twice["filename"], decoy_extension=both["decoy"], real_extension=both["real"], **sums(twice)),
        finding("ATT-005", wrong.isNotNull(), say('"{}" declares Content-Type {}, but .{} should be {}', wrong["filename"], wrong["content_type"], ext(wrong), expected[0]), filename=wrong["filename"], declared=wrong["content_type"], expected=expected, **sums(wrong)),
        finding("ATT-006", locked.isNotNull() & (F.size(hits) > 0), say('Archive "{}" arrives with password wording in the body: {}', locked["filename"], F.array_join(F.slice(hits, 1, 3), ", ")), filename=locked["filename"], password_phrases=hits, **sums(locked)),
    ]
    of_class = lambda rule: hit(f"file_{rule[-3:]}", lambda a: attachment_class(ext(a))["rule"] == rule)
    for rule, label, _ in intel.CLASSES:
        a = of_class(rule)
        out.append(finding(rule, a.isNotNull(), say('"{}" is a {} (.{}, {} bytes)', a["filename"], F.lit(label), ext(a), F.format_number(a["size"], 0)), filename=a["filename"], extension=ext(a), size=a["size"], content_type=a["content_type"], **sums(a)))
    return out


# ------------------------------------------------------------------ content


def content(org: Org) -> list[Column]:
    facts, html = F.col("html_facts"), F.col("html_as_text")
    raw, body = F.col("raw_body"), F.col("body")
    quoted = lambda h: F.when(F.contains(h, F.lit("'")), F.concat(F.lit('"'), h, F.lit('"'))).otherwise(F.concat(F.lit("'"), h, F.lit("'")))
    out = []
    for name, rule, label, least in (("urgency", "CNT-001", "Urgency wording", 1), ("credentials", "CNT-002", "Credential-request wording", 1), ("financial", "CNT-003", "Financial-instruction wording", 2), ("threat", "CNT-010", "Consequence wording", 1), ("secrecy", "CNT-012", "Secrecy or process-bypass wording", 1), ("salutation", "CNT-009", "Generic salutation", 1)):
        hits = org.once(f"{name}_phrases", lexicon_hits(name, body))
        out.append(finding(rule, F.size(hits) >= least, say("{}: {}", F.lit(label), F.array_join(F.transform(F.slice(hits, 1, 4), quoted), ", ")), phrases=hits, phrase_count=F.size(hits)))
    odd = org.once("invisible", find_invisible(raw))
    total = F.aggregate(odd, F.lit(0), lambda s, x: s + x["count"])
    hidden = F.aggregate(facts["hidden_text"], F.lit(0), lambda s, t: s + F.length(t))
    sensitive = F.filter(facts["input_types"], lambda t: t.rlike(intel.SENSITIVE_INPUT))
    left, right = F.lower(collapse(F.col("body_text"))), F.lower(html)
    alike = F.col("part_similarity")
    flat = org.once("flat_body", collapse(body))
    trigger = org.once("solicitation", F.regexp_extract(flat, "(?i)" + intel.SOLICITATION, 0), True)
    return [
        *out,
        finding("CNT-005", total >= 5, say("{} invisible characters in the body ({})", total, F.array_join(F.transform(F.slice(odd, 1, 3), lambda x: F.concat(x["name"], F.lit(" x"), x["count"].cast("string"))), ", ")), total=total, characters=odd),
        finding("CNT-006", facts["has_form"] & (F.size(sensitive) > 0), say("HTML form in the body collects {}", F.array_join(F.slice(F.array_sort(F.array_distinct(sensitive)), 1, 4), ", ")), input_types=F.array_sort(F.array_distinct(facts["input_types"])), form_actions=F.slice(facts["form_actions"], 1, 3)),
        finding("CNT-004", hidden > 40, say("{} characters of hidden text, e.g. {}", hidden, quoted(F.array_join(F.transform(F.slice(facts["hidden_text"], 1, 3), lambda t: F.left(t, F.lit(60))), " | "))), hidden_characters=hidden, samples=F.transform(F.slice(facts["hidden_text"], 1, 5), lambda t: F.left(t, F.lit(120)))),
        finding("CNT-007", (facts["image_count"] >= 1) & (facts["visible_text_len"] < intel.IMAGE_ONLY_TEXT) & (F.col("body_html") != ""), say("{} image(s) but only {} characters of readable text", facts["image_count"], facts["visible_text_len"]), image_count=facts["image_count"], visible_text_length=facts["visible_text_len"]),
        finding("CNT-008", (F.length(left) >= 80) & (F.length(right) >= 80) & (alike < intel.PART_SIMILARITY), say("text/plain and text/html parts are only {}% similar", F.bround(alike * 100, 0).cast("int")), similarity=F.bround(alike, 3), text_preview=F.left(left, F.lit(180)), html_preview=F.left(right, F.lit(180))),
        finding("CNT-011", (F.size("urls") == 0) & (F.size("attachments") == 0) & (F.length(flat) > 20) & (F.length(flat) < 900) & (trigger != ""), say('Payload-free reply solicitation: "{}"', trigger), trigger=trigger, body_length=F.length(flat)),
    ]


# ------------------------------------------------------------------ all

#: Analyzers by category; each gives the findings of its category. A new one is added here or passed to `findings`.
ANALYZERS: dict[str, Callable[[Org], list[Column]]] = {"authentication": authentication, "headers": headers, "urls": urls, "attachments": attachments, "content": content}
_DNS = "struct<checked:boolean,has_dmarc:boolean,txt:array<string>>"


def with_dns(parsed: DataFrame, dns_txt: DataFrame | None) -> DataFrame:
    """Joins a DNS snapshot (name, record) to the senders; without one, the rules on DNS stay silent."""
    if dns_txt is None:
        return parsed.withColumn("dns", F.lit(None).cast(_DNS)).withColumn("dns", F.struct(F.lit(False).alias("checked"), F.lit(False).alias("has_dmarc"), F.array().cast("array<string>").alias("txt")))
    by_name = dns_txt.groupBy(F.lower("name").alias("dns_name")).agg(F.sort_array(F.collect_list("record")).alias("records"))
    policy = by_name.where(F.col("dns_name").startswith("_dmarc.")).select(F.substring("dns_name", 8, 1000).alias("policy_of"), F.lit(True).alias("found"))
    txt = by_name.withColumnsRenamed({"dns_name": "txt_of", "records": "txt_records"})
    joined = parsed.join(txt, F.col("from_domain") == F.col("txt_of"), "left").join(policy, F.col("from_domain") == F.col("policy_of"), "left")
    return joined.withColumn("dns", F.struct(F.lit(True).alias("checked"), F.coalesce("found", F.lit(False)).alias("has_dmarc"), F.coalesce("txt_records", F.array().cast("array<string>")).alias("txt"))).drop("txt_of", "txt_records", "policy_of", "found")


def findings(parsed: DataFrame, org_domains: tuple[str, ...] = (), dns_txt: DataFrame | None = None, analyzers: dict[str, Callable[[Org], list[Column]]] | None = None) -> DataFrame:
    """The parsed messages with `findings`, most severe first, then heaviest, then by id."""
    from postern.functions.text import similarity

    org = Org(org_domains)
    base = with_auth(with_dns(parsed, dns_txt)).withColumn("html_as_text", html_to_text(F.col("body_html")))
    base = base.withColumn("raw_body", F.concat_ws("\n", "subject", "body_text", "html_as_text")).withColumn("body", strip_invisible(F.col("raw_body")))
    plain = F.lower(collapse(F.col("body_text")))
    base = base.withColumn("part_similarity", F.when((F.length(plain) >= 80) & (F.length("html_as_text") >= 80), similarity(plain, F.lower("html_as_text"))))
    made = {name: F.array_compact(F.array(*(c.cast(FINDING) for c in f(org)))) for name, f in (analyzers or ANALYZERS).items()}
    base = org.holding(base)
    base = base.withColumns({f"found_{name}": column for name, column in made.items()})
    order = lit_map({i: f"{4 - intel.SEVERITY_RANK[s]}{40 - w:02d}{i}" for i, _, _, s, w, _, _ in INDICATORS})
    every = F.concat(*(F.col(f"found_{name}") for name in made), dns_findings())
    ranked = F.array_sort(F.transform(every, lambda f, k: F.struct(F.coalesce(F.try_element_at(order, f["indicator_id"]), F.lit("9")).alias("o"), k.alias("k"), f.alias("f"))))
    out = base.withColumn("findings", F.transform(ranked, lambda r: r["f"]))
    return out.drop(*(f"found_{name}" for name in made), *org.held, *org.later, "raw_body", "body", "html_as_text", "dns", "part_similarity")
