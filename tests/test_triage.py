"""The triage engine: parsing, every rule firing and staying silent, scoring, reports, state."""

from __future__ import annotations

import json
import re

import mail
import pytest
from pyspark.sql import functions as F

from postern import catalog, intel
from postern.functions import domains, scripts, text
from postern.operators import parse, report, rules, scoring
from postern.sources import messages
from postern.streaming import state
from postern.triage import triage

RULES = domains.load_rules()
ATT = lambda name, kind="application/octet-stream": mail.parts(("text/plain", "", "hello there"), (kind, name, "QUJD"))
LINK = lambda href, shown="more": mail.html(f'<p>Some words of a normal length for a mail body, so that there is text to read here and now.</p><a href="{href}">{shown}</a>')
NO_DKIM = {"DKIM-Signature": None}
AUTH = lambda value, **more: mail.message({"Authentication-Results": value} | more)

#: rule: (a message on which it fires, a near miss on which it does not)
CASES = {
    "AUTH-001": (AUTH("mx; spf=pass; spf=fail smtp.mailfrom=x@example.org"), AUTH("mx; spf=softfail")),
    "AUTH-002": (AUTH("mx; spf=neutral"), AUTH("mx; spf=fail")),
    "AUTH-003": (AUTH("mx; dkim=permerror"), AUTH("mx; dkim=none")),
    "AUTH-004": (AUTH("mx; spf=pass smtp.mailfrom=a@example.org", **NO_DKIM), AUTH("mx; dkim=neutral", **NO_DKIM)),
    "AUTH-005": (AUTH("mx; dmarc=fail"), AUTH("mx; dmarc=none")),
    "AUTH-006": (mail.message({"Authentication-Results": None} | NO_DKIM), mail.message({"Authentication-Results": None, "Received-SPF": "pass (x)"})),
    "AUTH-007": (AUTH("mx; spf=pass smtp.mailfrom=b@other.com; dkim=pass header.d=third.net"), AUTH("mx; spf=pass smtp.mailfrom=b@other.com; dkim=pass header.d=mail.example.org")),
    "HDR-001": (mail.message({"Reply-To": "x@other.com"}), mail.message({"Reply-To": "x@sub.example.org"})),
    "HDR-002": (mail.message({"Return-Path": "<b@other.com>"}), mail.message({"Return-Path": "<b@bounce.example.org>"})),
    "HDR-003": (mail.message({"From": '"ceo@other.com" <a@example.org>'}), mail.message({"From": '"b@example.org" <a@example.org>'})),
    "HDR-004": (mail.message({"From": "PayPal Service <a@example.org>"}), mail.message({"From": "PayPal <a@paypal.com>", "Return-Path": None, "Message-ID": "<1@paypal.com>"})),
    "HDR-005": (mail.message({"Message-ID": "<1@other.com>"}), mail.message({"Message-ID": "<1@m.example.org>"})),
    "HDR-006": (mail.message({"Message-ID": "no brackets"}), mail.message()),
    "HDR-007": (mail.message({"X-Mailer": "PHPMailer 6"}), mail.message({"X-Mailer": "Thunderbird"})),
    "HDR-008": (mail.message({"Received": [mail.hop("b", "a.example.org", -500)[1], mail.hop("a", "c.example.org", 0)[1]]}), mail.message({"Received": [mail.hop("b", "a.example.org", 20)[1], mail.hop("a", "c.example.org", 70)[1]]})),
    "HDR-009": (mail.message({"Date": mail.stamp(100_000)}), mail.message({"Date": mail.stamp(80_000)})),
    "HDR-010": (mail.message({"Received": mail.hop("b", "a.example.org")[1]}), mail.message()),
    "HDR-011": (mail.message({"To": "x@other.com", "Delivered-To": "ann@example-corp.com"}), mail.message({"To": "x@other.com"})),
    "HDR-012": (mail.message({"From": "Head of Payroll <x@gmail.com>"}), mail.message({"From": "Ann <x@gmail.com>"})),
    "HDR-013": (mail.message({"Subject": "RE: the invoice"}), mail.message({"Subject": "RE: the invoice", "References": "<1@example.org>"})),
    "URL-001": (LINK("https://evil.example.com/x", "https://www.paypal.com/verify"), LINK("https://a.paypal.com/x", "www.paypal.com")),
    "URL-002": (LINK("https://xn--pypal-4ve.com/"), LINK("https://plain.example.org/")),
    "URL-003": (LINK("https://xn--pypal-4ve.com/"), LINK("https://plain.example.org/")),
    "URL-004": (LINK("https://paypa1.com/"), LINK("https://paypal.org/")),
    "URL-005": (LINK("http://192.0.2.8/x"), LINK("http://example.org/x")),
    "URL-006": (LINK("https://bit.ly/abc"), LINK("https://bitly.example.org/abc")),
    "URL-007": (LINK("https://shop.xyz/"), LINK("https://xyz.org/")),
    "URL-008": (LINK("https://a.example.com/login/verify"), LINK("https://a.example.com/login")),
    "URL-009": (LINK("https://a.example.com/?next=https://b.example.com"), LINK("https://a.example.com/?next=/home")),
    "URL-010": (LINK("https://paypal.com.evil.net/"), LINK("https://a.b.evil.net/")),
    "URL-011": (LINK("http://a.example.com/login"), LINK("https://a.example.com/login")),
    "URL-012": (LINK("javascript:alert(1)"), LINK("file:///etc/x")),
    "URL-013": (LINK("https://paypal.com@evil.net/"), LINK("https://evil.net/@x")),
    "ATT-001": (ATT("a.exe"), ATT("a.exe.txt")),
    "ATT-002": (ATT("a.pdf .scr"), ATT("a.tar.gz")),
    "ATT-003": (ATT("a.docm"), ATT("a.docx")),
    "ATT-004": (ATT("a.7z"), ATT("a.7zip")),
    "ATT-005": (ATT("a.pdf", "image/png"), ATT("a.pdf")),
    "ATT-006": (mail.parts(("text/plain", "", "The passcode is 7"), ("application/zip", "a.zip", "QUJD")), ATT("a.zip")),
    "ATT-007": (ATT("a.ps1"), ATT("a.exe")),
    "ATT-008": (mail.parts(("text/plain", "", "x"), ("application/pdf", "=?utf-8?b?aW52b2ljZeKArmZkcC5leGU=?=", "QUJD")), ATT("fdp.exe")),
    "ATT-009": (ATT("a.svg"), ATT("a.css")),
    "ATT-010": (ATT("a.iso"), ATT("a.isox")),
    "ATT-011": (ATT("a.lnk"), ATT("a.link")),
    "CNT-001": (mail.message(body="Please act now."), mail.message(body="An actor nowadays.")),
    "CNT-002": (mail.message(body="Reset your password"), mail.message(body="Your password")),
    "CNT-003": (mail.message(body="A wire transfer by swift code."), mail.message(body="A wire transfer.")),
    "CNT-004": (mail.html('<p style="font-size:0.0px">' + "hidden " * 9 + "</p>seen"), mail.html('<p style="color:#fff;background:#000">' + "hidden " * 9 + "</p>")),
    "CNT-005": (mail.message(body="a\u200bb\u200bc\u200bd\u200be\u00adf"), mail.message(body="a\u200bb\u00ad")),
    "CNT-006": (mail.html('<form action="/x"><input name="Shipping"></form>'), mail.html('<input type="password">')),
    "CNT-007": (mail.html('<img src="https://x.example.org/a.png">few words'), mail.html('<img src="https://x.example.org/a.png">' + "many words " * 20)),
    "CNT-008": (mail.parts(("text/plain", "", "0123456789 " * 12), ("text/html", "", "<p>" + "abc def ghij " * 12 + "</p>")), mail.parts(("text/plain", "", "same words here " * 8), ("text/html", "", "<p>" + "same words here " * 8 + "</p>"))),
    "CNT-009": (mail.message(body="Dear Sir/Madam, hello."), mail.message(body="Dear Ann,")),
    "CNT-010": (mail.message(body="It will be suspended."), mail.message(body="It was suspended.")),
    "CNT-011": (mail.message(body="Hi, are you available? Let me know."), mail.message(body="Hi, let me know, see https://example.org/x")),
    "CNT-012": (mail.message(body="Keep this between us."), mail.message(body="Keep this.")),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(f"{rule}+", a) for rule, (a, _) in CASES.items()] + [(f"{rule}-", b) for rule, (_, b) in CASES.items()]
    rows += [("clean", mail.message()), ("wire", mail.wire_fraud()), ("theft", mail.credential_theft()), ("malware", mail.malware()), ("junk", b"\xff\x00\xfe: x\r\n\r\n\x80"), ("empty", b"")]
    out = triage(messages.in_memory(spark, rows), (mail.ORG,)).cache()
    yield {r.source: r for r in out.collect()}, out
    out.unpersist()


def ids(row):
    return [f.indicator_id for f in row.findings]


@pytest.mark.parametrize("rule", CASES)
def test_rule_fires_and_stays_silent(judged, rule):
    rows, _ = judged
    assert rule in ids(rows[f"{rule}+"]), rows[f"{rule}+"].findings
    assert rule not in ids(rows[f"{rule}-"]), rows[f"{rule}-"].findings


def test_every_rule_has_a_case():
    assert set(CASES) | {"AUTH-008", "AUTH-009"} == set(catalog.BY_ID)


def test_dns_rules_need_a_snapshot(spark):
    raw = messages.in_memory(spark, [("m", mail.message())])
    records = spark.createDataFrame([("example.org", "v=spf1 +all"), ("example.org", "v=spf1 include:x all"), ("example.org", "v=spf1 -all")], "name string, record string")
    assert sorted(ids(triage(raw, (), records).first())) == ["AUTH-008", "AUTH-009", "AUTH-009"]
    policy = spark.createDataFrame([("_dmarc.example.org", "v=DMARC1; p=none")], "name string, record string")
    assert ids(triage(raw, (), policy).first()) == []


def test_whole_messages(judged):
    rows, _ = judged
    assert (rows["clean"].score, rows["clean"].verdict, ids(rows["clean"])) == (0, "Benign", [])
    assert (rows["wire"].score, rows["wire"].verdict) == (53, "Likely Phishing")
    assert rows["theft"].score == 100 and rows["malware"].verdict == "Malicious"
    assert rows["junk"].error is None and rows["empty"].score > 0
    order = [(-intel.SEVERITY_RANK[catalog.BY_ID[i][3]], -catalog.BY_ID[i][4], i) for i in ids(rows["theft"])]
    assert order == sorted(order)


def test_array_and_table_scoring_agree(spark, judged):
    rows, out = judged
    found = out.select(F.col("source").alias("msg_id"), F.explode("findings").alias("f")).select("msg_id", "f.indicator_id")
    table = scoring.score_table(out.select(F.col("source").alias("msg_id")), found)
    for r in table.collect():
        assert (r.score, r.verdict, r.breakdown, r.attack_techniques) == (rows[r.msg_id].score, rows[r.msg_id].verdict, rows[r.msg_id].breakdown, rows[r.msg_id].attack_techniques)


def test_critical_floor_and_exit_codes(judged):
    rows, out = judged
    assert rows["ATT-001+"].verdict == "Likely Phishing" and rows["ATT-001+"].breakdown.critical_floor_applied
    assert scoring.exit_code(out, "malicious") == 1 and scoring.exit_code(out, "benign") == 0 and scoring.exit_code(out, "never") == 0 and scoring.exit_code(out) == 1
    assert scoring.exit_code(out.where("source = 'clean'")) == 0 and scoring.exit_code(out.limit(0)) == 3


def test_reports(judged):
    rows, out = judged
    made = {r.source: r.report for r in report.rendered(out, "json", "now").collect()}
    theft = json.loads(made["theft"])
    assert len(theft) == 12 and theft["verdict"]["score"] == 100 and "https://" not in json.dumps(theft["findings"])
    assert theft["iocs"][0]["value"].startswith("hxxps[://]") and theft["message"]["from_address"] == "x[@]micros0ft[.]tk"
    pages = {r.source: r.report for r in report.rendered(out, "html").collect()}
    assert "<script" not in pages["theft"] and "Malicious" in pages["theft"]
    assert "MALICIOUS" in {r.source: r.report for r in report.rendered(out, "text").collect()}["malware"]
    flat = report.iocs(out.where("source = 'theft'"), defanged=False).collect()
    assert [json.loads(made["theft"])["iocs"][k]["type"] for k in range(len(flat))] == [r.type for r in sorted(flat, key=lambda r: r.pos)]
    merged = report.merged_iocs(report.iocs(out)).count()
    assert merged == report.iocs(out).select("type", "value").distinct().count()
    assert report.summary(out).columns[1:] == ["source", "verdict", "score", "subject", "from", "top_indicators", "attack"]
    assert report.batch_table(out).first().score == 100
    assert scoring.grouped(out.where("source = 'theft'")).where("place = 1").first().findings[0].indicator_id == ids(rows["theft"])[0]


def test_parser_cases():
    p = parse.Parser(RULES)
    assert parse.split_address("Ann, CFO <A@Example.org>") == ("Ann, CFO", "a@example.org")
    assert parse.split_address("nobody") == ("", "") or parse.split_address("nobody")[1] == ""
    hop = parse.parse_hop(0, "from A.example (x [300.1.1.1] [IPv6:2001:db8::1]) by B.example with esmtps; Mon, 04 May 2026 08:30:00 +0200")
    assert (hop["from_host"], hop["by_host"], hop["with_proto"], hop["from_ip"], hop["tz_offset"]) == ("a.example", "b.example", "ESMTPS", "2001:db8::1", "+0200")
    assert parse.parse_hop(0, "from x; nonsense")["timestamp"] is None
    facts = parse.harvest('<head><style>x</style></head><div hidden><b>x</b>y</div><a href="/q">one <i>two</i></a><a href="z">open')
    assert (facts.hidden_text, facts.anchors) == (["x"], [{"href": "/q", "text": "one two"}])
    assert p.url("/relative", "html-src") is None and p.url("www.example.org", "plain-text")["url"] == "http://www.example.org"
    assert p.url("mailto:a@b.c", "html-anchor") is None and p.url("data:text/html,x", "html-src")["host"] == ""
    m = p.message(mail.message({"Content-Type": None}, kind="garbage; ;"))
    assert m["from_domain"] == "example.org" and len(m["raw_hops"]) == 2


@pytest.mark.parametrize(("host", "want"), [("mail.corp.example.co.uk", "example.co.uk"), ("example.org", "example.org"), ("co.uk", ""), ("10.0.0.1", ""), ("localhost", "localhost"), ("a.b.unknowntld", "unknowntld"), ("", "")])
def test_registered_domain(host, want):
    assert domains.registered_domain(host, RULES) == want


def test_scripts():
    assert scripts.is_mixed("p\u0430ypal") and scripts.confusables("p\u0430ypal") == [("\u0430", "CYRILLIC SMALL LETTER A", "Cyrillic")]
    assert scripts.decode_punycode("xn--pypal-4ve.com") == "p\u0430ypal.com" and scripts.decode_punycode("x.com") is None
    assert scripts.defang_text("see https://a.b/c at 10.0.0.1 or example.org, v 2.0") == "see hxxps[://]a[.]b/c at 10[.]0[.]0[.]1 or example[.]org, v 2.0"
    assert scripts.defang_any({"a.b": ["http://x.y", 3]}) == {"a.b": ["hxxp[://]x[.]y", 3]}


def test_native_text_functions(spark):
    urls = ["https://a.b/c?u=http://d.e", "ftp://x@y.z", "plain"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.refang(text.defang_url(F.col("u")))).collect()] == urls
    assert df.select(text.defang_url(F.col("u"))).first()[0] == "hxxps[://]a[.]b/c?u=hxxp[://]d[.]e"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert round(one(text.similarity(F.lit("abca"), F.lit("aabd"))), 2) == 0.75
    assert one(text.lexicon_hits("urgency", F.lit("Urgent! act now, urgently URGENT"))) == ["urgent", "act now", "urgently"]
    assert one(text.source_label(F.lit("C:\\x\\<b>?.eml"))) == "b.eml" and one(text.source_label(F.lit(None))) == "message.eml"
    assert one(domains.is_ipv4(F.lit("255.1.1.01"))) is False


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("b.EML", "a.txt", "sub/c.msg", "skip.pdf"):
        (tmp_path / "in" / name).write_bytes(mail.message())
    (tmp_path / "odd.bin").write_bytes(mail.message())
    got = messages.scan(spark, str(tmp_path / "in"), str(tmp_path / "missing"), str(tmp_path / "odd.bin")).orderBy("ord").collect()
    assert [re.sub(".*/", "", r.source) for r in got] == ["a.txt", "b.EML", "c.msg", "odd.bin"]
    with pytest.raises(FileNotFoundError):
        messages.read_file(spark, str(tmp_path / "none.eml"))
    assert messages.uploads(spark, [("x/<a>.eml", b"1"), ("e.txt", b"")], "pasted").select("source").collect()[0][0] == "a.eml"
    with pytest.raises(ValueError):
        messages.uploads(spark, [("a.exe", b"1")])
    assert bytes(messages.api_body(spark, b'{"raw": "x"}', "application/json").first().content) == b"x"
    assert messages.Settings.from_env({"POSTERN_MAX_FILES": "x", "POSTERN_TTL_SECONDS": "5", "POSTERN_ONLINE": "yes"}) == messages.Settings(ttl_seconds=5, online=True)


def test_rate_limiter(spark):
    rows = [("a", k, float(t)) for k, t in enumerate([0, 1, 2, 59, 60, 61.5])] + [("b", 9, 0.0)]
    got = state.rate_limit(spark.createDataFrame(rows, "client string, request long, at double"), 2, 60.0).collect()
    assert {r.request: r.accepted for r in got} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True}


def fold(ops, ttl=1800.0, most=200):
    held, out = {}, []
    for op, token, value, now in ops:
        held, answer = state.answered(held, op, token, value, now, ttl, most)
        out.append(answer)
    return out


STORED = [("put", f"t{k}", "v", k) for k in range(5)] + [("size", "", "", 4), ("get", "t0", "", 4), ("get", "t2", "", 5), ("put", "t9", "w", 6), ("get", "t2", "", 7), ("get", "t3", "", 7), ("get", "t2", "", 12), ("discard", "t9", "", 12), ("discard", "t9", "", 12), ("put", "a", "x", 13), ("clear", "", "", 13), ("size", "", "", 13)]
ANSWERS = ["t0", "t1", "t2", "t3", "t4", "3", None, "v", "t9", "v", None, None, "true", "false", "a", None, "0"]


def test_store():
    assert fold(STORED, 10, 3) == ANSWERS
    assert fold([("put", "x", "v", 1), ("get", "x", "", 1)], ttl=0) == ["x", None]
    assert fold([("put", "x", "v", 1), ("size", "", "", 1)], most=0) == ["x", "0"]


def test_store_stream(spark, tmp_path):
    """Operations in two batches and two shards: the state carries over, shards stay apart."""
    schema = "shard string, n long, op string, token string, value string, at double"
    rows = [(shard, k, op, token, value, float(at)) for shard in "ab" for k, (op, token, value, at) in enumerate(STORED)]
    for name, part in (("p0", rows[:7]), ("p1", rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        q = state.store_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "ops")), 10, 3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120), name
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("shard", "n").collect()
    assert [r.answer for r in got] == ANSWERS * 2


@pytest.mark.parametrize(("peer", "forwarded", "proxied", "want"), [("1.1.1.1", "2.2.2.2, 3.3.3.3", False, "1.1.1.1"), ("1.1.1.1", "2.2.2.2, 3.3.3.3", True, "2.2.2.2"), ("1.1.1.1", " ", True, "1.1.1.1"), (None, None, True, "unknown"), (None, "2.2.2.2", False, "unknown")])
def test_client_key(spark, peer, forwarded, proxied, want):
    row = spark.createDataFrame([(peer, forwarded)], "p string, f string")
    assert row.select(state.client_key(F.col("p"), F.col("f"), proxied)).first()[0] == want


def test_streams(spark, tmp_path):
    from postern.streaming.mail import triage_stream

    src = tmp_path / "mail"
    src.mkdir()
    (src / "a.eml").write_bytes(mail.credential_theft())
    (src / "b.eml").write_bytes(mail.message())
    q = triage_stream(spark, str(src), (mail.ORG,)).select("source", "verdict").writeStream.format("memory").queryName("triaged").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.verdict for r in spark.table("triaged").collect()) == ["Benign", "Malicious"]


def test_rate_limit_stream_on_event_time(spark, tmp_path):
    """A backlog read at once, in two batches: the log holds as long as the requests' own times say."""
    schema, reqs = "client string, request long, at double", tmp_path / "reqs"
    for part in ([("a", k, k) for k in range(4)], [("a", 4, 59), ("a", 5, 61.5), ("b", 6, 2000)], [("a", 7, 1990)]):
        spark.createDataFrame([(c, k, 1.7e9 + at) for c, k, at in part], schema).coalesce(1).write.mode("append").parquet(str(reqs))
        q = state.rate_limit_stream(spark.readStream.schema(schema).parquet(str(reqs)), 2, 60.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "out2"))
        assert q.awaitTermination(120)
    got = {r.request: r.accepted for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True}


def run(capsys, *argv):
    from postern.__main__ import main

    code = main(["analyze", *map(str, argv)])
    return code, capsys.readouterr()


@pytest.fixture
def folder(tmp_path):
    for name, raw in (("theft", mail.credential_theft()), ("clean", mail.message()), ("wire", mail.wire_fraud())):
        (tmp_path / f"{name}.eml").write_bytes(raw)
    return tmp_path


def test_cli_exit_codes(spark, folder, capsys):
    assert run(capsys, folder / "clean.eml", "-f", "summary")[0] == 0
    assert run(capsys, folder / "theft.eml", "-f", "summary")[0] == 1
    assert run(capsys, folder / "theft.eml", "-f", "summary", "--fail-on", "never")[0] == 0
    assert run(capsys, folder / "wire.eml", "-q", "--fail-on", "malicious")[0] == 0
    assert run(capsys, folder / "none.eml")[0] == 2


def test_cli_json_reads_back(spark, folder, capsys):
    one = json.loads(run(capsys, folder / "theft.eml", "-f", "json")[1].out)
    assert one["verdict"]["label"] == "Malicious"
    many = json.loads(run(capsys, folder, "-f", "json")[1].out)
    assert [m["verdict"]["label"] for m in many] == ["Benign", "Malicious", "Likely Phishing"]
    assert len(json.loads(run(capsys, folder, "-f", "summary")[1].out)) == 3
    seen = json.loads(run(capsys, folder, "-f", "iocs")[1].out)
    assert len(seen) == len({(i["type"], i["value"]) for i in seen}) > 3


def test_cli_files(spark, folder, capsys):
    code, said = run(capsys, folder, "-f", "json", "-o", folder / "deep" / "all.json")
    assert code == 1 and said.out == "" and len(json.loads((folder / "deep" / "all.json").read_text(encoding="utf-8"))) == 3
    run(capsys, folder / "theft.eml", "-f", "html", "-o", folder / "t.html")
    assert "Malicious" in (folder / "t.html").read_text(encoding="utf-8")
    run(capsys, folder, "-f", "html", "-o", folder / "pages")
    assert sorted(p.name for p in (folder / "pages").iterdir()) == ["clean.report.html", "theft.report.html", "wire.report.html"]
    text = run(capsys, folder)[1].out
    assert text.count("/100") == 3 and text.rstrip().splitlines()[-1].split()[2] == "clean.eml"
    assert run(capsys, folder, "-q")[1].out == ""


def test_cli_names_failed_files(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(report, "failures", lambda r: r.where("source LIKE '%clean%'").select("source", "ord", F.lit("ValueError: broken").alias("error")))
    code, said = run(capsys, folder, "-f", "summary")
    assert code == 1 and "failed to parse" in said.err and "clean.eml" in said.err


def test_catalogue():
    assert len(catalog.INDICATORS) == len(catalog.BY_ID) == 58 and len(json.loads(catalog.listing("json"))) == 58
    assert all(re.fullmatch(r"T\d{4}(\.\d{3})?", t) for x in catalog.INDICATORS for t in x[6])
    critical = [x[4] for x in catalog.INDICATORS if x[3] == "critical"]
    assert min(critical) > max(x[4] for x in catalog.INDICATORS if x[3] == "low") and "## URLs" in catalog.listing("markdown")


def test_analyzers_can_be_replaced(spark):
    parsed = parse.parse(messages.in_memory(spark, [("m", mail.wire_fraud())]))
    only = rules.findings(parsed, (), analyzers={"headers": rules.headers})
    assert {f.indicator_id[:3] for f in only.first().findings} == {"HDR"}
