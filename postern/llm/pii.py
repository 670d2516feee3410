"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Each kind has wide candidate patterns (plain, spaced, dotted or spelt out). Three families of labelers
vote yes, no or nothing on a candidate: patterns with their checks (lengths, ranges, check digits),
gazetteers (known domain endings, reserved ranges, trunk codes) and contexts (words before the span, its
neighbours). Only the counts of each combination of votes and shape features are gathered, over all
documents; there are a few hundred combinations, whatever the input. EM estimates each labeler's
reliability from them, and a logistic span classifier is trained on the resulting soft labels. It adds
the candidates it is sure of to the base spans, which always stay.

Null text is empty and has no spans. Repeated rows get the same spans each and count each time. With no
candidates anywhere the base spans alone are returned. An empty table gives an empty result. Extra
columns pass through `redact` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone")
#: A candidate beyond the base spans is added at this probability.
ADD_AT = 0.9
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits does, or has just been left: a later start in the run ends the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @ backwards: linear in long runs without one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# Endings, words and ranges that the gazetteer and context labelers know.
ENDINGS = frozenset("com org net edu gov info io co de fr es uk eu ch at be nl it us ca au jp cn in br".split())
CONTEXT = {
    0: re.compile(r"(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo|escriba|schreiben)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    1: re.compile(r"(?:\bip\b|address|host|server|adresse|direcci[oó]n|ping|from)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    2: re.compile(r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|account|iban|pan)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    3: re.compile(r"(?:phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|call|mobile|handy|fax|cell|whatsapp|ruf)\W{0,4}(?:\w+\W+){0,2}$", re.I),
}
NOT_PERSONAL = re.compile(r"(?:\bv|version|section|chapter|isbn|order|serial|model|figure|table|look|looked|looking)\W{0,4}$", re.I)
#: Wide candidates, each linear in the text.
WIDE = {
    0: (re.compile(r"(?<![\w.])[\w.+-]{1,64}\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?[\w-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?)[\w-]{1,63}){1,4}", re.I), re.compile(r"(?<![\w.])[\w.+-]{1,64} at [\w-]{1,63}(?: dot [\w-]{1,63}){1,4}(?!\w)", re.I)),
    1: (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[(]\.[\])]\s?[0-9]{1,3}){3}(?![0-9])"),),
    2: (re.compile(r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9.])"),),
    3: (re.compile(r"(?<![\w+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w|\.\w)"), re.compile(r"(?<![\w+.])00[1-9][0-9]{0,2}[ .()-]?[0-9][0-9 ().-]{6,14}[0-9](?!\w)")),
}
#: What each wide pattern's match holds in any case, told at a glance: a text without it is not searched.
_AT = re.compile(r"[\[({<]\s?(?:[aA][tT]|@)\s?[\])}>]")
_DOT = re.compile(r"[\[(]\.[\])]")
LABELERS = ("form", "check", "gazetteer", "context", "neighbours", "length")


def _votes(kind: int, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 yes, -1 no, 0 nothing."""
    span = text[start:end]
    d = _digits(span)
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    form = 1 if base else 0
    if kind == 0:
        parts = re.split(r"[.\s\[\](){}<>]+", span.lower())
        parts = [p for p in parts if p]
        check = 1 if all(p.strip("-") for p in parts) else -1
        gazetteer = 1 if parts[-1] in ENDINGS else -1
        length = 1 if 6 <= len(span) <= 80 else -1
    elif kind == 1:
        parts = [int(p) for p in re.findall(r"[0-9]+", span) if len(p) < 10]
        check = 1 if len(parts) == 4 and max(parts) <= 255 else -1
        gazetteer = -1 if parts[:1] == [0] or parts[:1] and 224 <= parts[0] <= 255 else 1
        length = 1 if 7 <= len(d) + 3 <= 15 else -1
    elif kind == 2:
        check = 1 if luhn(d) else -1
        gazetteer = 1 if d[:1] in ("3", "4", "5", "6") else -1
        length = 1 if len(d) in (13, 15, 16, 19) else -1
    else:
        check = 1 if 9 <= len(d) <= 15 else -1
        gazetteer = 1 if span[0] == "+" or d[:2] == "00" or d[:3] not in ("000", "123") and d[3:6] == "555" else 0
        length = 1 if 10 <= len(d) <= 13 else -1
    context = 1 if CONTEXT[kind].search(before) else -1 if NOT_PERSONAL.search(before) else 0
    neighbours = -1 if before[-1:].isalnum() or after.isalnum() or before[-1:] in ("/", "=", "#", "$") and before else 1
    return form, check, gazetteer, context, neighbours, length


def candidates(text: str) -> Iterator[tuple[int, int, int, bool, tuple[int, ...]]]:
    """kind, start, end, whether a base span, votes."""
    base = base_spans(text)
    taken = [[(a, b) for k, a, b in base if k == kind] for kind in range(4)]
    for kind, a, b in base:
        yield kind, a, b, True, _votes(kind, text, a, b, True)
    folded = text.lower()
    has = ((_AT.search(text), " at " in folded), (_DOT.search(text),), (True,), (True, True))
    digits = any(c in text for c in "0123456789")
    for kind, patterns in WIDE.items():
        if kind and not digits:
            continue
        mine = taken[kind]
        for pattern, may in zip(patterns, has[kind], strict=True):
            if not may:
                continue
            for m in pattern.finditer(text):
                a, b = m.span()
                if all(b <= x or y <= a for x, y in mine):
                    mine.append((a, b))
                    yield kind, a, b, False, _votes(kind, text, a, b, False)


@dataclass
class Model:
    """For each kind: weights of the span classifier over the votes (yes and no apart) and its bias."""

    weights: np.ndarray
    bias: np.ndarray
    reliability: dict[str, list[float]] = field(default_factory=dict)

    def probability(self, kind: int, votes: tuple[int, ...]) -> float:
        z = float(self.bias[kind] + self.weights[kind] @ _inputs(votes))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(votes: tuple[int, ...]) -> np.ndarray:
    return np.array([*(v > 0 for v in votes), *(v < 0 for v in votes)], float)


def fit(docs: DataFrame) -> Model:
    """Counts vote combinations over all documents, then runs EM and the classifier on the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch.column("text")):
                tally.update((k, v) for k, _, _, _, v in candidates(t.decode()))
        keys = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), pa.array([tally[k] for k in keys], pa.int64())], ["kind", "votes", "n"])

    # At most 4 kinds times 3 ** 6 combinations reach the driver.
    got = docs.select("text").mapInArrow(count, "kind int, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return _learn(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in got))


def _learn(counts: list[tuple[int, tuple[int, ...], int]]) -> Model:
    m = len(LABELERS)
    model = Model(np.zeros((4, 2 * m)), np.full(4, -30.0))
    for kind in range(4):
        rows = [(v, n) for k, v, n in counts if k == kind]
        if not rows:
            continue
        v, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        soft, right = _em(v, n)
        model.reliability[KINDS[kind]] = right.tolist()
        x = np.hstack([v > 0, v < 0]).astype(float)
        model.weights[kind], model.bias[kind] = _logistic(x, soft, n)
    return model


def _em(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Soft labels of each vote combination, and each labeler's share of right votes. Priors keep labelers from swapping sides."""
    right, prior = np.full(votes.shape[1], 0.8), 0.5
    for _ in range(rounds):
        log = np.log(right / (1 - right))
        z = np.log(prior / (1 - prior)) + votes @ log
        soft = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        agree = ((votes > 0) * soft[:, None] + (votes < 0) * (1 - soft[:, None])) * n[:, None]
        cast = (votes != 0) * n[:, None]
        right = np.clip((agree.sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.51, 0.99)
        prior = float(np.clip((soft @ n + 1) / (n.sum() + 2), 0.01, 0.99))
    return soft, right


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + l2 * w
        hess = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w[:-1], float(w[-1])


def find(text: str, model: Model, add_at: float = ADD_AT) -> list[tuple[int, int, int]]:
    """All spans of a text: the base spans and the candidates that the classifier is sure of."""
    return sorted((k, a, b) for k, a, b, base, votes in candidates(text) if base or model.probability(k, votes) >= add_at)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_all, every = [], []
            for t in texts_of(batch.column("text")):
                text = t.decode()
                base_all.append(base_spans(text))
                every.append(_joined(find(text, shared.value)))
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base_all], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base_all]), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; overlapping spans make one, named after the first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else redacted(x, shared.value) for x in batch.column("text").to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(rows, docs.schema)


def redacted(text: str, model: Model) -> str:
    out, done = [], 0
    for kind, a, b in sorted(find(text, model), key=lambda s: (s[1], s[0])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def op9(docs: DataFrame) -> DataFrame:
    return spans(docs, fit(docs))
