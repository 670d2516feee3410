"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

A bounded, documented sample of labelled rows (FIT_ROWS, taken by hash order) is hashed on the
executors; the model (2^16 weights) is fitted on the driver and Platt-calibrated on rows it did not
see. Every whole text is then scored in Arrow batches. Plain count rules reject first.

Nulls count as empty texts, have no words and fail the rule on length. Repeated rows get the same
verdict each; an empty table gives an empty result; without labels of both classes the model keeps
everything and the count rules alone decide. Extra columns pass through `keep` untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import texts_of

#: Labelled rows that fit and calibrate the model, at most.
FIT_ROWS = 2_000
BITS = 16
#: Documents of a lower calibrated probability of quality are rejected.
KEEP_AT = 0.3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_NOT_START = bytes(range(0x80, 0xC0))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0


def _scramble(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Hashed slots of words, word pairs and character trigrams, one array a kind (each kind has the weight of one)."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    # Plain ASCII is a byte a character; other texts are spread to four, so that no letter is split.
    b = (np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)).astype(np.uint64)
    tri = b[:-2] << np.uint64(42) | b[1:-1] << np.uint64(21) | b[2:]
    return [_scramble(h + np.uint64(1 << 40)), _scramble(h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 41)), _scramble(tri + np.uint64(1 << 42))]


def logit(model: Model, text: bytes, words: list[bytes]) -> float:
    return model.bias + sum(float(model.weights[x].mean()) for x in features(text, words) if len(x))


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    idx, val = [], []
    for x in features(text, text.split()):
        if len(x):
            slots, n = np.unique(x, return_counts=True)
            idx.append(slots)
            val.append(n / len(x))
    return (np.concatenate(idx), np.concatenate(val)) if idx else (np.zeros(0, np.int64), np.zeros(0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = 12, l2: float = 1e-7) -> Model:
    """Learns from `rows` labelled rows at most: those whose doc_id hashes lowest."""
    chosen = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [_sparse(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([i.astype(np.int32).tobytes() for i, _ in xs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in xs], pa.binary())], ["doc_id", "quality", "idx", "val"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(hashed, "doc_id long, quality int, idx binary, val binary").toArrow()
    return _train(got, epochs, l2)


def _train(got: pa.Table, epochs: int, l2: float) -> Model:
    data = sorted(zip(got.column("doc_id").to_pylist(), got.column("quality").to_pylist(), [np.frombuffer(x, np.int32) for x in got.column("idx").to_pylist()], [np.frombuffer(x, np.float32) for x in got.column("val").to_pylist()], strict=True), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], len(r[2])))
    y = np.array([r[1] for r in data], float)
    weights, total, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0
    if len(set(y.tolist())) < 2:
        return Model(weights, 0.0, 1.0, 20.0)
    balance = {0.0: 0.5 / max(1e-9, float((y == 0).mean())), 1.0: 0.5 / max(1e-9, float((y == 1).mean()))}
    train = [k for k in range(len(data)) if k % 4]
    held = [k for k in range(len(data)) if not k % 4]
    bias_total = 1e-8
    for _ in range(epochs):
        for k in train:
            idx, val = data[k][2], data[k][3]
            p = 1 / (1 + np.exp(-np.clip(bias + weights[idx] @ val, -30, 30)))
            g = (p - y[k]) * balance[y[k]]
            grad = g * val + l2 * weights[idx]
            total[idx] += grad * grad
            weights[idx] -= 0.5 * grad / np.sqrt(total[idx])
            bias_total += g * g
            bias -= 0.1 * g / np.sqrt(bias_total)
    z = np.array([bias + weights[data[k][2]] @ data[k][3] for k in held])
    return Model(weights, bias, *_platt(z, y[held]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels on the raw scores (Newton steps, smoothed targets)."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a - da, b - db
    return float(max(a, 1e-3)), float(b)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = x[:-1] * v + x[1:]
    pair = np.unique(pair, return_inverse=True)[1] if v > 2_000_000 else pair
    key = pair[:-1] * v + x[2:]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[where] > 1)
    hit = np.zeros(n, np.bool_)
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(lines) - len(set(lines))


def counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.translate(None, _NOT_START + SPACES))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeated_words(words)


def judge(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, only: bool = False) -> DataFrame:
    """The input's columns (or with `only` doc_id) with the counts, base_failed, quality (calibrated probability) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ["doc_id"] if only else docs.columns
    added = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())]
    kinds = {"int64": "long", "bool": "boolean", "double": "double"}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in added]
            for text in texts_of(batch.column("text")):
                words = text.split()
                c = counts(text, words)
                failed = c[0] < MIN_WORDS or 100 * c[4] > 50 * c[0]
                p = 1 / (1 + np.exp(-np.clip(m.slope * logit(m, text, words) + m.offset, -30, 30)))
                for to, x in zip(out, (*c, failed, float(p), not failed and p >= keep_at), strict=True):
                    to.append(bool(x) if isinstance(x, np.bool_) else x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(x, t) for x, (_, t) in zip(out, added, strict=True))], [*own, *(n for n, _ in added)])

    kept = [f for f in docs.schema.fields if f.name in own]
    clash = {n for n, _ in added} & {f.name for f in kept}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named as the verdict's; rename them or use only=True")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {kinds[str(t)]}" for n, t in added)])
    return docs.select(*own, *["text"] * ("text" not in own)).mapInArrow(rows, schema)


def keep(docs: DataFrame, model: Model, keep_at: float = KEEP_AT) -> DataFrame:
    """`docs` without the rejected ones, columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            verdicts = []
            for text in texts_of(batch.column("text")):
                words = text.split()
                good = len(words) >= MIN_WORDS and 100 * repeated_words(words) <= 50 * len(words)
                verdicts.append(bool(good and 1 / (1 + np.exp(-np.clip(m.slope * logit(m, text, words) + m.offset, -30, 30))) >= keep_at))
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), fit(docs, labels), only=True).withColumnRenamed("quality", "p_quality")
