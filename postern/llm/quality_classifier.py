"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each labelled row outside the fold adds to its class's count, sum and outer product, so means and
covariances come from all of them and only two small matrices reach the driver. The covariances are
shrunk towards the pooled one and towards its diagonal. A text's score is the logistic of the
difference of the two log densities (from the Mahalanobis distances by cached Cholesky factors) plus
the log prior ratio.

Null text is empty; its statistics are all those of an empty text. Repeated rows get the same score
each; a doc_id with labels of both classes counts as class 0, and each row of a doc_id is learned from.
Rows with a null doc_id or label are not learned from and are scored as held out. Without
learnable rows of both classes, every score is the share of class 1 (0.5 without any). An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import texts_of
from postern.llm.quality_rules import repeated_lines, repeated_words

#: Shares of the pooled covariance and of its diagonal.
POOL, DIAGONAL = 0.2, 0.1
PREDICT_AT = 0.3
#: Labels of twelve bytes each that are broadcast.
BROADCAST_LABELS = 1_000_000
_DIGITS, _UPPER, _MARKS, _ODD = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?'\"()-", b"#*$%&|<>@{}[]\\^~_=+/"
FEATURES = ("log_words", "log_word_length", "digits", "upper", "marks", "odd", "beyond_ascii", "distinct", "top_word", "repeated", "dup_lines", "log_line", "log_lines", "entropy")


def statistics(text: bytes) -> list[float]:
    """The document's statistics, transformed towards symmetry (logs of sizes, square roots of shares)."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    share = lambda chars: math.sqrt((len(text) - len(text.translate(None, chars))) / size)
    lines = text.count(b"\n") + 1
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    some = b[b > 0]
    tally = Counter(words)
    distinct, top = len(tally), max(tally.values(), default=0) / max(1, n)
    return [math.log1p(n), math.log1p(sum(map(len, words)) / max(1, n)), share(_DIGITS), share(_UPPER), share(_MARKS), share(_ODD), math.sqrt(float(b[128:].sum())), distinct / max(1, n), math.sqrt(top), math.sqrt(repeated_words(words) / max(1, n)), math.sqrt(repeated_lines(text) / lines), math.log1p(size / lines), math.log1p(lines), float(-(some * np.log2(some)).sum())]


def in_fold(doc_id: int | None) -> bool:
    """Held out: no label of these rows is learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


@dataclass
class Model:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    constants: list[float]  # log prior less half the log determinant
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.prior)
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, pool: float = POOL, diagonal: float = DIAGONAL) -> Model:
    d = len(FEATURES)
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where("quality in (0, 1) and doc_id is not null").where(learnable).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.select("doc_id", "text").where(learnable)
    # Few labels go to the texts, so that only labelled ones are measured; many are met by the measures, which are smaller than texts.
    if known.count() <= BROADCAST_LABELS:
        texts, known = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi"), F.broadcast(known)
    joined = texts.mapInArrow(_features, _FEATURES_SQL).join(known, "doc_id").select("quality", "x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), float).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.array(batch.column("quality").to_pylist())
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * (d + 1) ** 2), pa.int32()), pa.array(total.reshape(-1))], ["at", "value"])

    total = np.zeros(2 * (d + 1) ** 2)
    for r in joined.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    if min(n) < 2:
        return Model([], [], [], float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [total[k, 0, 1:] / n[k] for k in (0, 1)]
    own = [total[k, 1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - pool) * own[k] + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        constants.append(math.log(n[k] / n.sum()) - float(np.log(np.diag(low)).sum()))
    return Model(means, factors, constants, float(n[1] / n.sum()))


_FEATURES_SQL = "doc_id long, x binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.array(statistics(t)).tobytes() for t in texts_of(batch.column("text"))], pa.binary())], ["doc_id", "x"])


def score(docs: DataFrame, model: Model, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(np.array([statistics(t) for t in texts_of(batch.column("text"))]).reshape(-1, len(FEATURES)))
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([in_fold(k) for k in ids], pa.bool_()), pa.array(s), pa.array((s >= predict_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
