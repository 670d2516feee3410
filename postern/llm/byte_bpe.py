"""Byte-level BPE: a segment tree over byte positions keeps the leftmost minimum pair rank of each piece.

A piece (one match of the pattern) is merged by taking the tree's root (lowest rank, then leftmost),
joining that pair and updating the leaves of its live neighbours in logarithmic time. So a piece of
n bytes costs O(n log n), however long it is. Pieces recur, so each Python worker keeps the ids of
pieces it has met, in a cache of bounded size.

Null text is empty and gives no ids. Any bytes decode; ids unknown to the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postern.llm.common import texts_of

#: Pieces that a worker's cache holds before it starts anew, and the longest piece that it takes.
CACHE_PIECES, CACHE_BYTES = 400_000, 64
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by repeatedly joining the adjacent pair of lowest rank, leftmost first."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length()  # one leaf for each pair of neighbours
    get = ranks.get
    # A node is rank << 32 | position, so the smaller node is the lower rank and then the further left.
    tree = [_NONE << 32] * (2 * size)
    for k in range(n - 1):
        r = get(piece[k : k + 2])
        if r is not None:
            tree[size + k] = r << 32 | k
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    ends = list(range(1, n + 1))  # of the live part that starts here
    before = list(range(-1, n))  # start of the live part to the left

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            best = value if value < other else other
            at >>= 1
            if tree[at] == best:
                break
            tree[at] = value = best

    while (top := tree[1]) >> 32 < _NONE:
        left = top & 0xFFFFFFFF
        right = ends[left]
        end = ends[right]
        ends[left] = end
        put(right, _NONE << 32) if right < n - 1 else None
        if end < n:
            before[end] = left
            r = get(piece[left : ends[end]])
            put(left, _NONE << 32 if r is None else r << 32 | left)
        else:
            put(left, _NONE << 32)
        prior = before[left]
        if prior >= 0:
            r = get(piece[prior:end])
            put(prior, _NONE << 32 if r is None else r << 32 | prior)
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : ends[k]]])
        k = ends[k]
    return out


class Coder:
    """Encodes and decodes whole texts; one a Python worker (see `coder`)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.array(merge(raw, self.ranks), "<u4").tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, make = self.cache.get, self.ids
        return b"".join([get(p) or make(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(load_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary: the bytes that the ids stand for)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [c.encode(t.decode()) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As `encode`, with digests in place of the ids and bytes, so that these need not leave the worker."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ids = [c.encode(t.decode()) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(c.decode(x)) for x in ids), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(docs: DataFrame) -> DataFrame:
    import public_tokenizers as vocabularies

    return digests(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
