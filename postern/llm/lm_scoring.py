"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

Training tokens are counted exactly, a chunk at a time and then by hash shard. A word's continuations are
its distinct successors in the whole training text: the pair shards, which hold each distinct pair once,
count them by history word and tell the words' shards. An n-gram of count c
is put into its shard's Bloom filter once for each of the levels 1..q(c), q logarithmic. A count is
read back by probing level 1, 2, ... until one is absent, so estimates never fall below the level
that was stored. Word counts, continuation counts and word-pair counts are all kept so, and
Witten-Bell smoothing turns them into probabilities. What they are divided by is summed from the levels where
they are stored (a history's pairs, and all words), so that over the vocabulary and one unseen word the
probabilities of a history add up to one, but for the filter's false positives.

The filter takes BITS_PER_ENTRY bits for each entry. Up to `broadcast_bytes` it is broadcast; a larger
one stays in its shards, which answer the probes of every chunk in place with the same bits, so both ways
score alike and neither sends an unbounded filter anywhere.

Null text is an empty text: one end token. A null doc_id is scored as held out. Repeated rows each get a
score (and count each time in training). An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import chunked, mix, open_chunk, pack, total_bytes, unpack, write_table

#: Raw text bytes for each hash shard; a shard is handled by one task in memory.
SHARD_BYTES = 8 << 20
BITS_PER_ENTRY, HASHES = 10, 5
#: Keys that a filter is asked for at once.
PROBES = 1 << 17
#: Quantisation: level q stands for counts of about LOG_BASE ** (q - 1).
LOG_BASE = 1.25
BROADCAST_BYTES = 256 << 20
#: The end token (also the history of a document's first word); no word holds a tab.
END = b"\t"
WORD, PAIR, CONT = 0, 1, 2
_CONT = np.uint64(0xA5A5A5A55A5A5A5A)
_LEVELS = np.arange(0, 256)
#: Mean count of a level.
VALUES = np.concatenate([[0.0], (np.ceil(LOG_BASE ** (_LEVELS[1:] - 1)) + np.maximum(np.ceil(LOG_BASE ** _LEVELS[1:]) - 1, np.ceil(LOG_BASE ** (_LEVELS[1:] - 1)))) / 2])


def level_of(count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.int64)
    some = count > 0
    out[some] = 1 + np.floor(np.log(count[some]) / np.log(LOG_BASE) + 1e-9).astype(np.int64)
    return np.minimum(out, 255)


def _salt(level: int) -> np.uint64:
    return np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@dataclass
class Filter:
    """Bloom filters of all shards of a kind, end to end: bits, and each shard's first bit and number of bits."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, levels: np.ndarray) -> Filter:
        """One shard."""
        m = max(64, int(levels.sum()) * BITS_PER_ENTRY + 7 & ~7)
        made = Filter(np.zeros(m // 8, np.uint8), np.zeros(1, np.int64), np.array([m], np.int64))
        bits = np.zeros(m, np.bool_)
        level = 1
        while len(keys):
            for at in made._places(keys, np.zeros(len(keys), np.int64), level):
                bits[at] = True
            level += 1
            keys, levels = keys[levels >= level], levels[levels >= level]
        made.bits = np.packbits(bits, bitorder="little")
        return made

    def _places(self, keys: np.ndarray, shards: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = mix(keys + _salt(level))
        b = mix(a) | np.uint64(1)
        size, first = self.size[shards].astype(np.uint64), self.first[shards]
        for _ in range(HASHES):
            yield (a % size).astype(np.int64) + first
            a = a + b

    def levels(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Probes level after level until one is absent, so many keys at a time that the probes stay small."""
        return np.concatenate([self._levels(keys[k : k + PROBES], shards[k : k + PROBES]) for k in range(0, max(1, len(keys)), PROBES)])

    def _levels(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for level in range(1, 256):
            a = mix(keys[alive] + _salt(level))
            b = mix(a) | np.uint64(1)
            for _ in range(HASHES):
                s = shards[alive]
                at = (a % self.size[s].astype(np.uint64)).astype(np.int64) + self.first[s]
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                alive, a, b = alive[hit], (a + b)[hit], b[hit]
            if not len(alive):
                break
            out[alive] = level
        return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


class Chunk:
    """A chunk's tokens as numbers: `ids` of all documents end to end (END, words, END, words, ..., END)."""

    def __init__(self, blob: bytes, n_shards: int, pairs: bool = True) -> None:
        self.doc_ids, texts = open_chunk(blob)
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[END]
        ids: list[int] = [0]
        ends = []
        for t in texts:
            ids += map(number.__getitem__, t.lower().split())
            ids.append(0)
            ends.append(len(ids))
        self.tokens = list(number)
        self.ids = np.array(ids, np.int64)
        self.ends = np.array(ends, np.int64)  # just behind each document's end token
        self.sizes = np.diff(self.ends, prepend=1)
        self.training = np.array([not held_out(d) for d in self.doc_ids], np.bool_)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.tokens), np.uint64, len(self.tokens))
        self.word_shard = (self.hash % np.uint64(n_shards)).astype(np.int64)
        self.in_training = np.repeat(self.training, self.sizes)
        if not pairs:
            return
        h = self.hash
        self.pair_key = mix(h[self.ids[:-1]] * np.uint64(0xD6E8FEB86659FD93) + h[self.ids[1:]])
        self.pair_shard = (self.pair_key >> np.uint64(40)) % np.uint64(n_shards)
        self.pair_key &= np.uint64((1 << 40) - 1)

    def pairs(self, all_documents: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """shard, keys (ascending), training counts, one place of each key; held-out pairs (count 0) on request."""
        use = np.arange(len(self.pair_key)) if all_documents else np.flatnonzero(self.in_training)
        both = self.pair_shard[use] << np.uint64(40) | self.pair_key[use]
        keys, first, where = np.unique(both, return_index=True, return_inverse=True)
        counts = np.bincount(where, self.in_training[use], minlength=len(keys)).astype(np.int64)
        shard = (keys >> np.uint64(40)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield int(shard[a]), keys[a:b] & np.uint64((1 << 40) - 1), counts[a:b], use[first[a:b]]


def _thin(x: np.ndarray) -> np.ndarray:
    """40-bit keys in five bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(x: memoryview) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _counted(chunks: DataFrame, n_shards: int, kind: int, all_pairs: bool = False) -> DataFrame:
    """shard, chunk, payload: what each chunk tells each shard of a kind. Pairs come with their history words' hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                c = Chunk(blob, n_shards, kind == PAIR)
                out = []
                if kind == PAIR:
                    for shard, keys, n, at in c.pairs(all_pairs):
                        history, which = np.unique(c.ids[at], return_inverse=True)
                        out.append((shard, pack([_thin(keys), n.astype(np.uint32), which.astype(np.uint32), c.hash[history]])))
                else:
                    counts = np.bincount(c.ids[1:][c.in_training], minlength=len(c.tokens))
                    order = np.argsort(c.word_shard, kind="stable")
                    cuts = np.flatnonzero(np.diff(c.word_shard[order], prepend=-1))
                    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                        own = order[a:b]
                        out.append((int(c.word_shard[own[0]]), pack([b" ".join(c.tokens[k] for k in own.tolist()), counts[own].astype(np.uint32), c.hash[own]])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["shard", "chunk", "payload"])

    return chunks.mapInArrow(rows, "shard int, chunk long, payload binary")


_REPLY = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64()), ("mass", pa.float64())])
_REPLY_SQL = "kind int, shard int, chunk long, payload binary, distinct long, total long, mass double"


def _told(got: pa.Table) -> list[tuple[int, list[memoryview]]]:
    return [(c, unpack(p)) for c, p in sorted(zip(got.column("chunk").to_pylist(), got.column("payload").to_pylist(), strict=True))]


def _reply(kind: int, number: int, made: Filter, count: np.ndarray, out: list[tuple[int, bytes]]) -> pa.Table:
    n = len(out)
    stats = int((count > 0).sum()), int(count.sum()), float(VALUES[level_of(count)].sum())
    return pa.Table.from_arrays([pa.array([kind] * (n + 1), pa.int32()), pa.array([number] * (n + 1), pa.int32()), pa.array([*(c for c, _ in out), None], pa.int64()), pa.array([*(p for _, p in out), made.bits.tobytes()], pa.binary()), pa.array([None] * n + [stats[0]], pa.int64()), pa.array([None] * n + [stats[1]], pa.int64()), pa.array([None] * n + [stats[2]], pa.float64())], schema=_REPLY)


def _pairs_answered(counted: DataFrame, n_shards: int, answer: bool) -> DataFrame:
    """A pair shard sums what the chunks told it and builds its filter; on request it answers each chunk with its pairs' levels.

    Rows of kind CONT tell a word shard how many distinct training pairs of this shard begin with each of its words, and
    what their stored levels stand for together.
    """

    def shard(key: tuple, got: pa.Table) -> pa.Table:
        number, told = key[0].as_py(), _told(got)
        every = [_wide(x[0]) for _, x in told]
        keys, first, where = np.unique(np.concatenate(every), return_index=True, return_inverse=True)
        count = np.bincount(where, np.concatenate([np.frombuffer(x[1], np.uint32) for _, x in told]), minlength=len(keys))
        history = np.concatenate([np.frombuffer(x[3], np.uint64)[np.frombuffer(x[2], np.uint32)] for _, x in told])[first]
        made = Filter.build(keys[count > 0], level_of(count[count > 0]))
        out = []
        if answer:
            levels = made.levels(keys, np.zeros(len(keys), np.int64)).astype(np.uint8)[where]
            cuts = np.cumsum([0, *map(len, every)])
            out = [(c, pack([levels[a:b]])) for (c, _), a, b in zip(told, cuts, cuts[1:], strict=False)]
        words, which, types = np.unique(history[count > 0], return_inverse=True, return_counts=True)
        mass = np.bincount(which, VALUES[level_of(count[count > 0])], minlength=len(words))
        to = (words % np.uint64(n_shards)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        own = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
        n = len(own)
        conts = pa.Table.from_arrays([pa.array([CONT] * n, pa.int32()), pa.array([int(to[x[0]]) for x in own], pa.int32()), pa.array([None] * n, pa.int64()), pa.array([pack([words[x], types[x].astype(np.uint32), mass[x]]) for x in own], pa.binary()), *(pa.array([None] * n, t) for t in (pa.int64(), pa.int64(), pa.float64()))], schema=_REPLY)
        return pa.concat_tables([_reply(PAIR, number, made, count, out), conts])

    return counted.groupBy("shard").applyInArrow(shard, _REPLY_SQL)


def _words_answered(counted: DataFrame, conts: DataFrame) -> DataFrame:
    """A word shard sums what the chunks and the pair shards told it, builds its filter and answers each chunk.

    Rows with a chunk answer it: exact counts and stored levels of its words. The row without a chunk
    holds the shard's filter, and how many distinct words and tokens it counted.
    """

    def shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        number, told = key[0].as_py(), _told(left)
        known: dict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        where = [np.fromiter(map(known.__getitem__, bytes(x[0]).split(b" ")), np.int64) for _, x in told]
        count, cont, mass, keys = (np.zeros(len(known), t) for t in (np.int64, np.int64, np.float64, np.uint64))
        for at, (_, x) in zip(where, told, strict=True):
            count[at] += np.frombuffer(x[1], np.uint32)
            keys[at] = np.frombuffer(x[2], np.uint64)
        order = np.argsort(keys)
        for payload in right.column("payload").to_pylist():
            words, types, part = unpack(payload)
            # Each word's hash comes once from a pair shard, and from one of its own chunks.
            at = order[np.searchsorted(keys, np.frombuffer(words, np.uint64), sorter=order)]
            cont[at] += np.frombuffer(types, np.uint32)
            mass[at] += np.frombuffer(part, np.float64)
        made = Filter.build(np.concatenate([keys, keys ^ _CONT]), level_of(np.concatenate([count, cont])))
        zero = np.zeros(len(keys), np.int64)
        levels, types = made.levels(keys, zero).astype(np.uint8), made.levels(keys ^ _CONT, zero).astype(np.uint8)
        return _reply(WORD, number, made, count, [(c, pack([count[at], levels[at], types[at], mass[at].astype(np.float32)])) for at, (c, _) in zip(where, told, strict=True)])

    return counted.groupBy("shard").cogroup(conts.groupBy("shard")).applyInArrow(shard, _REPLY_SQL)


def _gather(pieces: DataFrame, n_shards: int) -> Filter:
    rows = sorted((r["shard"], bytes(r["payload"])) for r in pieces.toLocalIterator())
    size = np.full(n_shards, 64, np.int64)
    first = np.zeros(n_shards, np.int64)
    parts, at = [b"\0" * 8], 64  # shards without a pair probe these empty bits
    for shard, bits in rows:
        size[shard], first[shard] = 8 * len(bits), at
        parts.append(bits)
        at += 8 * len(bits)
    return Filter(np.frombuffer(b"".join(parts), np.uint8), first, size)


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: see the module's text."""
    spark = docs.sparkSession
    chunks = chunked(docs)
    n_shards = max(1, -(-total_bytes(chunks) // SHARD_BYTES))
    pairs = write_table(_pairs_answered(_counted(chunks, n_shards, PAIR), n_shards, False), "pairs")
    conts = pairs.where(F.col("kind") == CONT).select("shard", "payload")
    answers = write_table(_words_answered(_counted(chunks, n_shards, WORD), conts), "words")
    filters = answers.unionByName(pairs.where(F.col("kind") == PAIR)).where("chunk is null")
    sums = filters.groupBy("kind").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n"), F.sum("mass").alias("mass"), F.sum(F.length("payload")).alias("bytes")).collect()
    by = {r["kind"]: r for r in sums}
    v, n, mass = (by[WORD]["v"], by[WORD]["n"], by[WORD]["mass"]) if WORD in by else (0, 0, 0.0)
    shared = None
    if PAIR not in by or by[PAIR]["bytes"] <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(_gather(pairs.where(F.col("kind") == PAIR).select("shard", "payload"), n_shards))
    else:
        asked = write_table(_pairs_answered(_counted(chunks, n_shards, PAIR, True), n_shards, True), "answers")
        answers = answers.unionByName(asked.where(F.col("kind") == PAIR))
    answers = answers.where("chunk is not null").select("chunk", "kind", "shard", "payload")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = [_scored(Chunk(blob, n_shards), right, shared.value if shared else None, v, n, mass) for blob in left.column("blob").to_pylist()]
        return pa.concat_tables(tables) if tables else _SCORE.empty_table()

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(c: Chunk, answers: pa.Table, pair_filter: Filter | None, v: int, n: int, mass: float) -> pa.Table:
    count, level, cont, told = (np.zeros(len(c.tokens), t) for t in (np.int64, np.int64, np.int64, np.float64))
    order = np.argsort(c.word_shard, kind="stable")
    edges = np.searchsorted(c.word_shard[order], np.arange(int(c.word_shard.max()) + 2))
    pair_levels = None
    if pair_filter is None:
        pair_levels = np.zeros(len(c.pair_key), np.int64)
        places = {s: keys for s, keys, _, _ in c.pairs(True)}
    for kind, shard, payload in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True):
        parts = unpack(payload)
        if kind == WORD:
            own = order[edges[shard] : edges[shard + 1]]
            count[own], level[own], cont[own], told[own] = (np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.uint8, np.uint8, np.float32), strict=True))
        elif pair_levels is not None:
            at = np.flatnonzero(c.pair_shard == shard)
            pair_levels[at] = np.frombuffer(parts[0], np.uint8)[np.searchsorted(places[shard], c.pair_key[at])]
    if pair_levels is None:
        # Frequent pairs are probed level after level: once a chunk, not once a place.
        both = c.pair_shard << np.uint64(40) | c.pair_key
        del c.pair_shard, c.pair_key
        keys, where = np.unique(both, return_inverse=True)
        del both
        pair_levels = pair_filter.levels(keys & np.uint64((1 << 40) - 1), (keys >> np.uint64(40)).astype(np.int64))[where]
    whole = n + 0.5 * (v + 1)
    prev, cur = c.ids[:-1], c.ids[1:]
    base = np.log10((count + 0.5) / whole)[cur]
    seen, types = VALUES[level], VALUES[cont]
    pair = np.minimum(VALUES[pair_levels], seen[cur])
    # Both denominators are sums of what the levels stand for, so that each history's probabilities add up to one.
    p0 = (seen[cur] + 0.5) / (mass + 0.5 * (v + 1))
    history = told[prev]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(history > 0, (pair + (types[prev] + 1) * p0) / (history + types[prev] + 1), p0)
    starts = c.ends - c.sizes - 1
    sums = lambda x: np.add.reduceat(x, starts)
    return pa.Table.from_arrays([pa.array(c.doc_ids, pa.int64()), pa.array(~c.training), pa.array(c.sizes, pa.int64()), pa.array(sums((count[cur] > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(starts), n), pa.int64()), pa.array(sums(base)), pa.array(sums(np.log10(p)))], schema=_SCORE)


def op1(docs: DataFrame) -> DataFrame:
    return score(docs)
