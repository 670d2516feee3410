"""Exact removal of long repeated substrings by prefix-free parsing and suffix arrays of the dictionary.

A rolling hash over GRAM-byte grams picks triggers: the grams that are lowest in some window of WINDOW
bytes. Triggers depend on content only, so equal windows hold the same trigger at the same place, and
they cut each text into phrases (a trigger and its reach to both sides, at most 2 * WINDOW - GRAM bytes).
Repetitive text repeats phrases, so:

1. every chunk of documents sends its distinct trigger hashes to hash shards, which answer which of
   them occur in several documents (unique text ends here);
2. chunks send their distinct phrases with those triggers (the dictionary, each with its smallest
   doc_id) to the trigger's shard. It sorts the suffixes of the distinct phrases into a suffix array;
   runs of suffixes that agree in their first WINDOW bytes are one class, whose smallest doc_id says
   for every place of a phrase whether an earlier document holds that window;
3. chunks walk their parse (the phrases in text order) and cut the bytes that such windows cover.

A trigger found in more than HOT places sends its windows one by one to the shards of their own
hashes instead, so that no shard gathers the many surroundings of one common passage. All bytes are
compared as bytes in step 2; hashes only bring candidates together.

Null text is empty; nothing is removed from texts under WINDOW bytes. A null doc_id counts as larger
than all others. Rows of one doc_id never remove from each other. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postern.llm.common import chunked, mix, open_chunk, pack, total_bytes, unpack, write_table

WINDOW, GRAM = 50, 24
REACH = WINDOW - GRAM  # a window starts this far before its trigger at most
SHARD_BYTES = 8 << 20
#: Places of one trigger (over all documents) from which its windows go out singly.
HOT = 20_000
#: Bytes of whole documents that are hashed at once.
BLOCK_BYTES = 1 << 20
_LAST = (1 << 63) - 1
_KEY = np.uint64((1 << 40) - 1)
_40 = np.uint64(40)


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    x = np.zeros(len(b) + 8, np.uint64)
    x[: len(b)] = b
    n = len(b)
    for width in (1, 2, 4):
        x[: n + 8 - width] = x[: n + 8 - width] << np.uint64(8 * width) | x[width:]
        x[n + 8 - width :] = 0
    return x[:n]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    have, m = 1, x
    while have * 2 <= width:
        m, have = pick(m[:-have], m[have:]), have * 2
    return pick(m[: len(x) - width + 1], m[width - have :]) if have < width else m


def triggers(b: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the triggers. left: bytes from each place to the end of its document."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = _words(b)
    grams = n - GRAM + 1
    h = mix(x[:grams] * np.uint64(0x9E3779B97F4A7C15) + x[8 : 8 + grams] * np.uint64(0xC2B2AE3D27D4EB4F) + x[16 : 16 + grams] * np.uint64(0x165667B19E3779F9)) | np.uint64(1)
    low = _sliding(h, REACH + 1, np.minimum)
    low = np.where(left[: len(low)] >= WINDOW, low, np.uint64(0))  # windows that would leave their document choose nothing
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), REACH + 1, np.maximum) == h)
    return at, h[at]


class Block:
    """Some whole documents of a chunk, end to end."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        self.ids = ids
        self.raw = b"".join(texts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.order = np.array([_LAST if d is None else d for d in ids], np.int64)
        left = self.ends[self.doc] - np.arange(len(self.bytes))
        self.at, self.hash = triggers(self.bytes, left)


def blocks(blob: bytes) -> Iterator[Block]:
    ids, texts = open_chunk(blob)
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield Block(ids[first:k], texts[first:k])
            first, size = k, 0
        size += len(t)
    if texts:
        yield Block(ids[first:], texts[first:])


def _split(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    """shard << 40 | 40 hash bits."""
    return (hashes >> _40) % np.uint64(n_shards) << _40 | hashes & _KEY


def _thin(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(x: memoryview) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


_TOLD = "shard int, chunk long, payload binary"


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["shard", "chunk", "payload"])


def _trigger_sets(chunks: DataFrame, n_shards: int) -> DataFrame:
    """Step 1: each chunk's distinct trigger keys, with their places and whether two documents hold them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for b in blocks(blob):
                    keys.append(_split(b.hash, n_shards))
                    docs.append(b.order[b.doc[b.at]])
                key, doc = np.concatenate(keys), np.concatenate(docs)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                if not len(first):
                    continue
                n = np.diff(first, append=len(key)).astype(np.uint32)
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                key = key[first]
                shard = (key >> _40).astype(np.int64)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                yield _rows([(int(shard[a]), chunk, pack([_thin(key[a:b]), n[a:b], several[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True)])

    return chunks.mapInArrow(rows, _TOLD)


def _table(shard: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows([(shard, c, p) for c, p in rows])])


def _told(got: pa.Table) -> list[tuple[int, list[memoryview]]]:
    return [(c, unpack(p)) for c, p in sorted(zip(got.column("chunk").to_pylist(), got.column("payload").to_pylist(), strict=True))]


def _repeated(key: tuple, got: pa.Table, hot_places: int) -> pa.Table:
    """A shard answers each chunk: which of its keys occur in several documents, and which of those are hot."""
    told = _told(got)
    every = [_wide(x[0]) for _, x in told]
    _, where = np.unique(np.concatenate(every), return_inverse=True)
    places = np.bincount(where, np.concatenate([np.frombuffer(x[1], np.uint32) for _, x in told]))
    inside = np.bincount(where, np.concatenate([np.frombuffer(x[2], np.bool_) for _, x in told])) > 0
    again = inside | (np.bincount(where) > 1)
    hot = places > hot_places
    out, at = [], 0
    for (chunk, _), keys in zip(told, every, strict=True):
        mine = where[at : at + len(keys)]
        at += len(keys)
        if (yes := again[mine]).any():
            out.append((chunk, pack([_thin(keys[yes]), hot[mine][yes]])))
    return _table(key[0].as_py(), out)


class Parse:
    """A chunk's phrases with triggers that other documents hold, and where each stands in the text."""

    def __init__(self, blob: bytes, answers: list[tuple[int, bytes]], n_shards: int) -> None:
        keys, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.bool_)]
        for shard, payload in answers:
            k, h = unpack(payload)
            keys.append(_wide(k) | np.uint64(shard) << _40)
            hot.append(np.frombuffer(h, np.bool_))
        known, hot = np.concatenate(keys), np.concatenate(hot)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        self.blocks, self.uses = list(blocks(blob)), []
        self.phrases: dict[bytes, int] = {}  # trigger's offset and bytes; a lone window has offset 255
        self.least: list[int] = []
        self.shard: list[int] = []
        for b in self.blocks:
            key = _split(b.hash, n_shards)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            held = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
            place, heat = b.at[held], hot[at[held]]
            doc = b.doc[place]
            first, last = np.maximum(b.starts[doc], place - REACH), np.minimum(b.ends[doc], place + WINDOW)
            uses = []
            shards = (key[held] >> _40).astype(np.int64).tolist()
            for p, a, e, d, s, h in zip(place.tolist(), first.tolist(), last.tolist(), b.order[doc].tolist(), shards, heat.tolist(), strict=True):
                if not h:
                    uses.append((a, e, self._use(bytes((p - a,)) + b.raw[a:e], d, s), d))
                    continue
                for w in range(a, e - WINDOW + 1):
                    window = b.raw[w : w + WINDOW]
                    uses.append((w, w + WINDOW, self._use(b"\xff" + window, d, zlib.crc32(window) % n_shards), d))
            self.uses.append(uses)

    def _use(self, phrase: bytes, doc: int, shard: int) -> int:
        k = self.phrases.setdefault(phrase, len(self.least))
        if k == len(self.least):
            self.least.append(doc)
            self.shard.append(shard)
        elif doc < self.least[k]:
            self.least[k] = doc
        return k

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        shard = np.array(self.shard, np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            yield int(shard[order[a]]), order[a:b]


def _answers(got: pa.Table) -> list[tuple[int, bytes]]:
    return sorted(zip(got.column("shard").to_pylist(), got.column("payload").to_pylist(), strict=True))


def _dictionary(chunks: DataFrame, repeated: DataFrame, n_shards: int) -> DataFrame:
    """Step 2, from the chunks: distinct phrases with their smallest doc_id."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            answers = _answers(right)
            for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist(), strict=True):
                parse = Parse(blob, answers, n_shards)
                phrases, least = list(parse.phrases), np.array(parse.least, np.int64)
                for shard, own in parse.by_shard():
                    mine = [phrases[k] for k in own.tolist()]
                    out.append((shard, chunk, pack([np.fromiter(map(len, mine), np.uint8, len(mine)), least[own], b"".join(mine)])))
        return pa.Table.from_batches([_rows(out)])

    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(rows, _TOLD)


def window_classes(phrases: list[bytes], least: np.ndarray) -> list[int]:
    """For each phrase a mask of its places whose WINDOW bytes a phrase of a smaller doc_id also holds.

    The suffixes of all phrases that are WINDOW bytes or longer are sorted by their first WINDOW bytes; neighbours that agree are one class.
    """
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(phrases)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + place
    x = _words(np.frombuffer(b"".join(phrases) + b"\0" * 8, np.uint8))
    columns = [x[at + k] for k in range(0, WINDOW - 8, 8)] + [x[at + WINDOW - 8]]  # the last eight bytes overlap
    suffixes = np.lexsort(columns[::-1])
    new = np.zeros(len(at), np.bool_)
    new[:1] = True
    for c in columns:
        s = c[suffixes]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    low = np.zeros(len(at), np.int64)
    low[suffixes] = np.repeat(np.minimum.reduceat(least[owner[suffixes]], first), np.diff(first, append=len(at))) if len(first) else 0
    masks = np.zeros(len(phrases), np.int64)
    hit = low < least[owner]
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << place[hit])
    return masks.tolist()


def _judged(key: tuple, got: pa.Table) -> pa.Table:
    """Step 2, in the shard: for each chunk's phrases the mask of windows that a smaller doc_id holds, -1 for all of them."""
    told = []
    dictionary: dict[bytes, int] = {}
    least: list[int] = []
    for chunk, (sizes, docs, data) in _told(got):
        raw, at = bytes(data), 0
        mine = []
        for size, doc in zip(np.frombuffer(sizes, np.uint8).tolist(), np.frombuffer(docs, np.int64).tolist(), strict=True):
            phrase = raw[at : at + size]
            at += size
            k = dictionary.setdefault(phrase, len(least))
            if k == len(least):
                least.append(doc)
            elif doc < least[k]:
                least[k] = doc
            mine.append(k)
        told.append((chunk, np.array(mine, np.int64), np.frombuffer(docs, np.int64)))
    low = np.array(least, np.int64)
    # Phrases whose trigger has no other phrase agree with nothing else.
    others: dict[bytes, list[int]] = {}
    for phrase, k in dictionary.items():
        offset = phrase[0]
        others.setdefault(phrase[1:] if offset == 255 else phrase[1 + offset : 1 + offset + GRAM], []).append(k)
    contested = [k for ks in others.values() if len(ks) > 1 for k in ks]
    masks = np.zeros(len(low), np.int64)
    if contested:
        phrases = list(dictionary)
        masks[contested] = window_classes([phrases[k][1:] for k in contested], low[contested])
    return _table(key[0].as_py(), [(chunk, pack([np.where(low[mine] < docs, -1, masks[mine])])) for chunk, mine, docs in told])


def _covered(parse: Parse, masks: np.ndarray) -> Iterator[tuple[Block, np.ndarray]]:
    """Each block with the bytes that go."""
    least = np.array(parse.least, np.int64)
    for b, uses in zip(parse.blocks, parse.uses, strict=True):
        change = np.zeros(len(b.bytes) + 1, np.int64)
        if uses:
            first, last, phrase, doc = np.array(uses, np.int64).T
            mask = np.where(least[phrase] < doc, -1, masks[phrase])
            whole = mask == -1
            np.add.at(change, first[whole], 1)
            np.add.at(change, last[whole], -1)
            for k in range(REACH + 1):
                at = first[~whole & (mask >> k & 1 > 0)] + k
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
        yield b, np.cumsum(change[:-1]) > 0


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KEPT = "doc_id long, kept binary, spans array<struct<start:long,end:long>>"


def dedup(docs: DataFrame, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, kept (remaining bytes) and spans (removed byte ranges); or with `digest` the counts and a hash of what is kept."""
    chunks = chunked(docs)
    n_shards = max(1, -(-total_bytes(chunks) // SHARD_BYTES))
    repeated = write_table(_trigger_sets(chunks, n_shards).groupBy("shard").applyInArrow(lambda key, got: _repeated(key, got, hot), _TOLD), "repeated")
    judged = _dictionary(chunks, repeated, n_shards).groupBy("shard").applyInArrow(_judged, _TOLD)
    both = repeated.selectExpr("shard", "chunk", "payload", "false as judged").unionByName(judged.selectExpr("shard", "chunk", "payload", "true as judged"))

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        is_mask = right.column("judged").to_pylist()
        cut = lambda yes: _answers(right.filter(pa.array([x == yes for x in is_mask], pa.bool_())))
        out: list[list] = [[] for _ in range(5 if digest else 3)]
        for blob in left.column("blob").to_pylist():
            parse = Parse(blob, cut(False), n_shards)
            masks, got = np.zeros(len(parse.least), np.int64), dict(cut(True))
            for shard, own in parse.by_shard():
                masks[own] = np.frombuffer(unpack(got[shard])[0], np.int64)
            for b, gone in _covered(parse, masks):
                for doc_id, a, e in zip(b.ids, b.starts.tolist(), b.ends.tolist(), strict=True):
                    g = gone[a:e]
                    edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                    kept = b.bytes[a:e][~g].tobytes() if len(edge) else b.raw[a:e]
                    row = (doc_id, e - a, e - a - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest()) if digest else (doc_id, kept, [{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                    for to, x in zip(out, row, strict=True):
                        to.append(x)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    i, s = pa.int64(), pa.string()
    schema = pa.schema([("doc_id", i), ("n_bytes", i), ("n_removed", i), ("n_spans", i), ("kept_sha256", s)] if digest else [("doc_id", i), ("kept", pa.binary()), ("spans", span)])
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(rows, _DIGEST if digest else _KEPT)


def op3(docs: DataFrame) -> DataFrame:
    return dedup(docs, digest=True)
