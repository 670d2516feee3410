"""Context-mixing range coder for token ids, over many independent blocks at once.

An id's probability is a mixture of three orders: the id that last followed the same two ids (order 2), the
id that last followed the same one (order 1), and the frequencies of ids that neither told (order 0). The
mixture's weights are counted for each state: which orders predict, whether they agree, and whether the id
before was told by them. Predictions start blank in each block and follow every id; weights and frequencies are
counted over the record and written in its model. A block has its own checksum and can be decoded alone, given
the record's model.

The blocks of a record are coded in lockstep, one numpy lane a block. All arithmetic is on integers below
1 << 52, in 64-bit integers or in doubles, which hold them exactly: both directions agree on any machine.
Encoding needs no step-by-step model: what last followed a context is found by sorting. An empty sequence gives
a record without blocks; ids are never null.
"""

from __future__ import annotations

import zlib

import numpy as np

from postern.llm.common import pack, unpack

#: Ids of a block.
BLOCK_IDS = 1 << 12
MAGIC = b"PTK3"
_ONE, _TWO = 11, 12  # bits of the order-1 and order-2 tables
#: Of each block: which orders predict (none, order 1 alone, both alike, otherwise), and whether the id before was told.
_STATES = 8
#: Lanes that are decoded side by side, which bounds their tables (12 KB a lane).
LANES = 4096
#: A place without a prediction. The id of that number is never predicted, only told by its frequency.
_NONE = 0xFFFF
_WORD, _MASK = 24, (1 << 24) - 1  # bits that leave and enter at a time; a span is 1 << _WORD at least, 1 << 2 * _WORD at most


def _slot1(last: np.ndarray) -> np.ndarray:
    return last * 40503 >> 4 & (1 << _ONE) - 1


def _slot2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (last * 40503 ^ before * 30011) >> 5 & (1 << _TWO) - 1


def _followers(ids: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """[lane, step]: the id at the lane's last earlier place of the same slot, _NONE where there is none."""
    slot = slot.astype(np.uint16)
    order = np.argsort(slot, axis=1, kind="stable")
    order += np.arange(len(ids))[:, None] * ids.shape[1]
    s, x = slot.reshape(-1)[order], ids.reshape(-1)[order]
    x[:, 1:] = np.where(s[:, 1:] == s[:, :-1], x[:, :-1], _NONE)
    x[:, :1] = _NONE
    out = np.empty_like(ids)
    out.reshape(-1)[order] = x
    return out


def _events(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lane, step]: states, and events (order 2 right, order 1 right, neither)."""
    n, steps = ids.shape
    past = np.concatenate([np.zeros((n, 2), np.int64), ids], 1)
    p1 = _followers(ids, _slot1(past[:, 1 : steps + 1]))
    p2 = _followers(ids, _slot2(past[:, 1 : steps + 1], past[:, :steps]))
    event = np.where((ids == p2) & (p2 != _NONE), 0, np.where((ids == p1) & (p1 != _NONE), 1, 2)).astype(np.uint8)
    state = 2 * np.where(p2 == _NONE, p1 != _NONE, np.where(p1 == p2, 2, 3)).astype(np.uint8)
    state[:, 1:] += event[:, :-1] < 2
    return state, event


class _Model:
    """What a record's blocks share. A symbol is an event (0 or 1) or 2 + the rank of an id that is told by frequency."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, events: np.ndarray) -> None:
        """Ids told by frequency with their counts, and counts [state, event]."""
        self.ids, self.counts, self.events = ids, counts.astype(np.int64), events.astype(np.int64)
        self.n = len(ids) + 2
        self.bits = min(20, max(12, self.n.bit_length() + 6))
        room = (1 << self.bits) - self.n
        share = self.events * room // np.maximum(1, self.events.sum(1, keepdims=True))
        own = share[:, 2:] * self.counts // max(1, int(self.counts.sum()))
        #: [state, symbol]: where its part of the whole starts, and its width.
        self.width = 1 + np.concatenate([share[:, :2], own], 1)
        self.start = np.cumsum(self.width, 1) - self.width

    def packed(self) -> bytes:
        return pack([self.ids.astype("<u2"), self.counts.astype("<i8"), self.events.astype("<i8")])

    @classmethod
    def unpacked(cls, blob: bytes) -> _Model:
        ids, counts, events = unpack(blob)
        return cls(np.frombuffer(ids, "<u2"), np.frombuffer(counts, "<i8"), np.frombuffer(events, "<i8").reshape(_STATES, 3))

    def told(self) -> np.ndarray:
        """[state << bits | part of the whole]: the symbol that the part belongs to."""
        rest = (1 << self.bits) - self.width.sum(1)
        kind = np.uint16 if self.n <= 1 << 16 else np.int32
        wide = self.width.copy()
        wide[:, -1] += rest  # never aimed at
        return np.repeat(np.tile(np.arange(self.n, dtype=kind), _STATES), wide.reshape(-1))


def _settled(words: np.ndarray) -> np.ndarray:
    """Carries, kept above each word's bits, added to the words before."""
    while (carry := words >> _WORD).any():
        words &= _MASK
        words[:, :-1] += carry[:, 1:]
    return words


def encode_lanes(ids: np.ndarray, bits: int) -> list[bytes]:
    """ids: [lane, step] integers below 1 << bits. The model's bytes, then those of each lane."""
    if bits > 16:
        raise ValueError("ids of up to 16 bits only")
    n, steps = ids.shape
    ids = ids.astype(np.uint16, copy=False)
    state, event = np.empty((n, steps), np.uint8), np.empty((n, steps), np.uint8)
    counts, events = np.zeros(1 << 16, np.int64), np.zeros(3 * _STATES, np.int64)
    for k in range(0, n, 64):
        state[k : k + 64], event[k : k + 64] = s, e = _events(ids[k : k + 64])
        counts += np.bincount(ids[k : k + 64][e == 2], minlength=1 << 16)
        events += np.bincount((3 * s + e).reshape(-1), minlength=3 * _STATES)
    known = np.flatnonzero(counts)
    model = _Model(known, counts[known], events.reshape(_STATES, 3))
    rank = np.zeros(1 << 16, np.int32)
    rank[known] = np.arange(2, model.n)
    symbol = np.empty((steps, n), np.uint16 if _STATES * model.n <= 1 << 16 else np.int32)
    for k in range(0, n, 64):
        e = event[k : k + 64]
        symbol[:, k : k + 64] = (state[k : k + 64].astype(np.int32) * model.n + np.where(e < 2, e, rank[ids[k : k + 64]])).T
    start, width = model.start.reshape(-1).astype(np.uint64), model.width.reshape(-1).astype(np.uint64)
    whole, word, mask, least = np.uint64(model.bits), np.uint64(_WORD), np.uint64(_MASK), np.uint64(1 << _WORD)
    low, span = np.zeros(n, np.uint64), np.full(n, 1 << 2 * _WORD, np.uint64)
    del state, event
    out = np.zeros((n, steps + 2), np.uint32)
    flat = out.reshape(-1)
    to = np.arange(n) * (steps + 2)
    for k in range(steps):
        own = symbol[k]
        span >>= whole
        low += start[own] * span
        span *= width[own]
        need = np.flatnonzero(span < least)
        if len(need):
            l, spots = low[need], to[need]  # noqa: E741
            flat[spots] = l >> word
            to[need] = spots + 1
            low[need] = (l & mask) << word
            span[need] <<= word
    flat[to] = low >> word
    flat[to + 1] = low & mask
    sizes = (to + 2 - np.arange(n) * (steps + 2)).tolist()
    words = np.ascontiguousarray(out[:, : max(sizes)], "<u4")
    raw = _settled(words).view(np.uint8).reshape(n, -1, 4)[:, :, :3]
    return [model.packed(), *(raw[k, :size].tobytes() for k, size in enumerate(sizes))]


def _decode_some(model: _Model, told: np.ndarray, parts: list[bytes], steps: int, out: np.ndarray) -> None:
    """Fills out [step, lane]."""
    n = len(parts)
    sizes = np.array([len(p) // 3 for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts) + b"\0" * 6, np.uint8).reshape(-1, 3)
    words = raw[:, 0] + 256.0 * raw[:, 1] + 65536.0 * raw[:, 2]
    at = np.cumsum(sizes) - sizes
    base = float(1 << _WORD)
    rest, span = words[at] * base + words[at + 1], np.full(n, base * base)  # the code less the interval's start, and its width
    at += 2
    start, width = model.start.reshape(-1).astype(np.float64), model.width.reshape(-1).astype(np.float64)
    value = np.concatenate([[-2, -1], model.ids]).astype(np.int64)
    part = 2.0**-model.bits
    lane = np.arange(n)
    base1, base2 = lane << _ONE, lane << _TWO
    one, two = np.full(n << _ONE, _NONE, np.uint16), np.full(n << _TWO, _NONE, np.uint16)
    last, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    right = np.zeros(n, np.int64)
    #: Twice the orders that predict, by (p2 known, p1 known, alike).
    by = np.array([0, 0, 2, 2, 6, 6, 6, 4], np.int64)
    for k in range(steps):
        mixed = last * 40503
        slot1 = (mixed >> 4 & (1 << _ONE) - 1) + base1
        slot2 = ((mixed ^ before * 30011) >> 5 & (1 << _TWO) - 1) + base2
        p1, p2 = one.take(slot1, mode="clip"), two.take(slot2, mode="clip")
        orders = (p2 != _NONE) * np.int8(4)
        orders += (p1 != _NONE) * np.int8(2)
        orders += p1 == p2
        state = by.take(orders, mode="clip")
        state += right
        span *= part
        np.floor(span, span)
        aim = (rest / span).astype(np.int64)
        aim += state << model.bits
        symbol = told.take(aim, mode="clip")
        x = value.take(symbol, mode="clip")
        symbol = state * model.n + symbol
        rest -= start.take(symbol, mode="clip") * span
        span *= width.take(symbol, mode="clip")
        right = (x < 0).astype(np.int64)
        hit = np.flatnonzero(right)
        if len(hit):
            x[hit] = np.where(x[hit] == -2, p2[hit], p1[hit])
        out[k] = x
        one[slot1] = x
        two[slot2] = x
        last, before = x, last
        need = np.flatnonzero(span < base)
        if len(need):
            spots = at[need]
            rest[need] = rest[need] * base + words.take(spots, mode="clip")
            span[need] *= base
            at[need] = spots + 1


def decode_lanes(parts: list[bytes], steps: int, bits: int) -> np.ndarray:
    """The ids [step, lane] of what `encode_lanes` wrote."""
    if bits > 16:
        raise ValueError("ids of up to 16 bits only")
    model, lanes = _Model.unpacked(parts[0]), parts[1:]
    told = model.told()
    out = np.zeros((steps, len(lanes)), np.uint16)
    groups = max(1, -(-len(lanes) // LANES))
    cuts = [len(lanes) * k // groups for k in range(groups + 1)]
    with np.errstate(all="ignore"):  # of damaged blocks, which their checksums tell
        for a, b in zip(cuts, cuts[1:], strict=False):
            _decode_some(model, told, lanes[a:b], steps, out[:, a:b])
    return out


def encode(ids: np.ndarray, bits: int = 16, block: int = BLOCK_IDS) -> bytes:
    """A self-contained record of all `ids` (unsigned, below 1 << bits): header with the model, then blocks with a checksum each."""
    n = len(ids)
    blocks = -(-n // block)
    block = max(1, -(-n // max(1, blocks)))  # blocks of one size: lanes end together
    grid = np.zeros(blocks * block, np.uint16)
    grid[:n] = ids
    model, *parts = encode_lanes(grid.reshape(blocks, block), bits) if n else [b""]
    sums = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, n, block)]
    head = pack([np.array([n, block, bits], np.int64), np.array(list(map(len, parts)), np.int64), np.array(sums, np.uint32), model])
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)


def decode(record: bytes) -> np.ndarray:
    """The ids of a record; raises ValueError where a block does not match its checksum."""
    if record[:4] != MAGIC:
        raise ValueError("not a token record")
    start = 8 + int.from_bytes(record[4:8], "little")
    shape, sizes, sums, model = unpack(record[8:start])
    n, block, bits = np.frombuffer(shape, np.int64).tolist()
    ends = start + np.cumsum(np.frombuffer(sizes, np.int64))
    if not n:
        return np.zeros(0, np.uint32)
    parts = [record[a:b] for a, b in zip([start, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    try:
        ids = decode_lanes([bytes(model), *parts], block, bits).T.astype(np.uint32, order="C")
    except IndexError:
        raise ValueError("a block does not decode") from None
    ids = ids.reshape(-1)[:n]
    for k, crc in enumerate(np.frombuffer(sums, np.uint32).tolist()):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} does not match its checksum")
    return ids
