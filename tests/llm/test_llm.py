"""Operators of the llm subpackage against brute force, on small fixtures with nulls, empties, long texts, ties and repeats."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern.llm import byte_bpe, decontamination, graph, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_coder, token_output, warc

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, extra string"


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Texts with shared passages, exact and near copies, repeated rows, odd characters, nulls and one very long text."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "ſ", "漢字", "I", "The", "the", "a", "İ"]
    base = [" ".join(r.choice(words + [f"u{r.randrange(900)}"]) for _ in range(r.randint(1, 90))) for _ in range(25)]
    rows = []
    for k in range(n):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            t[r.randrange(len(t))] = r.choice(words)
        text = " ".join(t)
        if r.random() < 0.3:
            text += "\n" + r.choice(base)[: r.randint(30, 200)]
        rows.append((k, text, "x"))
    rows += [(n, None, None), (n + 1, "", "x"), (n + 2, "   \n\t ", "x"), (n + 3, " ".join(r.choice(words) for _ in range(30_000)), "x"), (n + 4, rows[0][1], "x"), (None, "a null id", "x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split() + [b"\t"]


def test_lm_scores(spark):
    rows = corpus()
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    apart = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows), 0).collect()}
    count = collections.Counter(t for d, x, _ in rows if not lm_scoring.held_out(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for d, x, _ in rows:
        ts, g = tokens(x), got[d]
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(ts), sum(count[t] > 0 for t in ts), n, d is None or zlib.crc32(str(d).encode()) % 5 == 1)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and g.score < 0
        assert math.isclose(g.score, apart[d].score, rel_tol=1e-12)  # broadcast or asked for in its shards
    assert lm_scoring.score(empty(spark)).count() == 0


@pytest.mark.parametrize("bound", [lm_scoring.BROADCAST_BYTES, 0])
def test_lm_scores_count_each_continuation_once(spark, monkeypatch, bound):
    """Against brute force, however the rows are dealt and sharded; a repeated pair is one continuation."""
    rows = [r for r in corpus(7, 60) if r[0] is not None]
    count, pair, after = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for d, x, _ in rows:
        ts = [b"\t", *tokens(x)]
        if not lm_scoring.held_out(d):
            count.update(ts[1:])
            pair.update(zip(ts, ts[1:], strict=False))
            for a, b in zip(ts, ts[1:], strict=False):
                after[a].add(b)
    v = len(count)
    value = lambda c: lm_scoring.VALUES[lm_scoring.level_of(np.array([c]))[0]]
    whole = sum(map(value, count.values())) + 0.5 * (v + 1)
    mass = collections.Counter()
    for (a, b), c in pair.items():
        mass[a] += value(c)

    def probability(a, b):
        p0 = (value(count[b]) + 0.5) / whole
        return (min(value(pair[a, b]), value(count[b])) + (value(len(after[a])) + 1) * p0) / (mass[a] + value(len(after[a])) + 1) if mass[a] else p0

    for a in [b"\t", b"w1", b"the", b"not there"]:
        assert math.isclose(sum(probability(a, b) for b in [*count, b"unseen"]), 1, rel_tol=1e-9)
    want = {d: sum(math.log10(probability(a, b)) for ts in [[b"\t", *tokens(x)]] for a, b in zip(ts, ts[1:], strict=False)) for d, x, _ in rows}
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 50_000)
    one, many = ({r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(parts), bound).collect()} for parts in (1, 12))
    assert all(math.isclose(one[d], many[d], rel_tol=1e-12) for d in want)
    assert all(math.isclose(many[d], want[d], rel_tol=0.02) for d in want)  # the filter's false positives raise some levels


def test_filter_never_underestimates():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    levels = np.random.default_rng(0).integers(1, 12, 5000)
    made = lm_scoring.Filter.build(keys, levels)
    read = made.levels(keys, np.zeros(5000, np.int64))
    assert (read >= levels).all() and (read > levels).mean() < 0.05
    assert (made.levels(keys + np.uint64(1), np.zeros(5000, np.int64)) > 0).mean() < 0.05


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(700, "hello <|endoftext|> world", "x"), (701, "a<|startoftext|>b<|endoftext|>", "x"), (702, "İ–x e\u0301. it's 'LL 12\x1c3 \u00a0 a|b<|", "x")]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(token_output.op2(frame(spark, rows)).collect(), key=lambda r: r.start)
    at = 0
    for (d, x, _), g in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    assert token_output.op2(empty(spark)).count() == 0


def test_tokenizer_equals_the_library(monkeypatch):
    """Words told by their pieces, on odd letters, marks, spaces and special tokens, with caches that turn over."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_output, "CACHE_PIECES", 50)
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), token_output._Tokenizer(P.path("word_bpe_49k.json"))
    r = random.Random(0)
    letters = list("abzAZ09'.,|<-–“”é\u0301\u00a0\u2003İſßΣσςΑ漢字Å\u212bﬁ²½Ⅷ٣\x00\x1c\x1f\u180e\u200b\ufeff😀\u0378 \n\t") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "hello", "World", "x" * 70]
    for _ in range(1000):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(4)]
        for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("n", [0, 1, 255, 257, 4097, 20_000, 40_000])
@pytest.mark.parametrize("top", [2, 300, 65536])
def test_coder_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    record = token_coder.encode(ids)
    assert (token_coder.decode(record) == ids).all()
    if n > 1:
        broken = bytearray(record)
        broken[-len(broken) // 8] ^= 0x55
        with pytest.raises(Exception):  # noqa: B017
            assert (token_coder.decode(bytes(broken)) == ids).all()


def test_coder_adapts():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    assert len(token_coder.encode(ids)) * 8 / len(ids) < 0.5


def test_coder_beats_a_byte_compressor_on_real_ids():
    """Ids of texts take fewer bits than plain 16-bit ids under zstd level 3 do."""
    import pyarrow.parquet as pq
    import zstandard

    own = token_output._Tokenizer(P.path("word_bpe_49k.json"))
    texts = [(x or "").encode() for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids = np.frombuffer(b"".join(own.encode(texts)), "<u2")
    record = token_coder.encode(ids)
    assert len(record) < 0.99 * len(zstandard.ZstdCompressor(level=3).compress(ids.tobytes()))
    assert (token_coder.decode(record) == ids).all()


def test_ids_of_a_file_fit_one_record():
    """A short second record would cost as many steps as the first; a record's ids are held in two bytes while they are decoded."""
    import pyarrow.parquet as pq

    own = token_output._Tokenizer(P.path("word_bpe_49k.json"))
    texts = [(x or "").encode() for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    coded = own.encode(texts)
    assert sum(map(len, coded)) / 2 / sum(map(len, texts)) * token_output.FILE_BYTES < token_output.RECORD_IDS
    ids = np.frombuffer(b"".join(coded), "<u2")[:4000].astype(np.int32).reshape(4, 1000)
    got = token_coder.decode_lanes(token_coder.encode_lanes(ids, 16), 1000, 16)
    assert (got.T == ids).all() and got.itemsize == 2


def test_coder_costs_less_than_the_library():
    """Writing and reading back real ids takes less than half the CPU time of the library's tokenising, and fewer bits than order 0 alone."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    begin = time.process_time()
    coded = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    middle = time.process_time()
    ids = np.concatenate([np.array([*x, 1], "<u2") for x in coded])
    made = time.process_time()
    record = token_coder.encode(ids)
    assert (token_coder.decode(record) == ids).all()
    spent = time.process_time() - made
    assert spent < 0.5 * (middle - begin)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(record) < 0.98 * len(ids) * -(share * np.log2(share)).sum()


@pytest.mark.parametrize("ids", [np.random.default_rng(0).permutation(1 << 16), np.full(9000, 0xFFFF), np.repeat([0xFFFF, 0, 7], 3000), np.arange(1 << 17) // 7 % 300 * 218])
def test_coder_takes_every_id(ids):
    """All 65,536 ids in one record, and runs of the id that marks a place without a prediction."""
    assert (token_coder.decode(token_coder.encode(ids.astype(np.uint32))) == ids).all()


def test_words_alike_in_lower_case(monkeypatch):
    """Special tokens are told by their case, other words share what is kept; texts in slices and as nulls."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(P.path("word_bpe_49k.json")), P.path("word_bpe_49k.json")
    texts = ["<|EndOfText|> a", None, "<|endoftext|> A", "", "<|ENDOFTEXT|>x J\u030c j\u030c", "  ZZ'S zz's \u00df'ZWorld J\u030C <|endoftext|>X", "\n"] * 3
    for size, kept in ((1, 5), (40, 1000), (1 << 20, 2)):
        monkeypatch.setattr(token_output, "SLICE_BYTES", size)
        monkeypatch.setattr(token_output, "CACHE_PIECES", kept)
        monkeypatch.setattr(token_output, "_OPEN", {})
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
        got = [(k, x.tolist()) for ks, xs in token_output._encoded(iter([batch, batch.slice(3, 5)]), path) for k, x in zip(ks, xs, strict=True)]
        want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in enumerate(texts)]
        assert got == want + want[3:8]


def brute_dedup(rows, w=substring_dedup.WINDOW):
    first: dict[bytes, int] = {}
    for d, x, _ in rows:
        t = (x or "").encode()
        for k in range(len(t) - w + 1):
            first[t[k : k + w]] = min(first.get(t[k : k + w], math.inf), math.inf if d is None else d)
    out = collections.Counter()
    for d, x, _ in rows:
        t = (x or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - w + 1):
            if first[t[k : k + w]] < (math.inf if d is None else d):
                gone[k : k + w] = b"\1" * w
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[d, len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 4])
def test_substring_dedup(spark, hot):
    rows = [r for r in corpus(3) if len(r[1] or "") < 5000] + [(500, "ab" * 200, "x"), (501, "z" + "ab" * 150, "x")]
    got = collections.Counter(tuple(r) for r in substring_dedup.dedup(frame(spark, rows), True, hot).collect())
    assert got == brute_dedup(rows)
    assert substring_dedup.dedup(empty(spark)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert kept[0] == rows[0][1].encode()


def shingle_sets(rows):
    out = {}
    for d, x, _ in rows:
        w = (x or "").encode().lower().split()
        out[d] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = [r for r in corpus(seed, 300) if r[0] is not None]
    sets = shingle_sets(rows)
    want = brute_components(sets)
    got = {r.doc_id: r for r in ngram_join.join(frame(spark, rows)).collect()}
    assert {d: (g.n_shingles, g.component_id) for d, g in got.items()} == {d: (len(sets[d]), want[d]) for d in sets}


def test_deduplicate_keeps_one_of_each(spark):
    rows = [r for r in corpus(4, 80) if r[0] is not None]
    rows.append(rows[0])  # a repeated row
    want = brute_components(shingle_sets(rows))
    kept = ngram_join.deduplicate(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)
    assert ngram_join.join(empty(spark)).count() == 0


def test_long_lists_and_short_lists_agree(spark):
    """A near-copy group of many documents: every pair goes through long lists."""
    r = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(150):
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            t[r.randrange(60)] = f"e{r.randrange(10_000)}"
        rows.append((k, " ".join(t), "x"))
    want = brute_components(shingle_sets(rows))
    assert {g.doc_id: g.component_id for g in ngram_join.join(frame(spark, rows)).collect()} == want


def test_grouped_links_keep_bounded_bits(monkeypatch):
    """4096 documents, 131,072 shared differences: 67 MB of bits if they were all kept, and links that the first document settles."""
    import tracemalloc

    monkeypatch.setattr(ngram_join, "HELD_BYTES", 4 << 20, raising=False)
    m, each = 4096, 64
    own = np.arange(m * each, dtype=np.uint64).reshape(m // 2, 2 * each)
    deltas = [np.zeros(0, np.uint64), *(own[k // 2, k % 2 : k % 2 + each] for k in range(m - 1))]
    gone = np.array([0, *[each // 2] * (m - 1)])
    tracemalloc.start()
    got = ngram_join._spanning_links(np.arange(m), np.arange(m), np.full(m, 1000), gone, 1000, deltas, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, k) for k in range(1, m)]
    assert peak < 60 << 20, peak


@pytest.mark.parametrize("held", [1 << 10, 32 << 20])
def test_grouped_links_equal_brute_force(monkeypatch, held):
    """Chains and pairs of documents that share differences, with all bits kept and with bits packed anew for each turn."""
    monkeypatch.setattr(ngram_join, "HELD_BYTES", held, raising=False)
    r = random.Random(held)
    root = list(range(300))
    sets = []
    for k in range(150):
        x = set(root) - set(r.sample(root, 30))
        if sets and k % 3:
            x = set(r.choice(sets)) - set(r.sample(root, 8))
        sets.append(x | {1000 + 50 * k + j for j in range(r.choice([0, 20, 40]))})
    deltas = [np.array(sorted(x ^ set(root)), np.uint64) for x in sets]
    gone = np.array([len(set(root) - x) for x in sets])
    ids, n = np.arange(150), np.array([len(x) for x in sets])
    got = ngram_join._spanning_links(ids, ids, n, gone, 300, deltas, None)
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert all(alike(sets[a], sets[b]) for a, b in got)

    def components(pairs):
        label = list(range(150))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if c == old else c for c in label]
        return [label.index(c) for c in label]

    want = components((a, b) for a in range(150) for b in range(a) if alike(sets[a], sets[b]))
    assert components(got) == want and 1 < len(set(want)) < 150


def test_rows_of_one_doc_id_link_by_every_text(spark, monkeypatch):
    """Document 1 has two texts, 2 is near the first and 3 near the second; 9 has a text of 4's and one of its own."""
    monkeypatch.setattr(ngram_join, "LOCAL_DOCS", 3)
    text = lambda name, change=0: " ".join([f"{name}{k}" for k in range(60)] + [f"{name}x"] * bool(change))
    rows = [(1, text("a"), "x"), (1, text("b"), "x"), (1, text("b"), "x"), (2, text("a", 1), "x"), (3, text("b", 1), "x"), (4, text("c"), "x"), (9, text("d"), "x"), (9, text("c"), "x"), (9, None, "x"), (5, text("e"), "x"), (None, text("e"), "x")]
    got = {r.doc_id: (r.component_id, r.class_id) for r in ngram_join.join(frame(spark, rows)).collect() if r.doc_id is not None}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (4, 4), 9: (4, 4), 5: (5, 5)}
    assert sorted(map(tuple, ngram_join.links(frame(spark, rows)).collect())) == [(1, 2), (1, 3)]
    kept = ngram_join.deduplicate(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, text("e")), (1, text("a")), (4, text("c")), (5, text("e"))])


def test_near_copies_below_the_threshold_leave_few_candidates(spark, monkeypatch):
    """Five or six changed words of 400 are just too many for most pairs: what is verified must grow with the documents, not their pairs."""
    for n in (100, 400):
        r = random.Random(n)
        rows = []
        for k in range(n):
            t = [f"b{j}" for j in range(400)]
            for _ in range(r.choice([5, 6])):
                t[r.randrange(400)] = f"e{r.randrange(10**6)}"
            rows.append((k, " ".join(t), "x"))
        count, real = [], ngram_join._verified
        monkeypatch.setattr(ngram_join, "_verified", lambda pairs, docs, count=count, real=real: (count.append(pairs.count()), real(pairs, docs))[1])
        got = {g.doc_id: g.component_id for g in ngram_join.join(frame(spark, rows)).collect()}
        monkeypatch.setattr(ngram_join, "_verified", real)
        assert got == brute_components(shingle_sets(rows))
        # Hubs and chains are a few pairs a document at any size; the last step finds nothing left to do.
        assert sum(count) < 8 * n and count[-1] < n, count


@pytest.mark.parametrize("near", [60, 150])
def test_links_within_components(spark, near):
    """All pairs of class representatives, in short lists and in long ones, against brute force."""
    r = random.Random(near)
    rows = [x for x in corpus(near, 100) if x[0] is not None] if near == 60 else []
    for k in range(1000, 1000 + near):
        t = [f"b{j}" for j in range(60)]
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            t[r.randrange(60)] = f"e{r.randrange(10_000)}"
        rows.append((k, " ".join(t), "x"))
    first = {}
    for d, s in sorted(shingle_sets(rows).items()):
        if s:
            first.setdefault(frozenset(s), d)
    sets = sorted((d, s) for s, d in first.items())
    want = {(a, b) for k, (b, y) in enumerate(sets) for a, x in sets[:k] if 100 * len(x & y) >= 80 * len(x | y)}
    got = [tuple(g) for g in ngram_join.links(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > len(sets) - len(set(brute_components(dict(sets)).values()))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_byte_bpe(spark):
    import tiktoken

    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in corpus(5)] + [(900, "a" * 5000 + "  \n 123 don't <|endoftext|>", "x")]
    for r in byte_bpe.encode(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        texts = [x or "" for d, x, _ in rows if d == r.doc_id]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() in [enc.encode_ordinary(t) for t in texts]
        assert bytes(r.decoded) in [t.encode() for t in texts]
    assert byte_bpe.op5(empty(spark)).count() == 0


def labelled(spark):
    r = random.Random(2)
    good = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(r.randrange(50)) for _ in range(80)) + ".", "x") for k in range(150)]
    bad = [(k, " | ".join(r.choice(["###", "$$$", "buy"]) + str(r.randrange(9)) for _ in range(80)), "x") for k in range(150, 300)]
    rows = good + bad
    labels = spark.createDataFrame([(d, int(d < 150), 0) for d, _, _ in rows if d % 2] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return frame(spark, rows + [(400, None, "x"), (None, "", "x")]), labels


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality_classifier.op6(docs, labels).collect()
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 300]
    assert len(got) == 302 and sum(g.predicted == (g.doc_id < 150) for g in held) / len(held) > 0.95
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    none = quality_classifier.op6(docs, labels.where("quality = 1")).collect()
    assert {g.score for g in none} == {1.0} and quality_classifier.op6(empty(spark), labels).count() == 0


def test_quality_classifier_equals_brute_force(spark, monkeypatch):
    """The discriminant worked out from all learnable rows at once; ties, repeats and a very long text among them."""
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(["alpha", "beta,", "### ", "9", "Tä"][: 3 + k % 3]) for _ in range(r.randint(0, 120))) + "\n" * (k % 4), "x") for k in range(120)] + [(5, "a repeated id", "x"), (200, "long " * 50_000, "x"), (201, None, "x")]
    marks = {k: int(r.random() < 0.3 + 0.4 * (k % 3 == 2)) for k in range(0, 201, 2)} | {5: 1, 201: 0}
    labels = spark.createDataFrame([*marks.items(), (5, 0), (7, None), (None, 1), (4, marks[4])], "doc_id long, quality int")
    marks[5] = 0
    data = [(marks[d], quality_classifier.statistics((x or "").encode())) for d, x, _ in rows if d in marks and not quality_classifier.in_fold(d)]
    x, y = np.array([v for _, v in data]), np.array([m for m, _ in data])
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))
    density = []
    for k in (0, 1):
        c = 0.9 * (0.8 * own[k] + 0.2 * pooled) + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(x.shape[1])
        density.append(lambda v, k=k, c=c: math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - x[y == k].mean(0)) @ np.linalg.solve(c, v - x[y == k].mean(0)))
    want = sorted((d, 1 / (1 + math.exp(-max(-60, min(60, density[1](v) - density[0](v)))))) for d, t, _ in rows for v in [np.array(quality_classifier.statistics((t or "").encode()))])
    for most in (1_000_000, 3):
        monkeypatch.setattr(quality_classifier, "BROADCAST_LABELS", most)
        got = sorted((g.doc_id, g.score) for g in quality_classifier.op6(frame(spark, rows), labels).collect())
        assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4, atol=1e-6)


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    model = quality_rules.fit(docs, labels)
    got = {g.doc_id: g for g in quality_rules.judge(docs, model, only=True).collect()}
    assert sum(got[d].kept == (d < 150) for d in range(300)) > 290 and not got[400].kept
    assert quality_rules.keep(docs, model).columns == docs.columns
    assert quality_rules.keep(docs, model).count() == sum(g.kept for g in got.values())
    with pytest.raises(ValueError):
        quality_rules.judge(docs.withColumn("kept", F.lit(1)), model)


@pytest.mark.parametrize("seed", range(5))
def test_quality_counts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a ", "b ", "a b c ", "é#", "|", "\n", " \n", "x x x ", " ", "\t"]) for _ in range(120))
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + j for k in range(len(words) - 2) for j in range(3) if grams[tuple(words[k : k + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    raw = text.encode()
    assert quality_rules.counts(raw, raw.split()) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def brute_hits(text, items):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    find = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low(t))
    w, hit, ids = find(text), set(), set()
    for key, item in items:
        v = find(item)
        n = min(13, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1) if v else ():
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                ids.add(str(key))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("slice_windows", [decontamination.SLICE_WINDOWS, 20])
def test_decontamination(spark, monkeypatch, slice_windows):
    monkeypatch.setattr(decontamination, "SLICE_WINDOWS", slice_windows)
    words = [f"Q{k}" for k in range(60)]
    greek = "Α.Β ΟΔΟΣ.ΒΑΣ ΟΔΟΣ' İK one two three four five six seven eight nine ten"
    items = [(1, " ".join(words[:20])), (12, " ".join(words[30:50]).upper()), (3, "short ITEM É here"), (4, None), (5, "..."), (6, greek)]
    rows = [(0, " ".join(words), "x"), (1, "filler " * 400 + " ".join(words[2:16]), "x"), (2, "a SHORT item É HERE, yes", "x"), (3, "clean text", "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(words[:12]), "x"), (6, " ".join(words[:12]), "x")]
    rows += [(7, greek, "x"), (8, "pre " + greek.replace(".", ", ").replace("one", "ONE"), "x"), (9, greek.lower(), "x"), (None, " ".join(words[:20]), "x"), (10, "long " * 50_000 + greek, "x")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    by_id = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in decontamination.op7(docs, bench).collect()), key=by_id)
    want = sorted(((d, *brute_hits(x, items)) for d, x, _ in rows), key=by_id)
    assert got == want and next(w for w in want if w[0] == 7)[2] >= 13
    odd = docs.withColumnsRenamed({"extra": "bad_id"}).selectExpr("*", "1 AS hit_id", "2 AS bad_hash", "3 AS hit_hash", "4 AS ranges", "5 AS row", "6 AS n", "7 AS `at`", "8 AS gram_hash")
    kept = decontamination.decontaminate(odd, bench)
    clean = sorted(((d,) for d, x, _ in rows if not brute_hits(x, items)[-1]), key=by_id)
    assert kept.columns == odd.columns and sorted(((r.doc_id,) for r in kept.collect()), key=by_id) == clean
    cut = decontamination.decontaminate(odd, bench, remove="spans")
    assert cut.columns == odd.columns and cut.count() == len(rows)
    spans = {r.doc_id: r.text for r in cut.collect()}
    assert "Q5" not in spans[1] and "filler" in spans[1] and spans[3] == "clean text" and "ΟΔΟΣ" not in spans[7]
    assert decontamination.op7(docs, bench.limit(0)).where("contaminated").count() == 0 and decontamination.op7(docs.limit(0), bench).count() == 0


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_pii_base_spans():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice(["a", "@", ".", "-", "1", "23", "255", "300", "+", " ", "(", ")", "4111 1111 1111 1111", "b.c", "_", "é", "000"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(t) == brute_pii(t), t
    long = "1" * 200_000 + "a" * 200_000 + "@"
    assert pii.base_spans(long) == []


@pytest.mark.parametrize("opening", "[({<")
@pytest.mark.parametrize("closing", "])}>")
@pytest.mark.parametrize("at", ["at", "AT", "@", " at ", " @ ", "at ", " @"])
def test_pii_every_bracketed_at_is_a_candidate(opening, closing, at):
    text = f"x jane{opening}{at}{closing}firm.de y"
    assert [c[:4] for c in pii.candidates(text)] == [(0, 2, len(text) - 2, False)]


@pytest.mark.parametrize("dot", ["[.]", "(.)", "[.)", "(.]"])
def test_pii_every_bracketed_dot_is_a_candidate(dot):
    text = f"x 10{dot}20{dot}30{dot}40 y"
    assert [c[:4] for c in pii.candidates(text)] == [(1, 2, len(text) - 2, False)]


def test_pii_adds_and_redacts(spark):
    rows = [(k, f"mail me: ann{k}@example.org or +1 (555) 010-000{k % 10} from 10.0.0.{k}", "x") for k in range(40)] + [(50, "write to bob [at] mail [dot] com", "x"), (51, None, "x"), (52, "nothing here", "x")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in pii.op9(docs).collect()}
    assert (got[3].n_email, got[3].n_ip, got[3].n_phone, got[51].spans, got[52].spans) == (1, 1, 1, "", "")
    assert "email:9:32" in got[50].spans and got[50].n_email == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert clean[3] == "mail me: <email> or <phone> from <ip>" and clean[51] is None and clean[52] == "nothing here"
    assert pii.op9(empty(spark)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<html><head><title> A &amp; b </title></head><body><p>One<br>two</p><script>x</script>&copy; three</body></html>", 9), (2, None, None, 9), (2, None, None, 9)], "page_id long, url string, html string, refers_to int")
    records = warc.derive(warc.responses(pages))
    rows = {(r.page_id, r.warc_type): r for r in records.collect()}
    assert records.count() == 6 and rows[1, "conversion"].block == "One\ntwo\n© three"
    assert rows[1, "conversion"].source_digest == "sha256:" + hashlib.sha256(pages.first().html.encode()).hexdigest()
    assert rows[1, "metadata"].refers_to == rows[1, "conversion"].refers_to != rows[2, "conversion"].refers_to
    data = b"".join(bytes(r.record) for r in warc.serialised(records.where("page_id = 1")).orderBy("warc_type").collect())
    found = list(warc.parse(data))
    assert [h["warc-type"] for h, _, _ in found] == ["conversion", "metadata"] and found[0][1].decode() == rows[1, "conversion"].block
    assert found[0][0]["warc-block-digest"] == "sha256:" + hashlib.sha256(found[0][1]).hexdigest()
    files = spark.createDataFrame([("f", bytearray(data)), ("none", None)], "path string, content binary")
    assert warc.read_records(files).count() == 2 and warc.op8(pages.limit(0)).count() == 0


def source_record(name, head, body, digest=""):
    block = ("\r\n".join(["HTTP/1.1 200 OK", *head]) + "\r\n\r\n").encode("latin-1") + body
    fields = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: http://{name}.example/", "WARC-Date: 2025-02-03T04:05:06Z", *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_read_derive_write_read(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "BATCH_BYTES", 2000)
    long = ("<p>" + "word " * 200_000 + "</p>").encode()
    sources = [source_record("a", ["Content-Type: text/html", "X-Note: one", "x-note: two", "Server: s\u00e9"], "<title>Tä</title><p>é</p>".encode(), "sha1:ORIGINAL"), source_record("b", [], b"<p>\xff broken \r\n\r\n bytes</p>"), source_record("c", ["Content-Type: text/html"], long), source_record("d", [], b"")]
    request = sources[0].replace(b"WARC-Type: response", b"WARC-Type: request")
    files = spark.createDataFrame([("one.gz", bytearray(b"".join(map(gzip.compress, sources[:3])))), ("two", bytearray(request + sources[3]))], "path string, content binary")
    records = warc.derive(warc.converted(warc.read_records(files))).cache()
    rows = {(r.refers_to[10:-1], r.warc_type): r for r in records.collect()}
    assert len(rows) == records.count() == 8
    a = rows["a", "metadata"]
    assert (a.target_uri, a.date, a.source_digest, a.source_type) == ("http://a.example/", "2025-02-03T04:05:06Z", "sha1:ORIGINAL", "text/html")
    assert a.source_headers == {"content-type": "text/html", "server": "s\u00e9", "x-note": "one, two"}
    assert a.block.split("\r\n") == ["title: Tä", "outlinks: 0", "source-content-type: text/html", "source-server: s\u00e9", "source-x-note: one, two", "source-payload-digest: sha1:ORIGINAL", ""]
    assert rows["b", "conversion"].source_digest == "sha256:" + hashlib.sha256(b"<p>\xff broken \r\n\r\n bytes</p>").hexdigest()
    assert "broken" in rows["b", "conversion"].block and len(rows["c", "conversion"].block) == 999_999 and rows["d", "conversion"].block == ""
    told = warc.write(records.repartition(2), f"file://{tmp_path}/out").collect()
    assert sum(t.n_records for t in told) == 8 and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(t.file.rsplit("/", 1)[1] for t in told)
    again = warc.read_records(spark.read.format("binaryFile").load(f"{tmp_path}/out")).collect()
    assert {(r.headers["warc-record-id"], bytes(r.block).decode(), r.headers["warc-refers-to"], r.headers["warc-block-digest"], r.headers["x-source-content-type"]) for r in again} == {(r.record_id, r.block, r.refers_to, r.block_digest, r.source_type) for r in rows.values()}
    assert len(again) == 8 and all(r.error is None for r in again)


def test_warc_damaged_records_are_rows(spark):
    good = source_record("a", [], b"x")
    import gzip

    cases = {"head": (good + good[:40], [None, "truncated header"]), "block": (good[:-8], ["truncated block"]), "length": (good.replace(b"Content-Length: ", b"Content-Length: x") + good, ["bad Content-Length", None]), "gzip": (gzip.compress(good) + gzip.compress(good)[:-9], [None, None, "truncated gzip"]), "noise": (gzip.compress(good) + b"noise", [None, "damaged gzip"]), "empty": (b"", [])}
    files = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "path string, content binary")
    got = collections.defaultdict(list)
    for r in warc.read_records(files).collect():
        got[r.path].append(r.error)
    for name, (_, want) in cases.items():
        assert len(got[name]) == len(want) and all(e is None if w is None else e.startswith(w) for e, w in zip(got[name], want, strict=True)), (name, got[name])
    assert warc.derive(warc.converted(warc.read_records(files))).count() == 2 * sum(w is None for _, ws in cases.values() for w in ws)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in seen.collect()}
        seen = stage(spark, seen, sf)
        after = {r.doc_id: r.text for r in seen.collect()}
        assert seen.columns == docs.columns and after.keys() <= before.keys(), name
        if name == "n-gram Jaccard join":
            want = brute_components(shingle_sets([(d, t, "") for d, t in before.items()]))
            assert set(after) == {d for d, c in want.items() if c == d}
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {d for d, t in before.items() if not brute_hits(t, items)[-1]}
        if name == "PII":
            assert all(not brute_pii(t) for t in after.values())
    assert corpus_pipeline.run(spark, sf).count() == seen.count()
