"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

Texts become sets of hashed five-word shingles; equal sets are one class. Every chunk of documents tells
hash shards its distinct shingles and hears how many documents hold each, so a document can order its
shingles by frequency (rarest first, then by hash). Two sets that overlap enough share at least l shingles
of their l-prefixes, the first n - ceil(0.8 n) + l shingles, for every l. So a document may lengthen
its prefix and ask for more shared shingles in return. Each picks the l that costs least: reading the
longer prefix's posting lists against verifying the candidates that share l entries by chance. A pair is
held to the smaller l of the two, then to the positional bound on what the rest can still add, and is at
last verified on the whole texts. Most prefixes hold only shingles that no other document has.

Links only matter between components, so near copies are first joined in stars around typical documents
(by minimum hashes, each link verified), then in chains along the posting lists. A shingle whose documents
are all in one component is settled; pairs are only made of what is left, never within a component.
`join` therefore has components but not all links; `links` gives every link between class representatives.

Null or wordless text has no shingles and no links. Rows with a null doc_id get n_shingles and no
component. Rows of one doc_id are one document: each of its texts is compared, and what any of them links
to is linked to it. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import chunked, mix, open_chunk, pack, texts_of, total_bytes, unpack, write_table
from postern.llm.graph import components as connected

SHINGLE = 5
#: Similarity as a fraction.
TIMES, OF = 80, 100
#: Largest number of shared prefix shingles that a document asks for.
MOST = 4
#: Bytes of text for each hash shard of all shingles.
SHARD_BYTES = 8 << 20
#: Rounds of chains along posting lists, and links that a document tries in each.
CHAINS, TRIES = 3, 3
BANDS, ROWS = 6, 3
#: Hubs that a document is compared with before any pairs are looked for.
HUBS = 3
#: Components in a list from which its pairs are judged whole in place; shorter lists' pairs are counted by shuffle.
LONG = 64
#: Documents in a pack of prefixes, and prefix shingles for each hash shard.
PACK_DOCS, SHARD_SHINGLES = 4096, 500_000
#: Times that the way from a hub to its root is doubled.
JUMPS = 2
#: Documents of one root, and bytes of how they differ from it, that are compared with each other or another block at once.
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
#: Bytes of bits that are kept while two blocks are compared, and of counts that are made at once; bits beyond are packed anew for each turn.
HELD_BYTES = 32 << 20
#: Documents that a task looks at together before it tells of its hubs and heads.
LOCAL_DOCS = 100_000
#: A list of document ids is broadcast up to this many (eight bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Verifying a candidate costs as much as reading this many postings.
VERIFY = 200.0
_KEY = np.uint64((1 << 40) - 1)
_40 = np.uint64(40)
_MULTIPLIERS = mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PERMUTE = mix(np.arange(100, 100 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_WORDS: dict[bytes, int] = {}


def word_list(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(text: bytes) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles."""
    words = word_list(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    get, put, hash_of = _WORDS.get, _WORDS.setdefault, xxhash.xxh3_64_intdigest
    h = np.array([get(w) or (put(w, hash_of(w)) if len(w) <= 64 else hash_of(w)) for w in words], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    size = min(SHINGLE, len(h))
    total = np.full(n, size, np.uint64) * _MULTIPLIERS[5]
    for k in range(size):
        total += h[k : k + n] * _MULTIPLIERS[k]
    return np.unique(mix(total))


def needed(n: int) -> int:
    """Shingles that a set of n shares at least with any set similar to it."""
    return -(-TIMES * n // OF)


def prefix_length(n: int, l: int) -> int:  # noqa: E741
    return n - needed(n) + l


def _sets(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Shingles of each text and a 128-bit hash of each set."""
    sets = [shingles(t) for t in texts]
    return sets, [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]


def _split(h: np.ndarray, n_shards: int) -> np.ndarray:
    """shard << 40 | 40 hash bits."""
    return (h >> _40) % np.uint64(n_shards) << _40 | h & _KEY


def _frequencies(chunks: DataFrame, n_shards: int) -> DataFrame:
    """Each chunk's shingles that several sets hold, with the number of sets (as far as 65535).

    Equal sets of a chunk count once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                sets, names = _sets(open_chunk(blob)[1])
                keys, n = np.unique(_split(np.concatenate([np.zeros(0, np.uint64), *dict(zip(names, sets, strict=True)).values()]), n_shards), return_counts=True)
                if len(keys):
                    yield _rows([(s, chunk, pack([_thin(keys[at]), n[at].astype(np.uint32)])) for s, at in _by_shard(keys)])

    def count(key: tuple, got: pa.Table) -> pa.Table:
        told = _told(got)
        every = [_wide(x[0]) for _, x in told]
        _, where = np.unique(np.concatenate(every), return_inverse=True)
        n = np.bincount(where, np.concatenate([np.frombuffer(x[1], np.uint32) for _, x in told]))
        out, at = [], 0
        for (chunk, _), mine in zip(told, every, strict=True):
            found = n[where[at : at + len(mine)]]
            at += len(mine)
            if (yes := found > 1).any():
                out.append((chunk, pack([_thin(mine[yes]), np.minimum(found[yes], 65535).astype(np.uint16)])))
        return _table(key[0].as_py(), out)

    return chunks.mapInArrow(rows, _TOLD).groupBy("shard").applyInArrow(count, _TOLD)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("prefix", pa.binary()), ("place", pa.binary())])


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_hash, bands; prefix and place: the shingles that several sets hold among the first prefix_length(n, MOST), and where they stand.

    A shingle is written as its heat and 58 bits of its hash, so that numbers sort as prefixes do.
    """
    chunks = chunked(docs)
    n_shards = max(1, -(-total_bytes(chunks) // SHARD_BYTES))

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(_wide(k) | np.uint64(s) << _40, np.frombuffer(c, np.uint16)) for s, (k, c) in ((s, unpack(x)) for s, x in zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True))]
        known, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(1, np.uint64), np.ones(1, np.uint16))
        order = np.argsort(known)
        known, count = known[order], count[order]
        out: list[list] = [[] for _ in _SIGNED]
        for blob in left.column("blob").to_pylist():
            ids, texts = open_chunk(blob)
            for doc, h, name in zip(ids, *_sets(texts), strict=True):
                n = len(h)
                key = _split(h, n_shards)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                heat = np.where(known[at] == key, np.log2(count[at]).astype(np.int64) + 1, 0)
                # Within one heat any fixed order serves.
                first = np.lexsort((h, heat))[: min(n, prefix_length(n, MOST))]
                place = np.flatnonzero(heat[first])
                bands = [xxhash.xxh3_64_intdigest(np.array([(h * _PERMUTE[k]).min() for k in range(b * ROWS, (b + 1) * ROWS)]).tobytes() + bytes([b])) >> 1 for b in range(BANDS)] if n else []
                ordered = heat[first].astype(np.uint64) << np.uint64(58) | h[first] >> np.uint64(6)
                for to, x in zip(out, (doc, n, name, bands, ordered[place].tobytes(), place.astype(np.int32).tobytes()), strict=True):
                    to.append(x)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SIGNED, strict=True)], schema=_SIGNED)

    told = _frequencies(chunks, n_shards).withColumnRenamed("pack", "chunk")
    return write_table(chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(sign, "doc_id long, n long, set_hash binary, bands array<long>, prefix binary, place binary"), "signatures")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """A task's rows, LOCAL_DOCS at most at once."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            if len(rows) >= LOCAL_DOCS:
                yield rows
                rows = []
    yield rows


def _stars(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: each document and the hubs of its buckets, HUBS at most; and doc_id, root: the hub over all tasks of a document's first hub.

    A bucket's hub is its most typical document: the one whose buckets are the fullest. Among copies that were
    changed here and there, that is one with few changes, which most others are similar to. A task links its
    own documents before it tells others of its hubs, so a large bucket is a few rows a task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen in _portions(batches):
            fill = Counter(k for _, bands in seen for k in bands)
            typical = {doc: sum(math.log2(fill[k]) for k in bands) for doc, bands in seen}
            hub: dict[int, tuple[float, int]] = {}
            for doc, bands in seen:
                for k in bands:
                    hub[k] = min(hub.get(k, (0.5, 0)), (-typical[doc], doc))
            out = []
            for doc, bands in seen:
                votes = Counter(hub[k][1] for k in bands if hub[k][1] != doc)
                out += [(None, doc, to, None, k) for k, to in enumerate(sorted(votes, key=lambda d: (-votes[d], d))[:HUBS])]
            out += [(k, doc, None, -t, fill[k]) for k, (t, doc) in hub.items()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["bucket", "a", "b", "typical", "fill"])

    found = write_table(reps.select("doc_id", "bands").mapInArrow(local, "bucket long, a long, b long, typical double, fill long"), "buckets")
    told = found.where("bucket is not null")
    # Over all tasks: how full a bucket is, then how typical each local hub is, then each bucket's hubs.
    fills = told.groupBy("bucket").agg(F.sum("fill").alias("all"), F.count("*").alias("tasks")).where("tasks > 1")
    known = write_table(told.join(fills, "bucket").select("bucket", "a", F.log2("all").alias("weight")), "hubs")
    best = known.groupBy("a").agg(F.sum("weight").alias("typical"))
    hubs = known.join(best, "a").groupBy("bucket").agg(F.max(F.struct("typical", (-F.col("a")).alias("least"))).alias("top"), F.collect_set("a").alias("all"))
    votes = hubs.select(F.explode("all").alias("a"), (-F.col("top.least")).alias("b")).where("a <> b").groupBy("a", "b").count()
    across = votes.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", (-F.col("b")).alias("least"))), asc=False), 1, HUBS).alias("top")).select("a", F.posexplode("top").alias("k", "t")).select("a", (-F.col("t.least")).alias("b"), (F.col("k") == 0).alias("first"))
    across = write_table(across, "across")
    stars = found.where("bucket is null").select("a", "b").unionByName(across.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # From a document to its first hub in its own portion, from hub to hub there, then over all tasks: each is more typical
    # than the one before, and the last is the root.
    mine = found.where("bucket is null and fill = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("hub"))
    over = across.where("first").select(F.col("a").alias("hub"), F.col("b").alias("top"))
    hubs = mine.select("hub").union(over.select("hub")).distinct()
    tops = hubs.join(mine.select(F.col("doc_id").alias("hub"), F.col("hub").alias("near")), "hub", "left").join(over, "hub", "left").select("hub", F.coalesce("near", "top", "hub").alias("top"))
    tops = write_table(tops, "tops")
    for _ in range(JUMPS):
        onward = tops.select(F.col("hub").alias("top"), F.col("top").alias("next"))
        tops = write_table(tops.join(onward, "top", "left").select("hub", F.coalesce("next", "top").alias("top")), "tops")
    own = reps.select("doc_id").join(mine, "doc_id", "left").withColumn("hub", F.coalesce("hub", "doc_id"))
    return stars, own.join(tops, "hub", "left").select("doc_id", F.coalesce("top", "hub").alias("root"))


def _members(real: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id with the same shingles. A task finds its own smallest first, so copies are a row a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen in _portions(batches):
            least: dict[bytes, int] = {}
            for doc, key in seen:
                if doc < least.get(key, doc + 1):
                    least[key] = doc
            out = [(doc, least[key], None) for doc, key in seen] + [(None, doc, key) for key, doc in least.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "head", "set_hash"])

    found = write_table(real.select("doc_id", "set_hash").mapInArrow(local, "doc_id long, head long, set_hash binary"), "heads")
    heads = found.where("doc_id is null").select("head", "set_hash")
    classes = heads.groupBy("set_hash").agg(F.min("head").alias("class_id"))
    # A document that heads two sets (rows of one doc_id) belongs to the classes of both.
    return write_table(found.where("doc_id is not null").select("doc_id", "head").join(heads.join(classes, "set_hash").select("head", "class_id"), "head").select("doc_id", "class_id").distinct(), "members")


def _sides(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b and their compressed texts x, y, for a table of pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    small = F.broadcast if pairs.count() <= BROADCAST_IDS // 2 else (lambda df: df)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([z.compress(t) for t in texts_of(batch.column("text"))], pa.binary())], ["doc_id", "packed"])

    texts = write_table(docs.select("doc_id", "text").join(small(ids), "doc_id").mapInArrow(shrink, "doc_id long, packed binary").dropDuplicates(["doc_id"]), "texts")
    return pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar, compared shingle by shingle."""

    def exact(packed: bytes, last: list) -> set:
        if last[0] != packed:
            words = word_list(zstandard.ZstdDecompressor().decompress(packed))
            last[:] = packed, set(zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else {tuple(words)} if words else set()
        return last[1]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = [None, None], [None, None]
        for batch in batches:
            good = []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = exact(p, one), exact(q, two)
                both = len(x & y)
                good.append(both > 0 and OF * both >= TIMES * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _sides(write_table(pairs, "pairs"), docs).mapInArrow(check, "a long, b long")


_DELTA = pa.schema([("root", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("gone", pa.int64()), ("whole", pa.int64()), ("delta", pa.binary())])


def _deltas(open_ids: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """root, doc_id, n, gone, whole, delta: how each open document differs from its root, where they have half their shingles in common.

    delta: hashes of the shingles that one of both holds; gone: how many of them are the root's; whole: the root's set.
    """
    near = write_table(open_ids.join(roots, "doc_id").select(F.col("doc_id").alias("a"), F.col("root").alias("b")), "roots")
    heads = near.select("b").distinct().select(F.col("b").alias("a"), "b")
    pairs = near.where("a <> b").unionByName(heads)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]

        def of(packed: bytes) -> np.ndarray:
            return shingles(zstandard.ZstdDecompressor().decompress(packed))

        for batch in batches:
            out = []
            for a, b, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                if last[0] != q:
                    last[:] = q, of(q)
                x, h = of(p), last[1]
                delta = np.setxor1d(x, h, assume_unique=True)
                gone = (len(delta) + len(h) - len(x)) // 2
                if 2 * (len(h) - gone) >= len(x) + gone:
                    out.append((b, a, len(x), gone, len(h), delta.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_DELTA)], schema=_DELTA)

    return write_table(_sides(write_table(pairs, "pairs"), docs).mapInArrow(differ, "root long, doc_id long, n long, gone long, whole long, delta binary"), "deltas")


def _spanning_links(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, gone: np.ndarray, whole: int, deltas: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join all of a root's documents that links join; `side`: only pairs of unequal sides.

    With x = root - R + A, |x & y| = |root| - |R of x| - |R of y| + |delta of x & delta of y|, so what pairs share is
    counted in bits over the few shingles that several deltas hold. A link that would join what is joined is passed over.
    """
    m = len(ids)
    _, comp = np.unique(comp, return_inverse=True)
    if comp.max() == 0:
        return []
    owner = np.repeat(np.arange(m), [len(d) for d in deltas])
    token, at, count = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    several = np.cumsum(count > 1) - 1
    use = count[at] > 1
    column, row = several[at[use]], owner[use]
    columns = int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]

    def slices() -> Iterator[np.ndarray]:
        for low in range(0, columns, 2048):
            a, b = np.searchsorted(column, (low, low + 2048))
            held = np.zeros((m, 2048), np.bool_)
            held[row[a:b], column[a:b] - low] = True
            yield np.packbits(held, axis=1).view(np.uint64)

    kept = list(slices()) if m * columns <= 8 * HELD_BYTES else None
    out, first, turn = [], 0, 32
    while first < m and (comp != comp[0]).any():
        mine = range(first, min(m, first + turn))
        shared = np.zeros((len(mine), m), np.int32)
        for bits in kept or slices():
            for k, x in enumerate(mine):
                shared[k] += np.bitwise_count(bits & bits[x]).sum(1, dtype=np.int32)
        for k, x in enumerate(mine):
            both = whole - gone[x] - gone + shared[k]
            good = ((TIMES + OF) * both >= TIMES * (n[x] + n)) & (comp != comp[x])
            if side is not None:
                good &= side != side[x]
            for y in np.flatnonzero(good).tolist():
                if comp[y] != comp[x]:
                    out.append((int(ids[x]), int(ids[y])))
                    comp[comp == comp[y]] = comp[x]
        # The least changed come first and may join all; otherwise the bits are packed anew as seldom as the counts allow.
        first, turn = mine.stop, max(32, HELD_BYTES // (4 * m))
    return out


def _grouped_links(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: links that join what links join among documents of one root, told by their hashes.

    A root's documents are dealt to blocks of bounded number and size, and every two blocks are compared in one task.
    """
    rows = _labelled(deltas, labels)
    sizes = rows.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("delta") + 40).alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.col("bytes") / BLOCK_BYTES))
    sizes = write_table(sizes.select("root", blocks.alias("blocks")), "sizes")
    small = F.broadcast if sizes.count() <= BROADCAST_IDS // 2 else (lambda df: df)
    dealt = rows.join(small(sizes), "root").withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = write_table(dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("*", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).drop("other", "blocks"), "blocks")
    packs = 1 + dealt.count() // BLOCK_DOCS

    def link(key: tuple, got: pa.Table) -> pa.Table:
        columns = [got.column(c).to_numpy() for c in ("root", "i", "j", "doc_id", "component", "n", "gone", "whole", "side")]
        deltas = got.column("delta").to_pylist()
        order = np.lexsort((columns[3], *columns[2::-1]))
        keys = np.stack([c[order] for c in columns[:3]], 1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])).tolist()
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[a:b]
            _, i, j, ids, comp, n, gone, whole, side = (c[at] for c in columns)
            # The least changed first: they join the most.
            held = [np.frombuffer(deltas[k], np.uint64) for k in at.tolist()]
            by = np.argsort([len(d) for d in held], kind="stable")
            out += _spanning_links(ids[by], comp[by], n[by], gone[by], int(whole[0]), [held[k] for k in by.tolist()], side[by] if i[0] != j[0] else None)
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return dealt.groupBy(F.pmod(F.xxhash64("root", "i", "j"), F.lit(packs))).applyInArrow(link, "a long, b long").distinct()


def _packs(labelled: DataFrame) -> DataFrame:
    """Documents' prefixes with their components, PACK_DOCS to a row."""
    import pyspark

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = pyspark.TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_DOCS):
                b = batch.slice(at, PACK_DOCS)
                prefix = b.column("prefix").to_pylist()
                blob = pack([np.array(b.column(c).to_pylist(), np.int64) for c in ("doc_id", "n", "component")] + [np.array([len(p) // 8 for p in prefix], np.int64), b"".join(prefix), b"".join(b.column("place").to_pylist())])
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([sum(map(len, prefix)) // 8], pa.int64()), pa.array([blob], pa.binary())], ["pack", "entries", "blob"])
                seq += 1

    return write_table(labelled.select("doc_id", "n", "component", "prefix", "place").mapInArrow(rows, "pack long, entries long, blob binary"), "packs")


class Pack:
    def __init__(self, blob: bytes, n_shards: int) -> None:
        ids, n, comp, sizes, prefix, place = unpack(blob)
        self.ids, self.n, self.comp, self.sizes = (np.frombuffer(x, np.int64) for x in (ids, n, comp, sizes))
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.place = np.frombuffer(place, np.int32).astype(np.int64)
        self.token = np.frombuffer(prefix, np.uint64)
        self.key = _split(self.token, n_shards)


def _thin(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(x: memoryview) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


_TOLD = "shard int, pack long, payload binary"


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["shard", "pack", "payload"])


def _by_shard(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    shard = (key >> _40).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(shard[a]), slice(a, b)


def _lists(packs: DataFrame, n_shards: int) -> DataFrame:
    """Each pack's distinct (shingle, component) entries, to the shingle's shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("pack").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                p = Pack(blob, n_shards)
                comp = p.comp[p.owner]
                order = np.lexsort((comp, p.key))
                key, comp = p.key[order], comp[order]
                new = np.ones(len(key), np.bool_)
                new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
                key, comp = key[new], comp[new]
                if len(key):
                    yield _rows([(s, number, pack([_thin(key[at]), comp[at]])) for s, at in _by_shard(key)])

    return packs.mapInArrow(rows, _TOLD)


def _told(got: pa.Table) -> list[tuple[int, list[memoryview]]]:
    return [(c, unpack(p)) for c, p in sorted(zip(got.column("pack").to_pylist(), got.column("payload").to_pylist(), strict=True))]


def _table(shard: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows([(shard, c, p) for c, p in rows])])


def _spanning(key: tuple, got: pa.Table) -> pa.Table:
    """A shard answers each pack: its shingles whose lists span components, and how many components."""
    told = _told(got)
    every = [_wide(x[0]) for _, x in told]
    keys, comps = np.concatenate(every), np.concatenate([np.frombuffer(x[1], np.int64) for _, x in told])
    order = np.lexsort((comps, keys))
    k, c = keys[order], comps[order]
    new = np.ones(len(k), np.bool_)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    distinct, n = np.unique(k[new], return_counts=True)
    out = []
    for (number, _), mine in zip(told, every, strict=True):
        mine = np.unique(mine)
        found = n[np.searchsorted(distinct, mine)]
        if (yes := found > 1).any():
            out.append((number, pack([_thin(mine[yes]), found[yes].astype(np.uint32)])))
    return _table(key[0].as_py(), out)


def best_l(n: int, place: np.ndarray, spans: np.ndarray, documents: int) -> int:
    """The number of shared prefix shingles to ask for. spans: components in the list of the shingle at each place."""
    best, least = 1, math.inf
    for l in range(1, min(MOST, needed(n)) + 1):  # noqa: E741
        read = float(np.maximum(0, spans[place < prefix_length(n, l)].astype(float) - 1).sum())
        chance = documents * (read / documents) ** l / math.factorial(l)
        if (cost := read + VERIFY * chance) < least:
            best, least = l, cost
    return best


_POSTING = pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in ("token", "doc_id", "n", "place", "l", "most")), ("tokens", pa.binary()), ("places", pa.binary())])


def _postings(packs: DataFrame, answers: DataFrame, n_shards: int, documents: int) -> DataFrame:
    """Entries of shingles whose lists span components, within the prefixes that their documents chose."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        told = list(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True))
        for blob in left.column("blob").to_pylist() if told else ():
            p = Pack(blob, n_shards)
            parts = [(_wide(k) | np.uint64(s) << _40, np.frombuffer(c, np.uint32)) for s, (k, c) in ((s, unpack(x)) for s, x in told)]
            known, count = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            order = np.argsort(known)
            known, count = known[order], count[order]
            at = np.minimum(np.searchsorted(known, p.key), len(known) - 1)
            spans = np.where(known[at] == p.key, count[at], 0)
            ends = np.cumsum(p.sizes).tolist()
            chosen = np.array([best_l(n, p.place[e - s : e], spans[e - s : e], documents) if s and spans[e - s : e].any() else 1 for n, s, e in zip(p.n.tolist(), p.sizes.tolist(), ends, strict=True)], np.int64)
            reach = p.n - -(-TIMES * p.n // OF)  # prefix length without l
            # Shingles of no other document cannot be shared: where too little is left, the document is settled.
            most = p.n - np.minimum(p.n, reach + MOST) + p.sizes
            use = np.flatnonzero((spans > 0) & (p.place < (reach + chosen)[p.owner]) & (most >= p.n - reach)[p.owner])
            who = p.owner[use]
            cuts = np.searchsorted(who, np.arange(len(p.n) + 1)).tolist()
            token, place = p.token[use], (p.place[use] * 2 + (spans[use] > LONG)).astype(np.int32)
            tokens, places = ([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)] for x in (token, place))
            ints = (token.astype(np.int64), p.ids[who], p.n[who], p.place[use], chosen[who], most[who])
            # Frequent shingles come last in a prefix: those that meet in a long list are few, and so are their documents.
            long = (spans[use] > LONG).tolist()
            carried = [pa.array([x[k] if yes else None for k, yes in zip(who.tolist(), long, strict=True)], pa.binary()) for x in (tokens, places)]
            out.append(pa.Table.from_arrays([pa.array((p.key[use] >> _40).astype(np.int32)), *map(pa.array, ints), *carried], schema=_POSTING))
        return pa.concat_tables(out) if out else _POSTING.empty_table()

    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(rows, "shard int, token long, doc_id long, n long, place long, l long, most long, tokens binary, places binary")


class List:
    """A shard's postings, by token and then in the order asked for."""

    def __init__(self, got: pa.Table, chained: bool) -> None:
        self.token, self.ids, self.comp, self.root, self.n, self.place, self.l, self.most = (got.column(c).to_numpy() for c in ("token", "doc_id", "component", "root", "n", "place", "l", "most"))
        within = mix((self.ids + self.token).astype(np.uint64)) if chained else self.n
        self.order = np.lexsort((self.ids, within, self.token))
        t = self.token[self.order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        self.lists = list(zip(first.tolist(), [*first[1:].tolist(), len(t)], strict=True)) if len(t) else []

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs of entries are of two components and not yet compared by their root, near enough in size, with enough left to share."""
        small, large = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        return (self.comp[x] != self.comp[y]) & (self.root[x] != self.root[y]) & (OF * small >= TIMES * large) & ((TIMES + OF) * np.minimum(self.most[x], self.most[y]) >= TIMES * (small + large))


def _chained(key: tuple, got: pa.Table) -> pa.Table:
    """Each entry with the next one of its list (in an order of the list's own) that is of another component."""
    p = List(got, True)
    x, y = p.order[:-1], p.order[1:]
    good = (p.token[x] == p.token[y]) & p.possible(x, y)
    a, b = p.ids[x[good]], p.ids[y[good]]
    pairs, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_counts=True)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "n": n})




class Entry:
    """A document in a list: its posted shingles as bits, in prefix order: all, those in long lists, and those within each l-prefix.

    places: twice the place, plus one where the shingle's list is long.
    """

    def __init__(self, n: int, l: int, tokens: list[int], places: list[int], bit: dict[int, int]) -> None:  # noqa: E741
        self.n, self.l = n, l
        self.place = {t: p >> 1 for t, p in zip(tokens, places, strict=True)}
        self.bits = sum(1 << bit[t] for t in tokens)
        self.long = sum(1 << bit[t] for t, p in zip(tokens, places, strict=True) if p & 1)
        reach = n - needed(n)
        self.within = [sum(1 << bit[t] for t, p in self.place.items() if p < reach + k) for k in range(MOST + 1)]


def _passes(x: Entry, y: Entry, token: int, order: list[int]) -> bool:
    """Whether a pair is a candidate, told in the first long list that both are in and nowhere else."""
    meet = x.long & y.long
    if not meet or order[(meet & -meet).bit_length() - 1] != token:
        return False
    common = x.bits & y.bits
    l = min(x.l, y.l)  # noqa: E741
    if (x.within[l] & y.within[l]).bit_count() < l:
        return False
    last = order[common.bit_length() - 1]
    most = common.bit_count() + min(x.n - x.place[last], y.n - y.place[last]) - 1
    return (TIMES + OF) * most >= TIMES * (x.n + y.n)


_PAIRS = pa.schema([*((c, pa.int64()) for c in ("a", "b", "na", "nb", "l", "shared", "counted", "last_a", "last_b")), ("sure", pa.bool_())])


def _long_pairs(p: List, own: np.ndarray, tokens: list, places: list) -> Iterator[tuple[int, int]]:
    """Candidates of a long list. Its postings carry all that their documents posted, so a pair is judged where it first meets."""
    held = {k: (np.frombuffer(tokens[k], np.uint64).tolist(), np.frombuffer(places[k], np.int32).tolist()) for k in own.tolist()}
    order = sorted({t for ts, _ in held.values() for t in ts})
    bit = {t: k for k, t in enumerate(order)}
    entries = {k: Entry(int(p.n[k]), int(p.l[k]), ts, ps, bit) for k, (ts, ps) in held.items()}
    token = int(p.token[own[0]]) & 0xFFFFFFFFFFFFFFFF
    for i in range(len(own) - 1):  # sizes ascend: partners end where they grow too large
        x, y = own[i], own[i + 1 :]
        y = y[: np.searchsorted(p.n[y], OF * p.n[x] // TIMES, side="right")]
        one = entries[int(x)]
        for k in y[p.possible(np.full(len(y), x), y)].tolist():
            if _passes(one, entries[k], token, order):
                yield int(x), k


def _pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents of different components: candidates of long lists, and what pairs share in this shard's short lists.

    A pair that meets in both kinds is judged rightly in the long list, whatever the short lists alone say.
    """
    got = pa.Table.from_batches(batches)
    p = List(got, False)
    tokens, places = (got.column(c).to_pylist() for c in ("tokens", "places"))
    reach = p.n - -(-TIMES * p.n // OF)
    level = np.maximum(1, p.place - reach + 1)
    sure: list[tuple[int, int]] = []
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def rows() -> pa.RecordBatch:
        s = np.array(sure, np.int64).reshape(-1, 2)
        x, y = np.concatenate([*xs, s[:, 0]]), np.concatenate([*ys, s[:, 1]])
        swap = p.ids[x] > p.ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        l = np.minimum(p.l[x], p.l[y])  # noqa: E741
        counted = (np.maximum(level[x], level[y]) <= l).astype(np.int64)
        known = np.arange(len(x)) >= len(x) - len(s)
        columns = (p.ids[x], p.ids[y], p.n[x], p.n[y], l, np.ones(len(x), np.int64), counted, p.place[x], p.place[y], known)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PAIRS)

    for a, b in p.lists:
        own = p.order[a:b]
        if len(set(p.comp[own].tolist())) < 2 or len(set(p.root[own].tolist())) < 2:
            continue
        if tokens[own[0]] is not None:
            for pair in _long_pairs(p, own, tokens, places):
                sure.append(pair)
                if len(sure) >= 100_000:
                    yield rows()
                    sure, xs, ys = [], xs[:1], ys[:1]
            continue
        for i in range(len(own) - 1):
            y = own[i + 1 :]
            x = np.full(len(y), own[i])
            good = p.possible(x, y)
            xs.append(x[good])
            ys.append(y[good])
    yield rows()


def _candidates(postings: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as asked for and can still overlap enough."""
    found = postings.groupBy("shard").applyInArrow(_pairs, ", ".join(f"`{c}` {'boolean' if c == 'sure' else 'long'}" for c in _PAIRS.names))
    found = found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("l").alias("l"), F.sum("shared").alias("shared"), F.sum("counted").alias("counted"), F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b"), F.bool_or("sure").alias("sure"))
    most = F.col("shared") + F.least(F.col("na") - F.col("last_a") - 1, F.col("nb") - F.col("last_b") - 1)
    return found.where(F.col("sure") | (F.col("counted") >= F.col("l")) & ((TIMES + OF) * most >= TIMES * (F.col("na") + F.col("nb")))).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


_POSTED = ("shard", "token", "doc_id", "component", "root", "n", "place", "l", "most", "tokens", "places")


def _spanning_only(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings with their components' labels of now, without the lists that one component or root has come to hold.

    The smallest and the largest label of a list are partial aggregates, so settled lists are never gathered.
    """
    now = write_table(_labelled(postings.drop("component"), labels), "postings")
    held = [f(c).alias(f"{name}_{c}") for c in ("component", "root") for f, name in ((F.min, "low"), (F.max, "high"))]
    open_lists = now.groupBy("shard", "token").agg(*held).where("low_component < high_component and low_root < high_root").select("shard", "token")
    return write_table(now.join(open_lists, ["shard", "token"], "left_semi").select(*_POSTED), "postings")


def _chain_links(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links among each document's TRIES most frequent neighbours along the lists."""
    next_to = postings.groupBy("shard").applyInArrow(_chained, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = next_to.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("b")).alias("least"))), asc=False), 1, TRIES).alias("top"))
    return write_table(_verified(top.select("a", F.explode("top").alias("t")).select("a", (-F.col("t.least")).alias("b")), docs), "chains")


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """All signatures; those with shingles, with a `node` each; the texts by node (as doc_id); and whether any node is not a doc_id.

    A node is a doc_id with one set of shingles. Where rows of one doc_id have several, each of them is a node named by a
    hash, so that every text is compared.
    """
    signed = _signatures(docs)
    real = signed.where("doc_id is not null and n > 0")
    several = write_table(real.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low < high").select("doc_id"), "several")
    if several.isEmpty():
        return signed, real.withColumn("node", F.col("doc_id")), docs.select("doc_id", "text"), False
    small = F.broadcast if several.count() <= BROADCAST_IDS else (lambda df: df)
    name = F.xxhash64("doc_id", "set_hash")
    nodes = real.join(small(several.withColumn("many", F.lit(True))), "doc_id", "left").withColumn("node", F.when(F.col("many"), name).otherwise(F.col("doc_id"))).drop("many")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(_sets(texts_of(batch.column("text")))[1], pa.binary())], ["doc_id", "text", "set_hash"])

    apart = docs.select("doc_id", "text").join(small(several), "doc_id").mapInArrow(named, "doc_id long, text string, set_hash binary").select(name.alias("doc_id"), "text")
    texts = docs.select("doc_id", "text").join(small(several), "doc_id", "left_anti").unionByName(write_table(apart, "apart"))
    return signed, write_table(nodes, "nodes"), texts, True


def _linked(real: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, class_id of every document with shingles; and a, b: links that join what links join."""
    member = _members(real)
    reps = real.join(member.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_hash"])
    same = member.where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    stars, roots = _stars(reps)
    near = write_table(_verified(stars, docs), "stars")
    labels = connected(near)
    packs = _packs(_labelled(reps.select("doc_id", "n", "prefix", "place"), labels))
    sums = packs.agg(F.sum("entries").alias("entries")).first()["entries"] or 0
    documents = max(1, reps.count())
    n_shards = max(1, -(-sums // SHARD_SHINGLES))
    answers = write_table(_lists(packs, n_shards).groupBy("shard").applyInArrow(_spanning, _TOLD), "spanning")
    postings = _spanning_only(_postings(packs, answers, n_shards, documents).withColumn("root", F.col("doc_id")), labels)
    deltas = _deltas(postings.select("doc_id").distinct(), roots, docs)
    near = write_table(near.unionByName(_verified(_grouped_links(deltas, labels), docs)), "grouped")
    labels = connected(near)
    # A root was compared in its own group and, where it has a root itself, in that one's: either may name it.
    compared = deltas.groupBy("doc_id").agg(F.min(F.struct((F.col("root") != F.col("doc_id")).alias("other"), "root"))["root"].alias("root"))
    postings = _spanning_only(postings.drop("root").join(compared, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), labels)
    for _ in range(CHAINS):
        links = _chain_links(postings, docs)
        if links.isEmpty():
            break
        near = near.unionByName(links)
        labels = connected(near)
        postings = _spanning_only(postings, labels)
    links = _verified(_candidates(postings), docs)
    return member, near.unionByName(links).unionByName(same)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same shingles), component_id."""
    signed, nodes, texts, apart = _nodes(docs)
    member, pairs = _linked(nodes.drop("doc_id").withColumnRenamed("node", "doc_id"), texts)
    if apart:
        names = write_table(nodes.select("node", "doc_id").distinct(), "names")
        hashed = names.where("node <> doc_id")
        found = connected(pairs.unionByName(hashed.select(F.col("node").alias("a"), F.col("doc_id").alias("b"))))
        least = found.join(hashed, "node", "left_anti").groupBy("component").agg(F.min("node").alias("least"))
        found = found.join(least, "component").select("node", F.col("least").alias("component"))
        member = member.withColumnRenamed("doc_id", "node").join(names, "node")
        member = member.join(member.groupBy("class_id").agg(F.min("doc_id").alias("least")), "class_id").select("doc_id", F.col("least").alias("class_id"))
    else:
        found = connected(pairs)
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(member.groupBy("doc_id").agg(F.min("class_id").alias("class_id")), "doc_id", "left").join(found.withColumnsRenamed({"node": "doc_id", "component": "component_id"}), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def links(docs: DataFrame) -> DataFrame:
    """a, b (a < b): every verified pair of class representatives (smallest doc_ids of equal sets), those within components too.

    As many rows as there are similar pairs: a group of n near copies may have n (n - 1) / 2.
    """
    _, nodes, texts, apart = _nodes(docs)
    real = nodes.drop("doc_id").withColumnRenamed("node", "doc_id")
    member = _members(real)
    reps = write_table(real.join(member.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_hash"]), "reps")
    # Each document is its own component, so no list is settled and no pair left out.
    alone = reps.select("doc_id", "n", "prefix", "place", F.col("doc_id").alias("component"))
    packs = write_table(_packs(alone), "packs")
    sums = packs.agg(F.sum("entries").alias("entries")).first()["entries"] or 0
    n_shards = max(1, -(-sums // SHARD_SHINGLES))
    answers = write_table(_lists(packs, n_shards).groupBy("shard").applyInArrow(_spanning, _TOLD), "spanning")
    postings = _postings(packs, answers, n_shards, max(1, reps.count())).withColumns({"component": F.col("doc_id"), "root": F.col("doc_id")})
    postings = write_table(postings.select(*_POSTED), "postings")
    pairs = _verified(_candidates(postings), texts)
    if not apart:
        return pairs
    # A class is named by its smallest doc_id, whichever of its nodes was compared.
    names = member.withColumnRenamed("doc_id", "node").join(nodes.select("node", "doc_id"), "node").groupBy("class_id").agg(F.min("doc_id").alias("name"))
    for side in "ab":
        pairs = pairs.join(names.withColumnRenamed("class_id", side), side).drop(side).withColumnRenamed("name", side)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one of the smallest doc_id (where its rows repeat, the one of the smallest text)."""
    kept = join(docs).where("component_id = doc_id").select("doc_id").distinct()
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    return rows.groupBy("doc_id").agg(F.min_by("row", "text").alias("row")).select("row.*").unionByName(docs.where("doc_id is null"))


def op4(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id", "class_id")
