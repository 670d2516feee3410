"""Token-id output: documents as ids in range-coded record files, in ascending doc_id order.

Texts are dealt to ranges of doc_id, sorted, tokenised and written as records of about RECORD_IDS ids
(`token_coder`), each with an index of its documents. A file's rows are (part, seq, start, record):
`start` counts the ids before the record within its part, so positions over all files need only one
number a part.

The container is Parquet, whose committer makes a rerun task's file replace the lost one's.

Null text is an empty text: its end id alone. A null doc_id sorts first. Equal doc_ids sort by
their texts. An empty table writes no records. Extra columns are not written.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import pack, unpack, write_table
from postern.llm.token_coder import decode, encode

#: Ids that a record holds before it is closed (documents are never split between records).
RECORD_IDS = 10 << 20
#: Text bytes of a file: mostly one record, whose blocks are coded side by side. A short second record would cost as many steps as the first.
FILE_BYTES = 16 << 20
END_ID = 1
#: Text bytes that are tokenised at a time, each distinct word once. A longer single text is taken alone.
SLICE_BYTES = 9 << 20
#: Words and pieces whose ids a worker keeps, words of the last slice that it starts anew with, and the longest that it takes.
CACHE_PIECES, CACHE_WORDS, CACHE_BYTES = 900_000, 450_000, 64
BITS = 16

# The vocabulary's split of a text into pieces, for plain ASCII in lower case and for any letters.
ASCII_PIECES = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
PIECES = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: What a word may be made of for its pieces to be told outside the library: no marks, controls or odd spaces.
PLAIN = r"[\p{L}\p{N}\p{P}\p{S}]+"


def _bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class _Tokenizer:
    """Ids by the library, each distinct piece of a word once a cache's life; texts by their distinct words.

    No token crosses white space, so words are encoded apart. A word is split as the vocabulary's pattern
    splits it; pieces new to the cache go to the library as one text, blanks between them. Every piece
    gives at least one id that ends a word, and one at most if it was told rightly: where the number of such
    ids is the number of pieces, each piece's ids are known, otherwise the library takes them one by one.
    Words with special tokens, marks or controls go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        #: For pieces in lower-case ASCII: nothing to normalise, cut at blanks alone.
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer = None
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.inner.get_vocab_size() > 1 << BITS:
            raise ValueError("vocabularies of up to 65536 ids only")
        suffix = getattr(self.inner.model, "end_of_word_suffix", None) or "\0"
        self.ends = np.zeros(1 << BITS, np.bool_)
        self.ends[[k for t, k in self.inner.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.special = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        self.lower = [s.lower() for s in self.special]
        if not all(b"|" in s for s in self.special):
            raise ValueError("special tokens must hold a bar")
        self.ascii, self.pieces, self.plain = re.compile(ASCII_PIECES), regex.compile(PIECES), regex.compile(PLAIN)
        #: By words and pieces, the ASCII ones in lower case.
        self.known: dict[bytes, bytes] = {}

    def _one_by_one(self, texts: list[bytes]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.inner.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _split(self, word: bytes) -> list[bytes] | None:
        """A word's pieces, the ASCII ones in lower case; None where only the library can tell."""
        if word.isascii():
            low = word.lower()
            return None if b"|" in low and any(s in word for s in self.special) else self.ascii.findall(low)
        text = word.decode()
        if not text.isalpha() and (not self.plain.fullmatch(text) or "|" in text and any(s in word for s in self.special)):
            return None
        low = text.lower()
        if not (low.isalpha() or self.plain.fullmatch(low)) or not unicodedata.is_normalized("NFC", text):
            return None
        return [word] if text.isalpha() else [(x.lower() if x.isascii() else x).encode() for x in self.pieces.findall(text)]

    def _learn(self, pieces: set[bytes]) -> None:
        ascii_ = [x for x in pieces if x.isascii()]
        for library, known in ((self.simple, ascii_), (self.inner, list(pieces.difference(ascii_)))):
            for at in range(0, len(known), 4096):
                own = known[at : at + 4096]
                ids = np.array(library.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, np.uint16)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(own) and (not len(ids) or ends[-1] == len(ids)):
                    raw, cuts = ids.tobytes(), (2 * ends).tolist()
                    self.known.update(zip(own, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
                else:
                    self.known.update(zip(own, self._one_by_one(own), strict=True))

    def _coded(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words, two bytes each."""
        low = _bytes(pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words))
        out = list(map(self.known.get, low))
        new = np.fromiter((x is None for x in out), np.bool_, len(out))
        alpha = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)  # one piece each
        single, other = np.flatnonzero(new & alpha).tolist(), np.flatnonzero(new & ~alpha).tolist()
        split = list(map(self._split, _bytes(words.take(pa.array(other, pa.int64())))))
        pieces = {low[k] for k in single}
        pieces.update(x for xs in split if xs is not None for x in xs)
        pieces.difference_update(self.known)
        self._learn(pieces)
        ids = self.known
        for k in single:
            out[k] = ids[low[k]]
        whole = []
        for k, xs in zip(other, split, strict=True):
            if xs is None:
                whole.append(k)
            else:
                out[k] = ids[xs[0]] if len(xs) == 1 else b"".join([ids[x] for x in xs])
        if whole:
            for k, x in zip(whole, self._one_by_one(_bytes(words.take(pa.array(whole, pa.int64())))), strict=True):
                out[k] = x
        # Special tokens are told by their case: what is one in lower case is not kept.
        apart = {k for k in other if b"|" in low[k] and any(s in low[k] for s in self.lower)}
        alone = {low[k]: out[k] for k in other if k not in apart}
        self.known.update(alone)
        if len(self.known) > CACHE_PIECES:
            self.known = {low[k]: out[k] for k in range(min(len(low), CACHE_WORDS)) if len(low[k]) <= CACHE_BYTES and k not in apart}
        else:
            for x in [x for x in (*pieces, *alone) if len(x) > CACHE_BYTES]:
                self.known.pop(x, None)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with its end id, and how many each has."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        index = lists.flatten().dictionary_encode()
        coded = self._coded(index.dictionary)
        coded.append(np.array([END_ID], "<u2").tobytes())  # a last word, at the end of each text
        raw = np.frombuffer(b"".join(coded), "<u2")
        length = np.fromiter(map(len, coded), np.int64, len(coded)) >> 1
        first = np.cumsum(length) - length
        ends = np.cumsum(sizes + 1) - 1
        word = np.full(len(index) + len(texts), len(coded) - 1, np.int32)
        inner = np.ones(len(word), np.bool_)
        inner[ends] = False
        word[inner] = index.indices.to_numpy(zero_copy_only=False)
        length = length[word]
        stop = np.cumsum(length)
        n = int(stop[-1]) if len(stop) else 0
        kind = np.int32 if max(n, len(raw)) < 1 << 31 else np.int64
        place = np.repeat((first[word] - stop + length).astype(kind), length)
        place += np.arange(n, dtype=kind)
        return raw[place], np.diff(stop[ends], prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text with the end id, two bytes each."""
        ids, sizes = self.ids(pa.array(texts, pa.binary()).cast(pa.string()))
        raw, ends = ids.tobytes(), (2 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_OPEN: dict[str, _Tokenizer] = {}


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids, and ids of each (end id included)."""
    if path not in _OPEN:
        _OPEN[path] = _Tokenizer(path)
    for batch in batches:
        texts = batch.column("text")
        sums = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(sums):
            until = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            ids, sizes = _OPEN[path].ids(texts.slice(at, until - at))
            yield batch.column("doc_id").slice(at, until - at).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1])
            at = until
        pa.default_memory_pool().release_unused()


def write(docs: DataFrame, path: str) -> DataFrame:
    """Writes the record files and returns them as read: part, seq, start, n_ids, record."""
    import pyspark

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pyspark.TaskContext.get().partitionId()
        keys: list = []
        ids: list[np.ndarray] = []
        size = start = seq = 0

        def flush() -> pa.RecordBatch:
            known = np.fromiter((k is not None for k in keys), np.bool_, len(keys))
            index = pack([np.fromiter((k or 0 for k in keys), np.int64, len(keys)), known, np.fromiter(map(len, ids), np.int64, len(ids))])
            record = len(index).to_bytes(4, "little") + index + encode(np.concatenate(ids), BITS)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([record], pa.binary())], ["part", "seq", "start", "n_ids", "record"])

        for own, coded in _encoded(batches, path):
            for key, x in zip(own, coded, strict=True):
                if keys and size + len(x) > RECORD_IDS:
                    yield flush()
                    start, seq, size, keys, ids = start + size, seq + 1, 0, [], []
                keys.append(key)
                ids.append(x)
                size += len(x)
        if keys:
            yield flush()

    # Texts are dealt, not ids: finding the ranges reads the rows once more, which would tokenise them twice.
    first = F.col("doc_id").asc_nulls_first()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // FILE_BYTES)), first).sortWithinPartitions(first, F.col("text").asc_nulls_first())
    return write_table(dealt.mapInArrow(rows, "part int, seq int, start long, n_ids long, record binary"), "records")


def open_record(record: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids (None where null), ids of each, and all ids of a record."""
    n = int.from_bytes(record[:4], "little")
    keys, known, sizes = unpack(record[4 : 4 + n])
    keys = [k if ok else None for k, ok in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(known, np.bool_).tolist(), strict=True)]
    return keys, np.frombuffer(sizes, np.int64), decode(record[4 + n :])


def read(records: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from record files."""
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Twelve bytes a part (a file): broadcast while there are at most a million, else joined by shuffle.
    small = F.broadcast if parts.count() <= 1_000_000 else (lambda df: df)
    placed = records.join(small(parts.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("start")).alias("start"), "record")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, record in zip(batch.column("start").to_pylist(), batch.column("record"), strict=True):
                keys, sizes, ids = open_record(record.as_py())
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers as vocabularies

    return read(write(docs, vocabularies.path("word_bpe_49k.json")))
