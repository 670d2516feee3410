"""Shared plumbing: table access, shared-folder tables and packed text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Raw text bytes that one packed chunk holds before it is closed. A longer single text makes its own chunk.
CHUNK_BYTES = 8 << 20

CHUNK_SCHEMA = "chunk long, n_bytes long, blob binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and one machine runs everything (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="postern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, so a lost executor costs one stage.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postern-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    return spark.read.schema(df.schema).parquet(path)


def pack(arrays: list[np.ndarray | bytes]) -> bytes:
    """Buffers, one after the other with their lengths, compressed."""
    parts = [x.tobytes() if isinstance(x, np.ndarray) else x for x in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], np.int64))
    starts = [8 * (n + 1), *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(docs: DataFrame) -> DataFrame:
    """Packs (doc_id, text) into compressed chunks of about CHUNK_BYTES and writes them as a table.

    Later passes name a chunk by its id, so the side results they exchange are a few packed rows a
    chunk and not a row for each token. A null doc_id is kept (as a flag), null text is empty.
    """
    import pyspark

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pyspark.TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            known = np.fromiter((x is not None for x in ids), np.bool_, len(ids))
            keys = np.fromiter((x or 0 for x in ids), np.int64, len(ids))
            blob = pack([keys, known, lengths, b"".join(texts)])
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "n_bytes", "blob"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                if texts and size + len(text) > CHUNK_BYTES:
                    yield flush()
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return write_table(docs.select("doc_id", "text").mapInArrow(rows, CHUNK_SCHEMA), "chunks")


def open_chunk(blob: bytes) -> tuple[list, list[bytes]]:
    """doc_ids (None where null) and texts of a chunk."""
    keys, known, lengths, data = unpack(blob)
    ends = np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    raw = bytes(data)
    texts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    ids = [k if ok else None for k, ok in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(known, np.bool_).tolist(), strict=True)]
    return ids, texts


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg({"n_bytes": "sum"}).first()[0] or 0


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
