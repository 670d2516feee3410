"""Where messages come from: files, directories, rows in memory, uploads; and the DNS snapshot and settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions.text import source_label

#: File endings that a directory scan takes, and those that an upload may have.
SCANNED, UPLOADABLE = (".eml", ".msg", ".txt"), (".eml", ".txt", ".msg", "")
SCHEMA = "source string, content binary, ord long"


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Files and directories (recursively, by ending), in argument order and sorted within each directory.

    A path that does not exist is left out, a file named outright may have any ending, and what two
    arguments both cover comes twice. `ord` ascends with the argument and the path in it; it need not be dense.
    """
    out = None
    for k, path in enumerate(paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        if fs.getFileStatus(p).isDirectory():
            found = found.where(F.lower("path").rlike(r"\.(eml|msg|txt)$"))
        part = found.select(F.col("path").alias("source"), "content", F.lit(k).alias("argument"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    # Places come from the paths alone, in ranges; contents are not sorted.
    places = out.select("argument", "source").distinct().orderBy("argument", "source").withColumn("ord", F.monotonically_increasing_id())
    return out.join(places, ["argument", "source"]).select("source", "content", "ord")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One message file; FileNotFoundError where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content", F.lit(0).cast("long").alias("ord"))


def in_memory(spark: SparkSession, messages: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(s, bytearray(b), k) for k, (s, b) in enumerate(messages)], SCHEMA)


def uploads(spark: SparkSession, files: list[tuple[str, bytes]], pasted: str = "", max_files: int = 25, any_ending: bool = False) -> DataFrame:
    """Uploaded files and pasted text (last) as messages with clean labels.

    Empty files are skipped; too many, or an ending that is not allowed, raise ValueError.
    """
    rows = []
    for name, data in files:
        ending = os.path.splitext(name.lower())[1]
        if not any_ending and ending not in UPLOADABLE:
            raise ValueError(f"{name}: only {', '.join(filter(None, UPLOADABLE))} files")
        if data:
            rows.append((name, data))
    if pasted.strip():
        rows.append(("pasted-message.eml", pasted.encode("utf-8", "replace")))
    if len(rows) > max_files:
        raise ValueError(f"at most {max_files} files at once")
    return in_memory(spark, rows).withColumn("source", source_label(F.col("source")))


def api_body(spark: SparkSession, body: bytes, content_type: str = "", files: list[tuple[str, bytes]] | None = None) -> DataFrame:
    """The three shapes of an API request: files, {"raw": ...} or the bare message."""
    if files:
        return uploads(spark, files, any_ending=True)
    if content_type.split(";")[0].strip() == "application/json":
        raw = json.loads(body or b"{}").get("raw")
        if not isinstance(raw, str) or not raw:
            raise ValueError("the JSON body needs a string named raw")
        return in_memory(spark, [("api-message.eml", raw.encode("utf-8", "replace"))])
    if not body:
        raise ValueError("no message")
    return in_memory(spark, [("api-message.eml", body)])


def dns_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """TXT records (name, record) kept in Parquet; nothing is looked up live."""
    return spark.read.schema("name string, record string").parquet(path)


@dataclass(frozen=True)
class Settings:
    """Limits, from the environment; a value that does not parse keeps its default."""

    max_bytes: int = 4 << 20
    max_files: int = 25
    ttl_seconds: int = 1800
    max_entries: int = 200
    rate_limit: int = 60
    rate_window: int = 60
    online: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None, prefix: str = "POSTERN_") -> Settings:
        env = dict(os.environ if env is None else env)
        found = {}
        for name, default in vars(Settings()).items():
            raw = env.get(prefix + name.upper(), "").strip()
            if isinstance(default, bool):
                found[name] = raw.lower() in ("1", "true", "yes", "on") if raw else default
            else:
                found[name] = int(raw) if raw.lstrip("-").isdigit() else default
        return Settings(**found)
