"""Messages as a stream: the same parse, rules and scoring, row by row, so append mode and no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.triage import triage

FILES = "path string, modificationTime timestamp, length long, content binary"


def triage_stream(spark: SparkSession, folder: str, org_domains: tuple[str, ...] = (), files_per_batch: int = 1000) -> DataFrame:
    """Scored reports of every message file that arrives in `folder`, with `arrived`."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    raw = files.where(F.lower("path").rlike(r"\.(eml|msg|txt)$")).select(F.col("path").alias("source"), "content", F.col("modificationTime").cast("long").alias("ord"))
    return triage(raw, org_domains)


def campaigns(reports: DataFrame, arrived: str = "arrived", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Verdicts per sender domain and window of arrival; late rows count until the watermark passes."""
    return reports.withWatermark(arrived, late).groupBy(F.window(arrived, window), "from_domain", "verdict").agg(F.count("*").alias("messages"), F.max("score").alias("worst"))
