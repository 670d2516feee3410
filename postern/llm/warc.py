"""WARC derivatives: each response becomes a metadata and a plain-text conversion record that refer to it.

`read_records` reads files (plain or gzip, a member a record), `converted` splits their response records into
HTTP head and payload, `derive` makes the two linked records of each, `write` files them as gzip members that
`read_records` reads back. Derived records keep the response's target URI, date and digest, name it in
WARC-Refers-To and carry its source headers; each has its own block digest. Record ids derive from what they
name, so a rerun task writes the same records.

A null payload is an empty one, a null URI an empty string; payloads that are not UTF-8 get replacement
characters. Repeated rows derive equal records each. A damaged record gives a row with `error` (the records
before it are read, and after it those that can be found). An empty table gives an empty result. Extra columns
of the input are not carried over. A payload is one row, however long; a file is read a record at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.llm.common import write_table

CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"
# Fixed values of the text conversion, in the order in which they apply: (pattern, replacement).
DROPPED = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>")
BREAKS = r"(?i)</?(p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|article|section|aside|nav|footer|header|main|body|html|form|blockquote|pre)\b[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
BLANKS, ENDS = r"[ \t\r\f]+", r" ?\n[ \n]*"


def html_text(html: Column) -> Column:
    """Visible text: a line a block, single blanks, entities resolved."""
    t = html
    for pattern in DROPPED:
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(F.regexp_replace(t, BREAKS, "\n"), TAG, "")
    for name, sign in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.regexp_replace(F.regexp_replace(t, BLANKS, " "), ENDS, "\n")
    return F.btrim(t, F.lit(" \n"))


def title(html: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " "), F.lit(" "))


def record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The pages as response records: page_id, record_id, target_uri, date, source_headers, source_digest, payload."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"))
    return pages.select("page_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), head.alias("source_headers"), digest(html).alias("source_digest"), html.alias("payload"))


def converted(records: DataFrame) -> DataFrame:
    """The response records among `read_records` rows as `derive` takes them; page_id is null.

    The block is split at the first empty line: names of header fields in lower case, a repeated one's values joined by
    a comma. The payload digest is the record's own where it has one.
    """
    found = records.where("error is null").where(F.lower(F.try_element_at("headers", F.lit("warc-type"))) == "response")
    # Latin-1 keeps a byte a character, so that the place of the empty line is one of bytes.
    found = found.withColumn("at", F.locate("\r\n\r\n", F.decode("block", "ISO-8859-1")))
    head = F.decode(F.substring("block", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), "ISO-8859-1")
    body = F.when(F.col("at") > 0, F.substring("block", F.col("at") + 4, F.length("block"))).otherwise(F.col("block"))
    lines = F.filter(F.split(head, "\r\n"), lambda x, k: (k > 0) & F.contains(x, F.lit(":")))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.btrim(F.substring_index(x, ":", 1))).alias("name"), F.btrim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))).alias("value")))
    names = F.array_sort(F.array_distinct(F.transform(fields, lambda x: x["name"])))
    joined = F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(fields, lambda x: x["name"] == n), lambda x: x["value"]), ", ")))
    own = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    raw = found.select("headers", joined.alias("source_headers"), body.alias("raw"))
    told = F.when(own("warc-payload-digest") != "", own("warc-payload-digest")).otherwise(digest(F.col("raw")))
    return raw.select(F.lit(None).cast("long").alias("page_id"), own("warc-record-id").alias("record_id"), own("warc-target-uri").alias("target_uri"), own("warc-date").alias("date"), "source_headers", told.alias("source_digest"), F.make_valid_utf8(F.col("raw").cast("string")).alias("payload"))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: page_id, warc_type, record_id, refers_to, target_uri, date, source_headers, source_type, source_digest, source_length, content_type, block, block_digest, content_length.

    The metadata block holds the title, the number of links, every source header and the payload's digest.
    """
    payload = F.col("payload")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("source_headers")), lambda e: F.concat(F.lit("source-"), e["key"], F.lit(": "), e["value"], F.lit(CRLF))), "")
    fields = F.concat(F.lit("title: "), title(payload), F.lit(CRLF + "outlinks: "), (F.size(F.split(F.lower(payload), "<a href=")) - 1).cast("string"), F.lit(CRLF), told, F.lit("source-payload-digest: "), F.col("source_digest"), F.lit(CRLF))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), html_text(payload).alias("block")),
    )
    kept = ["page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_headers", F.coalesce(F.try_element_at("source_headers", F.lit("content-type")), F.lit("")).alias("source_type"), "source_digest", F.octet_length("payload").cast("long").alias("source_length")]
    made = source.select(*kept, F.inline(kinds))
    return made.select("page_id", "warc_type", record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "source_headers", "source_type", "source_digest", "source_length", "content_type", "block", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"))


def serialised(records: DataFrame) -> DataFrame:
    """page_id, warc_type, record: the bytes of each derived record as it stands in a file."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Refers-To-Payload-Digest", "source_digest"), ("X-Source-Content-Type", "source_type"), ("X-Source-Content-Length", "source_length"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    head = F.concat(F.lit("WARC/1.1" + CRLF), *(line(name, F.col(c).cast("string")) for name, c in named))
    return records.select("page_id", "warc_type", F.concat(head, F.lit(CRLF), "block", F.lit(CRLF * 2)).cast("binary").alias("record"))


def write(records: DataFrame, path: str) -> DataFrame:
    """Files the derived records under `path` (a URI that pyarrow opens, seen by all executors), a gzip member each; one file a task: file, n_records.

    A task writes under a name of its attempt and then takes its final name, so a lost one's file is replaced.
    """
    import pyspark

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task = pyspark.TaskContext.get()
        fs, folder = FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        name, n = f"{folder}/part-{task.partitionId():05d}.warc.gz", 0
        with fs.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for record in batch.column("record"):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(z.compress(record.as_py()) + z.flush())
                    n += 1
        fs.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], ["file", "n_records"])

    return write_table(serialised(records).select("record").mapInArrow(rows, "file string, n_records long"), "warc-files")


def members(data: bytes) -> Iterator[bytes]:
    """The file's content in pieces: a gzip member each, or all of a plain file. A damaged member ends it with ValueError."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while len(rest):
        z = zlib.decompressobj(31)
        try:
            piece = z.decompress(rest)
        except zlib.error as e:
            raise ValueError(f"damaged gzip member: {e}") from None
        yield piece
        if not z.eof:
            raise ValueError("truncated gzip member")
        rest = memoryview(z.unused_data.lstrip(b"\0"))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and error of each record of a file's bytes."""
    pieces = members(data)
    while True:
        try:
            piece = next(pieces)
        except StopIteration:
            return
        except ValueError as e:
            yield {}, b"", str(e)
            return
        yield from _records(piece)


_START = re.compile(rb"WARC/[0-9.]+\r\n")


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    at = 0
    while found := _START.search(data, at):
        start = found.start()
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            yield {}, b"", "truncated header"
            return
        lines = data[start:end].decode("utf-8", "replace").split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        told = head.get("content-length", "0")
        if not (told.isascii() and told.isdigit()):
            yield head, b"", f"bad Content-Length: {told[:40]}"
            at = end + 4
            continue
        at = end + 4 + int(told)
        block = data[end + 4 : at]
        yield head, block, None if len(block) == int(told) else f"truncated block: {len(block)} of {told} bytes"


#: Bytes of blocks that a reading task holds before it passes them on.
BATCH_BYTES = 8 << 20


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "headers", "block", "error"])


def read_records(files: DataFrame) -> DataFrame:
    """path, headers, block, error of each record; files: path, content (as `binaryFile` reads them). A null content has no records."""

    kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for head, block, error in parse(content.as_py() or b""):
                    held.append((path, list(head.items()), block, error))
                    size += len(block) + 1000
                    if size > BATCH_BYTES:
                        yield _batch(held, kinds)
                        held, size = [], 0
        yield _batch(held, kinds)

    return files.select("path", "content").mapInArrow(rows, "path string, headers map<string,string>, block binary, error string")


def op8(pages: DataFrame) -> DataFrame:
    return derive(responses(pages)).drop("block", "source_headers")


def _sql_text(html: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    t = html
    for pattern in DROPPED:
        t = f"regexp_replace({t}, {quote(pattern)}, '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, {quote(BREAKS)}, chr(10), 'g'), {quote(TAG)}, '', 'g')"
    for name, sign in ENTITIES:
        t = f"replace({t}, {quote(name)}, {quote(sign)})"
    return f"trim(regexp_replace(regexp_replace({t}, {quote(BLANKS)}, ' ', 'g'), {quote(ENDS)}, chr(10), 'g'), ' ' || chr(10))"


def _sql_id(parts: str) -> str:
    h = f"sha256({parts})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


OP8_SQL = rf"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {_sql_id("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to FROM pages),
b AS (SELECT page_id, refers_to, target_uri, payload, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
  'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title\b[^>]*>(.*?)</title', 1), '[ \t\r\n\f]+', ' ', 'g'), ' ') || chr(13) || chr(10) || 'outlinks: ' || CAST(len(string_split(lower(payload), '<a href=')) - 1 AS VARCHAR) || chr(13) || chr(10)
  || 'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-payload-digest: sha256:' || sha256(payload) || chr(13) || chr(10) AS block FROM r
  UNION ALL SELECT page_id, refers_to, target_uri, payload, 'conversion', 'text/plain; charset=utf-8', {_sql_text("payload")} FROM r)
SELECT page_id, warc_type, {_sql_id("warc_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS date, 'text/html; charset=utf-8' AS source_type, 'sha256:' || sha256(payload) AS source_digest,
  CAST(strlen(payload) AS BIGINT) AS source_length, content_type, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM b
"""
