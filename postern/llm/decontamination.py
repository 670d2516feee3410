"""Benchmark decontamination by a broadcast hash set of normalised test n-grams (DataFrame functions only).

Each document's 13-word windows are hashed in place and looked up in the set of benchmark window
hashes; hits carry their words, are verified against the benchmark's windows, and spans or whole
documents are removed. No row leaves its task before it has a hit, and only hits are shuffled, without
their texts. The set is broadcast in slices of SLICE_WINDOWS hashes at every size, each slice a pass.

Nulls and empty texts have no words and are clean; a very long text is one row of more windows. Rows with
a null doc_id are judged as any other. Repeated rows get the same verdict each. An empty benchmark leaves
every document clean, an empty table gives an empty result. Extra columns, whatever their names, pass
through `decontaminate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: What stands between words, in any text and in one whose A-Z are lowered.
ANY_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes in a broadcast slice of the set (about 60 bytes each in Spark's table of longs).
SLICE_WINDOWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, gap: str = GAP) -> Column:
    """Splitting at the gaps costs a tenth of matching the words; the empty ends go."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else; plain ASCII, where full lower-casing is the same and faster, goes that way."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words), gram (text), gram_hash: the distinct windows of each item; a shorter item is one window."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    at = w.select("item_id", "w", F.least(F.lit(window), F.size("w")).alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))).alias("at"))
    words_here = F.slice("w", F.col("at"), F.col("n"))
    return at.select("item_id", "n", F.concat_ws(" ", words_here).alias("gram"), F.xxhash64(words_here).alias("gram_hash")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, item_id, at, n: verified occurrences of benchmark windows."""
    grams = benchmark_windows(benchmark, window)
    count, lengths = grams.agg(F.count_distinct("gram_hash"), F.collect_set("n")).first()
    if not count:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id string, at int, n int")
    # At most `window` different lengths.
    spots = docs.select(*_key(), words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") >= min(lengths))
    spots = spots.select("doc_id", "text_hash", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))
    spots = spots.select("*", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("n")) if len(lengths) > 1 else spots.withColumn("n", F.lit(lengths[0]))
    spots = spots.where(F.col("at") + F.col("n") <= F.size("w") + 1)
    hashed = spots.select("*", F.xxhash64(F.slice("w", F.col("at"), F.col("n"))).alias("gram_hash"))
    near = None
    slices = -(-count // SLICE_WINDOWS)
    for k in range(slices):
        known = grams.select("gram_hash").where(F.pmod("gram_hash", F.lit(slices)) == k).distinct()
        part = hashed.join(F.broadcast(known), "gram_hash", "left_semi")
        near = part if near is None else near.unionByName(part)
    near = near.select("doc_id", "text_hash", "at", "n", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("n"))).alias("gram"))
    return near.join(grams.drop("gram_hash"), ["gram", "n"]).select("doc_id", "text_hash", "item_id", "at", "n")


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def _covered(ranges: Column) -> Column:
    """Words covered by an ascending array of (at, end) structs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"] - 1, s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))
    return F.aggregate(ranges, zero, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row a document: doc_id, text_hash, n_words, n_hit, items (sorted strings), ranges (hit word ranges), contaminated."""
    found = hits(docs, benchmark, window).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n") - 1).alias("end")))).alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "ranges", "items")
    all_docs = docs.select(*_key(), F.size(words(F.col("text"), ANY_GAP)).cast("long").alias("n_words"))
    joined = all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce(_covered(F.col("ranges")), F.lit(0).cast("long"))
    out = joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "ranges")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or (remove="spans") with the hit words of every document cut out of its text."""
    found = report(docs, benchmark, window)
    # The document's columns travel as one struct, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_hash"))
    if remove == "documents":
        bad = found.where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
        return rows.join(bad, same, "left_anti").select("row.*")
    spans = found.where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "ranges").dropDuplicates(["hit_id", "hit_hash"])
    joined = rows.join(spans, same, "left")
    pieces = F.regexp_extract_all("row.text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|" + ANY_GAP), 0)
    is_word = lambda p: p.rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    marked = F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), lambda s, p: F.struct((s["n"] + is_word(p).cast("int")).alias("n"), F.when(is_word(p) & F.exists("ranges", lambda r: (r["at"] <= s["n"] + 1) & (s["n"] + 1 <= r["end"])), s["out"]).otherwise(F.concat(s["out"], p)).alias("out")), lambda s: s["out"])
    text = F.when(F.col("ranges").isNotNull(), marked).otherwise(F.col("row.text"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL_LOWER = f"translate(text, '{UPPER}', '{LOWER}')"
OP7_SQL = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_sql_words(SQL_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS gram
         FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, text, {_sql_words(f"coalesce({SQL_LOWER}, '')")} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
hit AS (SELECT g.doc_id, g.i, g.n, wins.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM spots) g JOIN wins ON g.gram = wins.gram AND g.n = wins.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
