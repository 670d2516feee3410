"""From findings to a score and a verdict: within a row (arrays) and over a findings table (one shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postern import intel
from postern.catalog import INDICATORS, catalog
from postern.functions.text import lit_map


def verdict_of(score: Column) -> Column:
    out = F.lit(intel.THRESHOLDS[-1][1])
    for least, name in reversed(intel.THRESHOLDS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    return F.array_position(F.array(*(F.lit(v) for v in intel.VERDICTS)), verdict).cast("int") - 1


def bonus_of(categories: Column) -> Column:
    table = F.array(*(F.lit(b) for b in intel.CORROBORATION))
    return F.coalesce(F.try_element_at(table, F.size(categories) + 1), F.lit(intel.CORROBORATION[-1]))


def reduced(weight: Column) -> Column:
    return F.bround(weight * F.lit(intel.SOFT_SHARE), 0).cast("int")


def _judged(raw: Column, discount: Column, categories: Column, clean: Column, count: Column, critical: Column) -> tuple[Column, Column, Column]:
    score = F.least(F.lit(100), raw + bonus_of(categories)).cast("int")
    plain = verdict_of(score)
    floored = critical & (verdict_rank(plain) < 2)
    verdict = F.when(floored, intel.VERDICTS[2]).otherwise(plain)
    parts = F.struct(raw.cast("int").alias("raw_weight"), discount.cast("int").alias("discount"), bonus_of(categories).alias("corroboration_bonus"), categories.alias("categories"), clean.alias("authentication_clean"), count.cast("int").alias("finding_count"), floored.alias("critical_floor_applied"))
    return score, verdict, parts


def score_rows(found: DataFrame) -> DataFrame:
    """Adds score, verdict, breakdown and attack_techniques to rows with a `findings` array; no shuffle."""
    info = lit_map({i: {"category": c, "severity": s, "weight": w, "attack": list(a)} for i, _, c, s, w, _, a in INDICATORS})
    known = F.transform("findings", lambda f: F.struct(f["indicator_id"].alias("id"), F.element_at(info, f["indicator_id"]).alias("i")))
    found = found.withColumn("_known", known)
    every = F.col("_known")
    clean = ~F.exists(every, lambda f: (f["i"]["category"] == "authentication") & ~f["id"].isin(*intel.ADVISORY))
    found = found.withColumn("_clean", clean)
    soft = lambda f: F.col("_clean") & (f["i"]["category"] == intel.SOFT_CATEGORY)
    raw = F.aggregate(every, F.lit(0), lambda s, f: s + F.when(soft(f), reduced(f["i"]["weight"])).otherwise(f["i"]["weight"]))
    whole = F.aggregate(every, F.lit(0), lambda s, f: s + f["i"]["weight"])
    categories = F.array_sort(F.array_distinct(F.transform(every, lambda f: f["i"]["category"])))
    critical = F.exists(every, lambda f: f["i"]["severity"] == "critical")
    score, verdict, parts = _judged(raw, whole - raw, categories, F.col("_clean"), F.size("findings"), critical)
    attack = F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda f: f["i"]["attack"]))))
    return found.withColumns({"score": score, "verdict": verdict, "breakdown": parts, "attack_techniques": attack}).drop("_known", "_clean")


def score_table(messages: DataFrame, findings: DataFrame) -> DataFrame:
    """The same from tables: messages (msg_id) and findings (msg_id, indicator_id); messages without findings score 0.

    The catalogue is 58 rows and always broadcast. Whether a message authenticated cleanly decides what its
    content weighs, so both sums are taken in the one aggregation and chosen from afterwards.
    """
    joined = findings.join(F.broadcast(catalog(messages.sparkSession)), findings["indicator_id"] == F.col("id"))
    soft = F.col("category") == intel.SOFT_CATEGORY
    sums = joined.groupBy("msg_id").agg(
        F.sum("weight").alias("whole"), F.sum(F.when(soft, reduced(F.col("weight"))).otherwise(F.col("weight"))).alias("soft"), F.count("*").alias("n"),
        F.bool_or((F.col("category") == "authentication") & ~F.col("id").isin(*intel.ADVISORY)).alias("bad"), F.bool_or(F.col("severity") == "critical").alias("critical"),
        F.sort_array(F.collect_set("category")).alias("categories"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("attack")))).alias("attack_techniques"),
    )
    empty = F.array().cast("array<string>")
    rows = messages.join(sums, "msg_id", "left")
    clean = ~F.coalesce("bad", F.lit(False))
    whole = F.coalesce("whole", F.lit(0))
    raw = F.when(clean, F.coalesce("soft", F.lit(0))).otherwise(whole)
    score, verdict, parts = _judged(raw, whole - raw, F.coalesce("categories", empty), clean, F.coalesce("n", F.lit(0)), F.coalesce("critical", F.lit(False)))
    return rows.select(*messages.columns, score.alias("score"), verdict.alias("verdict"), parts.alias("breakdown"), F.coalesce("attack_techniques", empty).alias("attack_techniques"))


def ranked(reports: DataFrame) -> DataFrame:
    """Worst first; equal scores by source."""
    return reports.orderBy(F.desc("score"), "source")


def grouped(reports: DataFrame) -> DataFrame:
    """source, category, findings: a message's findings by category, in the order in which categories first appear."""
    info = lit_map({i: c for i, _, c, _, _, _, _ in INDICATORS})
    flat = reports.select("source", F.posexplode("findings").alias("pos", "f")).withColumn("category", F.element_at(info, F.col("f.indicator_id")))
    return flat.groupBy("source", "category").agg(F.min("pos").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("findings")).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("first"))).drop("first")


#: What a run may fail on: the verdicts by their names in lower case, or nothing.
FAIL_ON = {v.lower().replace(" ", "-"): k for k, v in enumerate(intel.VERDICTS)} | {"never": 0}


def exit_code(reports: DataFrame, fail_on: str = "suspicious") -> int:
    """0, or 1 where the worst verdict reaches `fail_on` (which never happens for benign and never); 3 where nothing was parsed."""
    worst = reports.agg(F.max(verdict_rank(F.col("verdict"))).alias("r")).first()["r"]
    if worst is None:
        return 3
    least = FAIL_ON[fail_on]
    return int(0 < least <= worst)
