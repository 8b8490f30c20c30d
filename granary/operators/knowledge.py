"""Keyed state: hypotheses with support, guidance with hit counts, and edits of it.

State is a table; an edit gives a new table, to be written as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import ratio
from granary.functions.text import natural_key, signature

PROTECTED = "G0"


def support(proposals: DataFrame, min_cycles: int = 2, min_keys: int = 2) -> DataFrame:
    """Per signature its text, distinct cycles and evidence keys (first seen first), and whether both reach their thresholds.

    proposals: text, cycle, evidence (array), ordinal.
    """
    signed = proposals.withColumn("signature", signature(F.col("text")))
    base = signed.groupBy("signature").agg(F.min_by("text", "ordinal").alias("text"), F.count_distinct("cycle").alias("n_cycles"))
    seen = signed.select("signature", "ordinal", F.posexplode("evidence").alias("place", "key")).groupBy("signature", "key").agg(F.min(F.struct("ordinal", "place")).alias("first"))
    keys = seen.groupBy("signature").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("evidence"))
    joined = base.join(keys, "signature", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    ok = (F.col("n_cycles") >= min_cycles) & (F.size("evidence") >= min_keys)
    return joined.withColumn("eligible", ok)


def confidence(hit, miss):
    return ratio(hit.cast("double"), hit + miss + 1e-5)


def tally(guidance: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Guidance (key, text, hit, miss) with outcomes (key, hit boolean) counted in."""
    n = outcomes.groupBy("key").agg(F.count_if("hit").alias("h"), F.count_if(~F.col("hit")).alias("m"))
    out = guidance.join(n, "key", "left").withColumn("hit", F.col("hit") + F.coalesce("h", F.lit(0))).withColumn("miss", F.col("miss") + F.coalesce("m", F.lit(0)))
    return out.withColumn("confidence", confidence(F.col("hit"), F.col("miss"))).drop("h", "m")


def upsert(guidance: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (key or null, text, ordinal) in: an equal text keeps its key, else the given key, else the next free G number."""
    norm = lambda c: signature(F.col(c))
    known = guidance.select(F.col("key").alias("same_key"), norm("text").alias("norm")).groupBy("norm").agg(F.min("same_key").alias("same_key"))
    fresh = edits.withColumn("norm", norm("text")).groupBy("norm").agg(F.min_by(F.struct("key", "text", "ordinal"), "ordinal").alias("e")).select("norm", "e.*")
    placed = fresh.join(known, "norm", "left").withColumn("at", F.coalesce("same_key", "key"))
    top = guidance.agg(F.coalesce(F.max(F.regexp_extract("key", r"^G([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("top"))
    new = placed.where(F.col("at").isNull()).crossJoin(F.broadcast(top))
    number = F.col("top") + F.row_number().over(Window.orderBy("ordinal", "norm"))
    new = new.withColumn("at", F.concat(F.lit("G"), number.cast("string"))).drop("top")
    texts = placed.where(F.col("at").isNotNull()).unionByName(new).groupBy("at").agg(F.max_by("text", "ordinal").alias("new_text"))
    both = guidance.join(texts, guidance["key"] == texts["at"], "full")
    added = F.col("new_text").isNotNull().cast("int")
    hit = F.coalesce("hit", F.lit(0)) + added
    miss = F.coalesce("miss", F.lit(0))
    return both.select(F.coalesce("key", "at").alias("key"), F.coalesce("new_text", "text").alias("text"), hit.alias("hit"), miss.alias("miss"), confidence(hit, miss).alias("confidence"))


def update(guidance: DataFrame, edits: DataFrame) -> DataFrame:
    """New texts for keys that exist; others are skipped."""
    texts = edits.groupBy("key").agg(F.max_by("text", "ordinal").alias("new_text"))
    return guidance.join(texts, "key", "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def remove(guidance: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the given keys; the protected one stays."""
    return guidance.join(keys.where(F.col("key") != PROTECTED).select("key").distinct(), "key", "left_anti")


def merge(guidance: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (source, target) folded: hits and misses add up in the target, sources go and are listed."""
    good = merges.where((F.col("source") != F.col("target")) & (F.col("source") != PROTECTED))
    folded = good.join(guidance.select(F.col("key").alias("source"), F.col("hit").alias("h"), F.col("miss").alias("m")), "source")
    sums = folded.groupBy("target").agg(F.sum("h").alias("h"), F.sum("m").alias("m"), F.array_sort(F.collect_set("source")).alias("merged_from"))
    left = guidance.join(good.select(F.col("source").alias("key")).distinct(), "key", "left_anti")
    out = left.join(sums, left["key"] == sums["target"], "left")
    hit, miss = F.col("hit") + F.coalesce("h", F.lit(0)), F.col("miss") + F.coalesce("m", F.lit(0))
    merged = F.coalesce("merged_from", F.array().cast("array<string>"))
    return out.select("key", "text", hit.alias("hit"), miss.alias("miss"), confidence(hit, miss).alias("confidence"), merged.alias("merged_from"))


def cleanup(guidance: DataFrame, least: float = 0.35, misses: int = 3, scaffold: str = "S") -> DataFrame:
    """Without weak rows (low confidence and several misses); protected and scaffold keys stay, and so do all if all were weak."""
    safe = (F.col("key") == PROTECTED) | F.startswith("key", F.lit(scaffold))
    weak = ~safe & (F.col("confidence") < least) & (F.col("miss") >= misses)
    left = guidance.agg(F.count_if(~weak).alias("left"))
    return guidance.crossJoin(F.broadcast(left)).where(~weak | (F.col("left") == 0)).drop("left")


def ablation_order(guidance: DataFrame, k: int) -> DataFrame:
    return guidance.orderBy("confidence", natural_key(F.col("key")), "key").limit(k)


def rejected_ids(candidates: DataFrame) -> DataFrame:
    """Ids of rejected candidates, plain and with the prefix upsert:."""
    gone = candidates.where(F.startswith("decision", F.lit("rejected")))
    return gone.select(F.explode(F.array("id", F.concat(F.lit("upsert:"), F.col("id")))).alias("id")).distinct()
