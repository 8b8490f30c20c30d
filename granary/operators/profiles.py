"""Length profiles, histograms, loss and accuracy by group, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import half_even, ratio


def length_summary(rows: DataFrame, length: str, limit: int, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean, population deviation, linear percentiles (halves to even), the excess over a limit."""
    c = F.col(length)
    p = lambda q: half_even(F.percentile(c, F.lit(q))).cast("long")
    return rows.groupBy(*(by or [])).agg(
        F.count(c).alias("n"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("deviation"),
        p(0.5).alias("p50"),
        p(0.9).alias("p90"),
        p(0.95).alias("p95"),
        p(0.99).alias("p99"),
        F.count_if(c > limit).alias("n_over"),
        F.coalesce(F.max(F.greatest(c - limit, F.lit(0))), F.lit(0)).alias("worst_excess"),
    )


def upper_median(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Per group the element n // 2 of the sorted values: counts per value, then their running sum."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    part = Window.partitionBy(*(by or [F.lit(0)]))
    upto = F.sum("k").over(part.orderBy(value))
    n = F.sum("k").over(part)
    marked = counts.withColumn("upto", upto).withColumn("n", n)
    return marked.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("k") <= F.floor(F.col("n") / 2))).select(*by, F.col(value).alias("median"))


def longest(rows: DataFrame, length: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(length), key).limit(k)


def category_index(rows: DataFrame, record: str, category: str) -> DataFrame:
    """category, n_objects, records: histogram and inverted index."""
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n_objects"), F.array_sort(F.collect_set(record)).alias("records"))


def nested_counts(rows: DataFrame, category: str, key: str, value: str) -> DataFrame:
    """category, attributes: a map from attribute to a map from value to count."""
    n = rows.groupBy(category, key, value).agg(F.count(F.lit(1)).alias("n"))
    inner = n.groupBy(category, key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("v"))
    return inner.groupBy(category).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.to_json("v").alias("v"))))).alias("attributes"))


def value_counts(rows: DataFrame, column: str, separator: str | None = None) -> DataFrame:
    """How often each value occurs, or each part of it between separators; blanks are left out."""
    values = F.explode(F.split(column, separator)) if separator else F.col(column)
    parts = rows.select(values.alias("raw")).select(F.trim("raw").alias("value")).where("value <> ''")
    return parts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def ratio_bucket(failed, passed):
    """Bucket of failed over passed: none for a zero denominator, else under 2, 3, 5 or more."""
    r = failed / passed
    return F.when(passed == 0, "none").when(r < 2, "<2").when(r < 3, "<3").when(r < 5, "<5").otherwise(">=5")


def masked_means(tokens: DataFrame, by: list[str], ignore: int = -100) -> DataFrame:
    """Mean loss and accuracy over token rows whose label is not the ignored one."""
    kept = tokens.where(F.col("label_id") != ignore)
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), ratio(F.count_if(F.col("pred_id") == F.col("label_id")), F.count(F.lit(1))).alias("accuracy"))


def run_summary(log: DataFrame) -> DataFrame:
    """Per decision the rows, the largest reduction and the value of the last iteration (later rows win ties)."""
    last = F.max_by("score", F.struct("iteration", "line_no"))
    return log.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.max("rer").alias("max_rer"), last.alias("last_score"))


def objects_estimate(facts: DataFrame, doc: str = "doc") -> DataFrame:
    """Objects per document: per category the largest sum of an attribute's counts, one at least."""
    per = facts.groupBy(doc, "f1", "f2").agg(F.sum("n").alias("n")).groupBy(doc, "f1").agg(F.greatest(F.lit(1), F.max("n")).alias("n"))
    return per.groupBy(doc).agg(F.sum("n").alias("n_objects"))
