"""Joins of tickets, reasons, images and shards. Catalyst picks broadcast or shuffle by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_sets(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per key the sorted distinct values."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(out))


def attach_reasons(tickets: DataFrame, reasons: DataFrame, keys: list[str], value: str, out: str = "reasons") -> DataFrame:
    """Tickets with the sorted distinct reasons of their keys; null where there are none."""
    return tickets.join(sorted_sets(reasons, keys, value, out), keys, "left")


def exclude(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_anti")


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_semi")


def split_by_presence(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """All rows, with ``present``: whether their key is among ``keys``. One join for both parts."""
    marks = keys.select(*on).distinct().withColumn("present", F.lit(True))
    return rows.join(marks, on, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def pass_fail_pairs(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with exactly one pass and one fail row: group, pass_row, fail_row (structs).

    One aggregation instead of a self join.
    """
    row = F.struct(*rows.columns)
    both = rows.groupBy(group).agg(
        F.count_if(F.col(label) == "pass").alias("n_pass"),
        F.count_if(F.col(label) == "fail").alias("n_fail"),
        F.max(F.when(F.col(label) == "pass", row)).alias("pass_row"),
        F.max(F.when(F.col(label) == "fail", row)).alias("fail_row"),
    )
    return both.where((F.col("n_pass") == 1) & (F.col("n_fail") == 1)).select(group, "pass_row", "fail_row")


def append_missing(base: str, extra: str):
    """The first array with the second one's new items behind, in order."""
    return F.concat(F.col(base), F.array_distinct(F.array_except(F.col(extra), F.col(base))))


def renumbered(items: str, prefix: str = "image_"):
    """A map prefix1, prefix2, … to the items in order."""
    keys = F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    return F.when(F.size(items) == 0, F.create_map().cast("map<string,string>")).otherwise(F.map_from_arrays(keys, F.col(items)))


def annotations_with_names(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their image and category; ``known`` is false where the category is missing."""
    named = annotations.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    joined = named.join(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), "image_id")
    return joined.withColumn("known", F.col("name").isNotNull())


def fact_overlap(left: DataFrame, right: DataFrame, key: str, fact: list[str], count: str = "n") -> DataFrame:
    """Per key the size of both multisets of facts and of their intersection.

    A tagged union and two aggregations: nothing is joined, so frequent facts are no hot keys.
    """
    tagged = left.select(key, *fact, F.col(count).alias("l"), F.lit(0).cast("long").alias("r")).unionByName(
        right.select(key, *fact, F.lit(0).cast("long").alias("l"), F.col(count).alias("r"))
    )
    facts = tagged.groupBy(key, *fact).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return facts.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.least("l", "r")).alias("n_both"))


def complete_groups(expected: DataFrame, shards: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """Groups of which every expected index came once with a non-empty value, as ordered arrays; others are told apart.

    expected: group and n. A group with a missing, duplicate, unexpected or empty part has ``ok`` false.
    """
    seen = shards.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(index).alias("distinct"),
        F.min(index).alias("low"),
        F.max(index).alias("high"),
        F.count_if(F.coalesce(F.trim(value) == "", F.lit(True))).alias("empty"),
        F.sort_array(F.collect_list(F.struct(index, value))).alias("parts"),
    )
    joined = expected.join(seen, group, "left")
    n = F.col("n")
    ok = (F.col("rows") == n) & (F.col("distinct") == n) & (F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("empty") == 0)
    ok = F.coalesce(ok, F.lit(False))
    return joined.select(group, ok.alias("ok"), F.when(ok, F.transform("parts", lambda p: p[value])).alias("values"))
