"""Connected components of a graph of links, without the driver seeing any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable from each node of ``links`` (a, b).

    Each round a node takes the smallest label around it, then its label's own
    label, so chains shorten by half or better; a written table ends each round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = stage(both.toDF("node", "near"), "links")
    labels = stage(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), "labels")
    while True:
        around = both.join(labels.toDF("near", "seen"), "near").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = step.join(jump, "next").select("node", "was", F.least("next", "far").alias("component"))
        moved = stage(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.where("was != component").limit(1).count():
            return labels


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component once more links are known: only components are linked anew, not their nodes."""
    if labels is None:
        return components(links)
    a, b = labels.toDF("a", "c_a"), labels.toDF("b", "c_b")
    named = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = components(named.where("a != b").distinct())
    old = labels.join(merged.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    fresh = merged.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return stage(old.unionByName(fresh), "labels")
