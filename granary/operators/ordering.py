"""Order-dependent operators: ranks, first and latest rows, packs, phases, patience, orders of objects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.geometry import aabb, pairs
from granary.session import staged


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, whole: one aggregation, no window."""
    sort = F.struct(*order)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), sort).alias("_row")).select("_row.*")


def latest_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    sort = F.struct(*order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), sort).alias("_row")).select("_row.*")


def ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank from 1; only these meet in one task."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_per_group(rows: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def without_repeats(items: Column) -> Column:
    """Items that differ from the one before."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def packs(rows: DataFrame, group: str, order: list[str], length: str, cap: int) -> DataFrame:
    """``pack``: number within the group; a new one starts where a row would exceed cap.

    A row of cap or more is alone. The sum restarts, so no window frame can say
    it: each group's rows are sorted by Spark and read as a stream, of which
    only the running sum is kept.
    """
    schema = rows.select("*", F.lit(0).cast("long").alias("pack")).schema
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total, pack, begun = None, 0, -1, False
        for frame in frames:
            numbers = []
            for g, n in zip(frame[group], frame[length]):
                n = 0 if pd.isna(n) else int(n)
                new = not begun or not (g == at or (pd.isna(g) and pd.isna(at)))
                if new:
                    at, pack, total, begun = g, 0, n, True
                elif total + n > cap or n >= cap:
                    pack, total = pack + 1, n
                else:
                    total += n
                numbers.append(pack)
            yield frame.assign(pack=numbers)

    return rows.repartition(parts, group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def phase_value(step: Column, stages: list[tuple[int, float]], first: float) -> Column:
    """A value linear between (end step, value) marks, from ``first`` at step 0; the last value after all of them."""
    out, start, before = None, 0, first
    for end, value in stages:
        inside = F.lit(before) + (F.lit(value) - F.lit(before)) * (step - start) / max(end - start, 1)
        out = F.when(step <= end, inside) if out is None else out.when(step <= end, inside)
        start, before = end, value
    return F.lit(first) if out is None else out.otherwise(F.lit(before))


def steps_of_percents(percents: list[float], total: int) -> list[int]:
    """Phase ends in steps: halves to even, each at least one after the last."""
    out: list[int] = []
    for p in percents:
        out.append(max(round(p / 100 * total), (out[-1] if out else 0) + 1))
    return out


def _since_gain(rows: DataFrame, order: list[str], gain: str, by: list[str]) -> DataFrame:
    """``_island``: gains so far; ``without_gain``: rows since the last of them, or so far; both per ``by``."""
    window = Window.partitionBy(*by).orderBy(*order)
    island = F.sum(F.when(F.col(gain) > 0, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.row_number().over(Window.partitionBy(*by, "_island").orderBy(*order))
    return rows.withColumn("_island", island).withColumn("without_gain", inside - F.when(F.col("_island") > 0, 1).otherwise(0))


def patience(rows: DataFrame, order: list[str], gain: str, run: list[str] | None = None) -> DataFrame:
    """``without_gain``: rows since the last positive gain, counted per run.

    Without runs the rows are counted in ranges of their order, and what each
    range leaves to the next is summed over the ranges, of which there are few.
    """
    if run:
        return _since_gain(rows, order, gain, run).drop("_island")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counted = _since_gain(dealt, order, gain, ["_range"])
    ends = counted.groupBy("_range").agg(F.max("_island").alias("gains"), F.max_by("without_gain", F.struct(*order)).alias("tail"))
    along = Window.partitionBy(F.lit(0)).orderBy("_range")
    ends = ends.withColumn("since", F.sum((F.col("gains") > 0).cast("int")).over(along))
    left = F.sum("tail").over(Window.partitionBy("since").orderBy("_range"))
    ends = ends.withColumn("left", left).withColumn("before", F.coalesce(F.lag("left").over(along), F.lit(0))).select("_range", "before")
    joined = counted.join(F.broadcast(ends), "_range")
    value = F.col("without_gain") + F.when(F.col("_island") == 0, F.col("before")).otherwise(0)
    return joined.select(*rows.columns, value.cast("int").alias("without_gain"))


def last_message(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "assistant") -> DataFrame:
    return turns.where(F.col("role") == role).groupBy(conv).agg(F.max_by("text", turn).alias("text"))


def object_order(objects: Column, policy: str = "reference") -> Column:
    """Objects (kind, points, …) from top to bottom, then left to right; ties stay in input order.

    ``reference``: by the first point of a box or line and the topmost of a
    polygon. ``center``: by the centre of the bounding box, then kind, then point.
    """
    rank = lambda o: F.when(o["kind"] == "bbox", 0).when(o["kind"] == "poly", 1).otherwise(2)

    def point(o: Column) -> Column:
        p = F.transform(pairs(o["points"]), lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x")))
        return F.when(o["kind"] == "poly", F.array_min(p)).otherwise(F.get(p, F.lit(0)))

    def key(o: Column, i: Column) -> Column:
        b = aabb(o["points"])
        centre = lambda k: (F.get(b, F.lit(k)) + F.get(b, F.lit(k + 2))) / 2
        if policy == "reference":
            return F.struct(point(o).alias("p"), i.alias("i"), o.alias("o"))
        return F.struct(centre(1).alias("y"), centre(0).alias("x"), rank(o).alias("k"), point(o).alias("p"), i.alias("i"), o.alias("o"))

    return F.transform(F.sort_array(F.transform(objects, key)), lambda s: s["o"])


def category_order(domain: Column, category: Column) -> list[Column]:
    """Order of a summary's entries: by name, in RRU the station's distance before all."""
    return [F.when((F.upper(domain) == "RRU") & (category == "站点距离"), 0).otherwise(1), category]
