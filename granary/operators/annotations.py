"""Annotation records: features to objects, descriptions by level, predictions, polygons, exports."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import geometry
from granary.functions.text import CATEGORY, DISTANCE

#: A prediction's object as JSON.
OBJECT = "struct<desc:string,bbox_2d:array<double>,poly:array<double>,line:array<double>,line_points:int>"


def corner_box(start: Column, end: Column) -> Column:
    """[x1, y1, x2, y2] of two corner points (x, y) in any order, not below 0."""
    low = lambda c: F.greatest(F.lit(0.0), F.least(start[c], end[c]))
    high = lambda c: F.greatest(F.lit(0.0), F.greatest(start[c], end[c]))
    return F.array(low("x"), low("y"), high("x"), high("y"))


def features(records: DataFrame, key: str) -> DataFrame:
    """A row per feature, from data_list (two corners and a label 'type/property/…') and from features (kind, points, label).

    Both are arrays of a record and may be null; ``place`` is the position in the record.
    """
    boxes = records.select(key, F.posexplode("data_list").alias("place", "f"))
    boxes = boxes.select(key, "place", F.lit("bbox").alias("kind"), corner_box(F.col("f")["start"], F.col("f")["end"]).alias("points"), F.col("f")["label"].alias("label"))
    native = records.select(key, F.posexplode("features").alias("place", "f"))
    native = native.select(key, "place", F.col("f")["kind"].alias("kind"), F.col("f")["points"].alias("points"), F.col("f")["label"].alias("label"))
    rows = boxes.unionByName(native)
    parts = F.split("label", "/")
    return rows.withColumn("type", F.get(parts, F.lit(0))).withColumn("property", F.get(parts, F.lit(1))).withColumn("extra", F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/"))


def leveled_description(category: Column, attributes: Column, order: list[str], groups: Column | None = None) -> Column:
    """'类别=…' first, then attributes (a map) in the given order where present, group ids last: distinct, by number, joined by '|'."""
    parts = [F.concat(F.lit(f"{CATEGORY}="), category)]
    for name in order:
        value = F.try_element_at(attributes, F.lit(name))
        parts.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}="), value)))
    if groups is not None:
        ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(groups, lambda g: F.nullif(F.regexp_extract(g, "([0-9]+)", 1), F.lit("")).cast("int")))))
        parts.append(F.when(F.size(ids) > 0, F.concat(F.lit("组="), F.array_join(ids.cast("array<string>"), "|"))))
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def mapped_value(raw: Column, taxonomy: list[str], negative: tuple[str, ...] = ()) -> Column:
    """Values of a raw text's '|' parts: the first taxonomy entry equal to, inside or around each; if any is negative only those."""

    def one(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for test in (lambda t: F.contains(t, part) & (part != ""), lambda t: F.contains(part, t), lambda t: part == t):
            for entry in reversed(taxonomy):
                out = F.when(test(F.lit(entry)), F.lit(entry)).otherwise(out)
        return out

    found = F.array_distinct(F.array_compact(F.transform(F.split(raw, r"\|"), lambda p: one(F.trim(p)))))
    bad = F.filter(found, lambda v: v.isin(*negative)) if negative else F.array().cast("array<string>")
    return F.array_join(F.when(F.size(bad) > 0, bad).otherwise(found), "|")


def parsed_prediction(text: Column) -> Column:
    """Objects (name, desc, kind, points) of a JSON map of objects with exactly one geometry each, an even number of finite coordinates and, for lines, the right line_points."""
    entries = F.coalesce(F.map_entries(F.from_json(text, f"map<string,{OBJECT}>")), F.array().cast(f"array<struct<key:string,value:{OBJECT}>>"))

    def shaped(e: Column) -> Column:
        v = e["value"]
        forms = F.filter(
            F.array(*[F.struct(F.lit(k).alias("kind"), v[c].alias("points")) for k, c in (("bbox", "bbox_2d"), ("poly", "poly"), ("line", "line"))]),
            lambda g: g["points"].isNotNull(),
        )
        g = F.get(forms, F.lit(0))
        counted = (g["kind"] != "line") | v["line_points"].isNull() | (v["line_points"] * 2 == F.size(g["points"]))
        ok = (F.size(forms) == 1) & (F.size(geometry.geometry_problems(g["kind"], g["points"])) == 0) & counted & (F.coalesce(v["desc"], F.lit("")) != "")
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), e["key"].alias("name"), v["desc"].alias("desc"), g["kind"].alias("kind"), g["points"].alias("points"))

    return F.filter(F.transform(entries, shaped), lambda o: o["ok"])


def capped_polygons(annotations: DataFrame, cap: int, tolerance: float = 10.0) -> DataFrame:
    """annotations (id, bbox xywh, segmentation): a polygon per part; one of more than ``cap`` points, or that leaves its box by more than the tolerance, becomes the box."""
    box = geometry.box_of_xywh(F.col("bbox"))
    rows = annotations.select("id", box.alias("box"), F.explode_outer("segmentation").alias("points"))
    b = geometry.aabb(F.col("points"))
    off = lambda i, sign: sign * (F.get(F.col("box"), F.lit(i)) - F.get(b, F.lit(i))) > tolerance
    outside = off(0, 1) | off(1, 1) | off(2, -1) | off(3, -1)
    plain = F.col("points").isNull() | (F.size("points") < 6) | (F.size("points") > 2 * cap) | (F.size("points") % 2 != 0) | outside
    return rows.select("id", F.when(F.coalesce(plain, F.lit(True)), "bbox").otherwise("poly").alias("kind"), F.when(F.coalesce(plain, F.lit(True)), F.col("box")).otherwise(F.col("points")).alias("points"))


def large_boxes(objects: Column, least: float) -> Column:
    """Indexes of the objects whose bounding box is at least so wide and high."""

    def wide(o: Column) -> Column:
        b = geometry.aabb(o["points"])
        return F.least(F.get(b, F.lit(2)) - F.get(b, F.lit(0)), F.get(b, F.lit(3)) - F.get(b, F.lit(1))) >= least

    return F.filter(F.transform(objects, lambda o, i: F.when(wide(o), i)), lambda i: i.isNotNull())


def by_distance(rows: DataFrame, flags: dict[str, Column], distance: str = "desc") -> DataFrame:
    """Per station distance named in a description, which flags any of its objects has; by number."""
    value = F.explode(F.split(F.regexp_extract(distance, f"{DISTANCE}=([^,]*)", 1), r"\|"))
    long = rows.select("*", value.alias("raw"))
    long = long.withColumn("distance", F.regexp_extract("raw", "([0-9]+)", 1).try_cast("int")).where("distance is not null")
    return long.groupBy("distance").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def tagged(rows: DataFrame, source: str, template: str, domain: str, mode: str) -> DataFrame:
    """Rows with their mix's tags added to ``metadata`` (a map); the tags win over equal keys."""
    tags = F.create_map(*[F.lit(x) for kv in (("_fusion_source", source), ("_fusion_template", template), ("_fusion_domain", domain), ("_fusion_mode", mode)) for x in kv])
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("_fusion_source", "_fusion_template", "_fusion_domain", "_fusion_mode"))
    return rows.withColumn("metadata", F.map_concat(own, tags))


def distilled(trajectories: DataFrame, prompts: DataFrame) -> DataFrame:
    """Chat rows: per ticket its prompt and its first well-formed answer by candidate index."""
    first = trajectories.where("format_ok").groupBy("ticket").agg(F.min_by("text", "candidate_index").alias("answer"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return prompts.join(first, "ticket").select("ticket", F.array(message("user", F.col("prompt")), message("assistant", F.col("answer"))).alias("messages"))


def merged_entries(base: DataFrame, override: DataFrame, key: str = "name") -> DataFrame:
    """Entries of both by name: the override's values win where it has some; base order, then the override's. Both have ``ordinal``."""
    columns = [c for c in base.columns if c not in (key, "ordinal")]
    b = base.select(key, F.struct(F.lit(0), "ordinal").alias("_o"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    o = override.select(key, F.struct(F.lit(1), "ordinal").alias("_p"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = b.join(o, key, "full")
    return both.select(key, *[F.coalesce(f"_n_{c}", f"_b_{c}").alias(c) for c in columns], F.coalesce("_o", "_p").alias("position"))


def similar_text(known: Column, text: Column, least: float = 0.9, contained: float = 0.85) -> Column:
    """The first known text equal to ``text``, or around or inside it with lengths that alike; else the first of the highest ratio of common blocks.

    ``known`` is an array in key order; ``guidance.similar_guidance`` does the same for tables.
    """

    @F.pandas_udf(T.StringType())
    def first_like(known: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or not t else _first_like(k, t, least, contained) for k, t in zip(known, text)], dtype=object)

    return first_like(known, text)


def _first_like(known, text: str, least: float, contained: float) -> str | None:
    best, ratio = None, 0.0
    for k in known:
        if k and (k == text or ((text in k or k in text) and min(len(k), len(text)) / max(len(k), len(text)) >= contained)):
            return k
        if k and (own := difflib.SequenceMatcher(None, text, k).ratio()) > ratio:
            best, ratio = k, own
    return best if ratio >= least else None
