"""Summaries of records built from their objects' descriptions, and vocabularies of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import jsonx, text

#: Keys of descriptions and of the summary's faults, what marks a negative value, and each domain's categories.
GROUP, PROPERTY, TAG, SITE = "组", "属性", "标签", "站点距离"
NEGATIVE = ("不符合", "不合规", "不合格", "不合理", "错误", "不能")
CATEGORIES = {
    "BBU": ("BBU设备", "挡风板", "光纤", "电线", "标签", "BBU安装螺丝", "机柜处接地螺丝", "地排处接地螺丝", "ODF端光纤插头", "BBU端光纤插头"),
    "RRU": ("RRU设备", "紧固件", "RRU接地端", "地排接地端螺丝", "尾纤", "接地线", "标签", "站点距离"),
}
FREE = (text.REMARK, text.TEXT)
PAIRS = "array<struct<k:string,v:string>>"


def _tokens(desc: Column) -> Column:
    return F.filter(F.transform(F.split(desc, ","), lambda t: F.trim(t)), lambda t: t != "")


def _key(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("=")), F.trim(F.substring_index(token, "=", 1)))


def _value(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, "^[^=]*=", ""))


def parsed(desc: Column) -> Column:
    """(values, invalid): (k, v) of a description in order, and whether it is at fault.

    A token without '=' continues a free text to its left, else it is a remark;
    values are split at '|', free texts are cleaned instead. At fault are keys
    or values that are empty, and a description without a category.
    """
    none = F.array().cast(PAIRS)
    start = F.struct(none.alias("out"), F.array().cast("array<string>").alias("stray"), F.lit(None).cast("string").alias("key"), F.lit("").alias("value"), F.lit(False).alias("bad"))

    def flushed(s: Column) -> Column:
        return F.when(s["key"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["key"].alias("k"), s["value"].alias("v")))))

    def step(s: Column, given: Column) -> Column:
        t, key = given["t"], given["k"]
        opens, broken = key.isNotNull() & (key != ""), key.isNotNull() & (key == "")
        joins = key.isNull() & F.coalesce(s["key"].isin(*FREE), F.lit(False))
        stray = broken | (key.isNull() & ~joins)
        longer = F.when(s["value"] == "", t).otherwise(F.concat(s["value"], F.lit(","), t))
        return F.struct(
            F.when(key.isNotNull(), flushed(s)).otherwise(s["out"]).alias("out"),
            F.when(stray, F.concat(s["stray"], F.array(t))).otherwise(s["stray"]).alias("stray"),
            F.when(opens, key).when(broken, F.lit(None).cast("string")).otherwise(s["key"]).alias("key"),
            F.when(opens, given["v"]).when(broken, F.lit("")).when(joins, longer).otherwise(s["value"]).alias("value"),
            (s["bad"] | broken).alias("bad"),
        )

    # A token's key and value are found once, before the steps that name them many times.
    tokens = F.transform(_tokens(desc), lambda t: F.struct(t.alias("t"), _key(t).alias("k"), _value(t).alias("v")))
    read = F.aggregate(tokens, start, step, lambda s: F.struct(flushed(s).alias("out"), s["stray"].alias("stray"), s["bad"].alias("bad")))

    def spread(p: Column) -> Column:
        free = F.filter(F.array(text.clean_free_text(p["v"])), lambda v: v != "")
        several = F.when(p["k"].isin(*FREE), free).otherwise(F.filter(F.split(p["v"], r"\|"), lambda v: v != ""))
        return F.transform(several, lambda v: F.struct(p["k"].alias("k"), v.alias("v")))

    def judged(s: Column) -> Column:
        rest = text.clean_free_text(F.array_join(s["stray"], ","))
        more = F.when(F.size(s["stray"]) > 0, text.let(rest, lambda r: F.when(r != "", F.array(F.struct(F.lit(text.REMARK).alias("k"), r.alias("v")))).otherwise(none))).otherwise(none)
        bad = lambda values: s["bad"] | F.exists(s["out"], lambda p: p["v"] == "") | ~F.exists(values, lambda p: p["k"] == text.CATEGORY)
        return text.let(F.concat(F.flatten(F.transform(s["out"], spread)), more), lambda values: F.struct(values.alias("values"), bad(values).alias("invalid")))

    return text.let(read, judged)


def _conflict(values: Column) -> Column:
    """A key with a negative value and one that is not."""
    negative = F.lit("|".join(NEGATIVE))
    judged = F.transform(values, lambda p: F.struct(p["k"].alias("k"), F.regexp_like(p["v"], negative).alias("n")))
    return F.exists(judged, lambda p: p["n"] & F.exists(judged, lambda q: (q["k"] == p["k"]) & ~q["n"]))


def _named(key: Column, json: Column) -> Column:
    """'"key":json' with the key escaped."""
    head = F.to_json(F.create_map(key, F.lit(0)))
    return F.concat(F.substring(head, F.lit(2), F.length(head) - 3), json)


def built(objects: DataFrame, record: str, place: str, desc: str, domain: str = "BBU", strict: bool = False) -> DataFrame:
    """record, summary, n_invalid, n_unknown, n_conflict: a JSON summary per record of its objects' descriptions.

    Categories stand in order (a station distance first for RRU), their keys
    too; values are counted in the order in which they appear first. BBU lists
    the distinct remarks as they come, RRU counts groups. A record with an
    invalid or conflicting description or an unknown category has no summary;
    with ``strict`` it is an error. A null description is an empty one, which is
    invalid. Rows are dealt by record once, and all the counting stays there.
    """
    known, rru = CATEGORIES[domain.upper()], domain.upper() == "RRU"
    dealt = objects.select(F.col(record), F.col(place).alias("_place"), parsed(F.coalesce(F.col(desc), F.lit(""))).alias("_d")).repartition(record)
    category = F.get(F.filter("_d.values", lambda p: p["k"] == text.CATEGORY), F.lit(0))["v"]
    rows = dealt.select(record, "_place", category.alias("_c"), "_d.values", F.col("_d.invalid").alias("n_invalid"))
    unknown = F.coalesce(F.col("_c").isNotNull() & ~F.col("_c").isin(*known), F.lit(False))
    rows = rows.withColumns({"n_unknown": unknown, "n_conflict": _conflict(F.col("values"))})
    faults = ("n_invalid", "n_unknown", "n_conflict")

    # An object's faults go with the first of its values, so that one chain of aggregations counts both.
    long = rows.select(record, "_c", "_place", *faults, F.posexplode_outer("values").alias("_i", "_p"))
    leads = F.coalesce(F.col("_i"), F.lit(0)) == 0
    sums = [F.sum(n).alias(n) for n in faults]
    counted = long.groupBy(record, "_c", F.col("_p.k").alias("k"), F.col("_p.v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_place", "_i")).alias("first"), *[F.count_if(leads & F.col(n)).alias(n) for n in faults])
    in_order = lambda entries: F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["v"], e["n"]))))
    per_key = counted.groupBy(record, "_c", "k").agg(F.array_sort(F.collect_list(F.struct("first", "v", "n"))).alias("values"), *sums)
    extra_key = GROUP if rru else text.REMARK
    counts = F.col("_c").isNotNull() & F.col("k").isNotNull()
    attribute = F.when(counts & ~F.col("k").isin(text.CATEGORY, text.REMARK), F.struct("k", _named(F.col("k"), in_order(F.col("values"))).alias("json")))
    extras = F.flatten(F.collect_list(F.when(counts & (F.col("k") == extra_key), F.col("values"))))
    per_category = per_key.groupBy(record, "_c").agg(F.array_sort(F.collect_list(attribute)).alias("a"), extras.alias("extras"), *sums)
    named = F.to_json(F.create_map(F.lit(text.CATEGORY), F.col("_c")))
    entry = F.concat(F.lit("{"), F.array_join(F.concat(F.array(F.substring(named, F.lit(2), F.length(named) - 2)), F.transform("a", lambda a: a["json"])), ","), F.lit("}"))
    rank = F.when(F.lit(rru) & (F.col("_c") == SITE), 0).otherwise(1)
    listed = F.collect_list(F.when(F.col("_c").isNotNull(), F.struct(rank.alias("r"), "_c", entry.alias("e"))))
    whole = per_category.groupBy(record).agg(F.array_join(F.transform(F.array_sort(listed), lambda x: x["e"]), ",").alias("stats"), F.array_sort(F.flatten(F.collect_list("extras"))).alias("extras"), *sums)

    names = F.array_distinct(F.transform("extras", lambda e: e["v"]))
    times = lambda v: F.aggregate(F.filter("extras", lambda e: e["v"] == v), F.lit(0).cast("long"), lambda n, e: n + e["n"])
    shown = F.to_json(F.map_from_entries(F.transform(names, lambda v: F.struct(v, times(v))))) if rru else F.to_json(names)
    whole = whole.withColumn("extra", F.when(F.size("extras") > 0, shown))

    tail = F.when(F.col("extra").isNotNull(), F.concat(F.lit(f',"{jsonx.GROUPS if rru else jsonx.NOTES}":'), F.col("extra"))).otherwise("")
    summary = jsonx.stable_json(F.concat(F.lit(f'{{"{jsonx.STATS}":['), F.coalesce("stats", F.lit("")), F.lit("]"), tail, F.lit("}")))
    faulty = F.col("n_invalid") + F.col("n_unknown") + F.col("n_conflict") > 0
    otherwise = F.raise_error(F.concat(F.lit("summary with faults: "), F.to_json(F.struct("n_invalid", "n_unknown", "n_conflict")))) if strict else F.lit(None).cast("string")
    return whole.select(record, F.when(faulty, otherwise).otherwise(summary).alias("summary"), "n_invalid", "n_unknown", "n_conflict")


def components(desc: Column) -> Column:
    """(object_type, property, extra) of a description with keys, or of the older form with slashes.

    Tokens without '=' belong to the extra before any key and behind a remark;
    of keys named twice the last value holds.
    """
    start = F.struct(*[F.lit("").alias(n) for n in ("object_type", "property", "extra", "key")])

    def step(s: Column, t: Column) -> Column:
        key = _key(t)
        named = lambda name, was: F.when(key == name, _value(t)).otherwise(was)
        more = key.isNull() & s["key"].isin("", text.REMARK)
        extra = F.when(key == text.REMARK, _value(t)).when(more, F.concat_ws(",", F.nullif(s["extra"], F.lit("")), t)).otherwise(s["extra"])
        return F.struct(named(text.CATEGORY, s["object_type"]).alias("object_type"), named(PROPERTY, s["property"]).alias("property"), extra.alias("extra"), F.coalesce(key, s["key"]).alias("key"))

    keyed = F.aggregate(_tokens(desc), start, step)
    parts = F.split(desc, "/")
    at = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    rest = F.trim(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "/"))
    has_keys = F.exists(_tokens(desc), lambda t: F.contains(t, F.lit("=")))
    pick = lambda name, old: F.when(has_keys, keyed[name]).otherwise(old).alias(name)
    return F.struct(pick("object_type", at(0)), pick("property", at(1)), pick("extra", rest))


def vocabulary(objects: DataFrame, desc: str = "desc") -> DataFrame:
    """kind, label, once each: object_types, properties, full_descriptions, and all labels with and without those of tags."""
    c = components(F.col(desc))
    rows = objects.where(F.coalesce(F.col(desc), F.lit("")) != "").select(F.col(desc).alias("_d"), c.alias("_c"))
    parts = F.array(F.col("_c.object_type"), F.col("_c.property"), F.col("_c.extra"))
    of_kind = lambda kind, labels: F.transform(labels, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))
    plain = F.when(F.col("_c.object_type") == TAG, F.array().cast("array<string>")).otherwise(parts)
    listed = F.concat(
        of_kind("all_unique_labels", parts),
        of_kind("unique_labels_excluded_tag", plain),
        of_kind("object_types", F.array(F.col("_c.object_type"))),
        of_kind("properties", F.array(F.col("_c.property"))),
        of_kind("full_descriptions", F.array(F.col("_d"))),
    )
    return rows.select(F.inline(listed)).where("label <> ''").distinct()
