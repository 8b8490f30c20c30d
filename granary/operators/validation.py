"""Rules as data: every rule of a record yields (type, severity, field); reports count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: list[tuple[str, str, str, Column]]) -> Column:
    """Array of (type, severity, field) of the rules (type, severity, field, is_broken) that are broken; null breaks none."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(f).alias("field"))) for t, s, f, bad in rules])
    )


def is_valid(found: Column) -> Column:
    """Only critical violations invalidate."""
    return ~F.exists(found, lambda v: v["severity"] == "critical")


def report(rows: DataFrame, found: str = "violations") -> DataFrame:
    """type, severity, n."""
    return rows.select(F.explode(found).alias("v")).groupBy("v.type", "v.severity").agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, found: str = "violations") -> DataFrame:
    """One row: records, valid ones, their share, violations."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_valid(F.col(found))).alias("n_valid"),
        F.coalesce(F.sum(F.size(found)), F.lit(0)).cast("long").alias("n_violations"),
    ).withColumn("success_rate", F.round(F.when(F.col("n") > 0, F.col("n_valid") / F.col("n")).otherwise(0.0), 6))


def per_image_contract(per_image: Column, images: Column) -> Column:
    """Keys are exactly image_1 … image_n and no text is blank."""
    wanted = F.transform(F.sequence(F.lit(1), F.greatest(F.size(images), F.lit(1))), lambda i: F.concat(F.lit("image_"), i.cast("string")))
    keys = F.map_keys(per_image)
    same = (F.size(F.array_except(wanted, keys)) == 0) & (F.size(F.array_except(keys, wanted)) == 0)
    return (F.size(images) > 0) & same & F.forall(F.map_values(per_image), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))


def flips_to_fail(total: Column, useless: Column, least: int, allow_none: bool = False) -> Column:
    """A pass with too few useful parts: total less useless under ``least``, with one useless at least unless allowed."""
    few = total - useless < least
    return few if allow_none else few & (useless >= 1)


def allowed_object(kind: Column, prop: Column, hierarchy: dict[str, tuple[str, ...]]) -> Column:
    """Whether a (type, property) is listed; without a hierarchy any non-empty type is."""
    if not hierarchy:
        return F.coalesce(kind, F.lit("")) != ""
    p = F.coalesce(prop, F.lit(""))
    known = [(kind == t) & ((p == "") if not ps else (p.isin(*ps) | F.concat_ws("/", kind, p).isin(*ps))) for t, ps in hierarchy.items()]
    out = known[0]
    for k in known[1:]:
        out = out | k
    return F.coalesce(out, F.lit(False))


def without_singletons(rows: DataFrame, record: str, group: str) -> DataFrame:
    """Rows of records in which no group has exactly one member."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(record, group).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes.where("n = 1").select(record).distinct(), record, "left_anti")


def within_budget(length: Column, budget: int) -> Column:
    return length.isNull() | (length <= budget)


def metric_allowed(tag: Column, patterns: tuple[str, ...]) -> Column:
    return ~F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(F.lower(tag), p))


#: Words that proposals must not hold, and verdict words.
FORBIDDEN = ("需复核", "不应直接", "证据不足", "第三态")


def proposal_problems(text: Column) -> Column:
    """Names of guards that a proposed rule breaks: forbidden phrases, no verdict word, ambiguous negation, both verdicts."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    rest = F.replace(bare, F.lit("不通过"), F.lit(""))
    checks = {
        "forbidden": F.exists(F.array(*[F.lit(w) for w in FORBIDDEN]), lambda w: F.contains(bare, w)),
        "not_binary": ~F.contains(bare, F.lit("通过")),
        "ambiguous_negation": bare.rlike("不(?:一定|必然|完全)"),
        "both_verdicts": F.contains(bare, F.lit("不通过")) & F.contains(rest, F.lit("通过")),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]))
