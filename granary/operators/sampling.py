"""Deterministic samples, splits, quotas and schedules.

All randomness is the order of md5(seed:key), so results do not depend on
partitions and SQL can repeat them. Ranks over one global order use
``global_rank``: ranges of the hash are counted first, and each range is
ranked on its own, so no task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numeric import half_even

#: A hash's leading hexadecimal digits that name its range: 4,096 ranges.
RANGE_DIGITS = 3


def hash_of(seed, *keys) -> Column:
    """md5 of the seed and keys, joined by colons."""
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts))


def group_rank(rows: DataFrame, by: list[str], key: list[str], seed=0, out: str = "rank") -> DataFrame:
    """Rank from 1 in hash order within each group, by ranges of the hash."""
    hashed = rows.withColumn("_hash", hash_of(seed, *key)).withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    sizes = hashed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    joined = hashed.join(F.broadcast(before) if not by else before, [*by, "_range"])
    inside = Window.partitionBy(*by, "_range").orderBy("_hash", *key)
    return joined.withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("long")).drop("_hash", "_range", "_before")


def global_rank(rows: DataFrame, key: list[str], seed=0, out: str = "rank") -> DataFrame:
    return group_rank(rows, [], key, seed, out)


def take_hashed(rows: DataFrame, n: int, key: list[str], seed=0) -> DataFrame:
    """n rows, the first in hash order."""
    return rows.withColumn("_hash", hash_of(seed, *key)).orderBy("_hash", *key).limit(n).drop("_hash")


def per_group(rows: DataFrame, by: str, key: str, k: int, seed=0) -> DataFrame:
    """Up to k rows of each group."""
    return group_rank(rows, [by], [key], seed).where(F.col("rank") <= k).drop("rank")


def target_quotas(pools: DataFrame, n: str = "n", ratio: str = "ratio") -> DataFrame:
    """``quota``: pool size times ratio (1 where null), halves to even."""
    return pools.withColumn("quota", half_even(F.col(n) * F.coalesce(ratio, F.lit(1.0))).cast("long"))


def auxiliary_quota(ratio: float, targets: DataFrame, quota: str = "quota") -> DataFrame:
    """One row: the ratio times the sum of all target quotas."""
    return targets.agg(half_even(F.coalesce(F.sum(quota), F.lit(0)) * ratio).cast("long").alias("quota"))


def draw(pool: DataFrame, quotas: DataFrame, by: str, key: str, seed=0, with_replacement: bool = False) -> DataFrame:
    """Each group's quota of rows: (by, key, draw, fallback).

    Up to the pool's size rows come without replacement in hash order; a larger
    quota (or ``with_replacement``) draws each row number draw at a hashed place.
    """
    ranked = group_rank(pool.select(by, key), [by], [key], seed)
    sizes = pool.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    plan = quotas.select(by, "quota").join(sizes, by)
    again = (F.col("quota") > F.col("size")) | F.lit(with_replacement)
    plan = plan.withColumn("fallback", again)
    single = ranked.join(plan.where(~again), by).where(F.col("rank") <= F.col("quota")).select(by, key, F.col("rank").alias("draw"), "fallback")
    draws = plan.where(again & (F.col("quota") > 0)).select(by, "size", "fallback", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("draw"))
    place = F.conv(F.substring(hash_of(f"{seed}:draw", by, "draw"), 1, 12), 16, 10).cast("long") % F.col("size") + 1
    many = draws.withColumn("rank", place).join(ranked, [by, "rank"]).select(by, key, "draw", "fallback")
    return single.unionByName(many)


def oversample(pool: DataFrame, quotas: DataFrame, by: str, key: str, seed=0) -> DataFrame:
    """The whole pool in whole rounds, and the rest of the quota in hash order: (by, key, draw)."""
    ranked = group_rank(pool.select(by, key), [by], [key], seed)
    sizes = pool.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    plan = quotas.select(by, "quota").join(sizes, by)
    joined = ranked.join(plan, by)
    rounds = F.floor((F.col("quota") - F.col("rank")) / F.col("size")).cast("long")
    times = F.when(F.col("quota") >= F.col("rank"), F.sequence(F.lit(0).cast("long"), rounds)).otherwise(F.array().cast("array<bigint>"))
    return joined.withColumn("round", F.explode(times)).select(by, key, (F.col("round") * F.col("size") + F.col("rank")).alias("draw"))


def schedule(drawn: DataFrame, by: str, key: str, seed=0, epoch: int = 0) -> DataFrame:
    """``position`` of each drawn row in an epoch's global shuffle."""
    return global_rank(drawn, [by, key, "draw"], f"{seed}:{epoch}", "position")


def stratified_split(rows: DataFrame, label: str, key: str, n: int, seed=0) -> DataFrame:
    """``held_out``: n rows spread over labels in proportion, by largest remainder (ties by label)."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy(F.lit(0))
    share = sizes.withColumn("exact", F.col("size") * F.lit(n) / F.sum("size").over(everything)).withColumn("floor", F.floor("exact").cast("long"))
    left = F.lit(n) - F.sum("floor").over(everything)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("floor")), F.asc_nulls_first(label)))
    quota = share.withColumn("take", F.col("floor") + F.when(rank <= left, 1).otherwise(0)).select(label, "take")
    return group_rank(rows, [label], [key], seed).join(quota, label).withColumn("held_out", F.col("rank") <= F.col("take")).drop("rank", "take")


def train_val(rows: DataFrame, key: str, val_ratio: float, seed=0) -> DataFrame:
    """``part``: val for a share of rows (one at least), else train."""
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * val_ratio)).alias("n_val"))
    ranked = global_rank(rows, [key], seed)
    return ranked.crossJoin(F.broadcast(size)).withColumn("part", F.when(F.col("rank") <= F.col("n_val"), "val").otherwise("train")).drop("rank", "n_val")


def proportional(rows: DataFrame, category: str, key: str, n: int, seed=0) -> DataFrame:
    """About n rows, each category in proportion and at least once; biggest categories first, then cut at n."""
    sizes = rows.groupBy(category).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))
    quota = sizes.withColumn("take", F.greatest(F.lit(1), F.floor(F.col("size") * n / total)).cast("long"))
    picked = group_rank(rows, [category], [key], seed).join(quota, category).where(F.col("rank") <= F.col("take"))
    return picked.orderBy(F.desc("size"), category, "rank").limit(n).drop("rank", "take", "size")


def of_top_categories(rows: DataFrame, category: str, k: int) -> DataFrame:
    """Rows of the k most frequent categories (ties by name)."""
    top = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category).limit(k)
    return rows.join(top.select(category), category, "left_semi")


def pass_fail_sample(rows: DataFrame, label: str, key: str, n_pass: int | None, n_fail: int | None, seed=0) -> DataFrame:
    """Up to n rows of each label; no number keeps all of it."""
    ranked = group_rank(rows, [label], [key], seed)
    limit = F.when(F.col(label) == "pass", F.lit(n_pass)).when(F.col(label) == "fail", F.lit(n_fail))
    return ranked.where(limit.isNull() | (F.col("rank") <= limit)).drop("rank")


def cap_items(items: Column, k: int, seed: Column) -> Column:
    """Up to k items of an array, picked by hash, in their own order."""
    keyed = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    first = F.slice(F.sort_array(keyed), 1, k)
    return F.transform(F.sort_array(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])


def route(key: Column) -> Column:
    """0 or 1 from the first byte of the key's md5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 2), 16, 10).cast("long") % 2).cast("int")


def shard(position: Column, n: int, shards: int) -> Column:
    """Shard of a position in 0 … n - 1 when shards are contiguous and differ by one at most."""
    size, more = divmod(n, shards)
    edge = more * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(more + F.floor((position - edge) / max(size, 1))).cast("long")


def sample_id(name: Column, index: Column) -> Column:
    """A 64-bit id: 16 bits of the name's CRC-32, then the index's low 32 bits."""
    high = F.crc32(F.encode(name, "UTF-8")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.shiftleft(high, 32).bitwiseOR(index.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def wrapped_page(position: Column, n: int, size: int, start: int = 0):
    """(epoch, offset) of the position-th item when pages of a reshuffled permutation wrap around."""
    at = position + start * size
    return F.floor(at / n).cast("long"), (at % n).cast("long")


#: Fields of a data set's entry that may stand beside its name, or in ``params``.
ENTRY_FIELDS = "train_jsonl string, val_jsonl string, template string, mode string, use_summary boolean, poly_fallback string, poly_max_points int, augmentation_enabled boolean, curriculum_enabled boolean, max_objects_per_image int, user_prompt string, system_prompt string, seed bigint, sample_without_replacement boolean"
ENTRY = f"dataset string, name string, ratio string, params struct<{ENTRY_FIELDS.replace(' ', ':').replace(',:', ',')}>, {ENTRY_FIELDS}"


def mixture_entries(rows: DataFrame) -> DataFrame:
    """role, dataset, name, ratio, the entry's fields, problem: entries of a mixture read from JSON.

    rows: role (target or auxiliary), entry (JSON). ``params``, where given, is
    what counts, else the fields beside the name. ``problem`` (null if none):
    no_name, ratio_missing (an auxiliary one needs it), ratio_not_number,
    ratio_negative, removed_field, or duplicate for all entries of one name.
    """
    e = F.from_json("entry", ENTRY)
    ratio = F.col("e.ratio").try_cast("double")
    removed = F.coalesce(F.get_json_object("entry", "$.summary_label_grouping"), F.get_json_object("entry", "$.params.summary_label_grouping"))
    fields = [f.split()[0] for f in ENTRY_FIELDS.split(", ")]
    own = [F.when(F.col("e.params").isNotNull(), F.col(f"e.params.{f}")).otherwise(F.col(f"e.{f}")).alias(f) for f in fields]
    parsed = rows.select("role", "entry", e.alias("e")).select(
        "role",
        F.coalesce("e.dataset", "e.name").alias("dataset"),
        F.coalesce("e.name", "e.dataset").alias("name"),
        ratio.alias("ratio"),
        *own,
        F.when(F.col("e.dataset").isNull() & F.col("e.name").isNull(), "no_name")
        .when(removed.isNotNull(), "removed_field")
        .when((F.col("role") == "auxiliary") & F.col("e.ratio").isNull(), "ratio_missing")
        .when(F.col("e.ratio").isNotNull() & ratio.isNull(), "ratio_not_number")
        .when(ratio < 0, "ratio_negative")
        .alias("fault"),
    )
    names = parsed.where("fault is null").groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    return parsed.join(names, "name", "left").withColumn("problem", F.coalesce("fault", F.when(F.col("times") > 1, "duplicate"))).drop("fault", "times")


def merged_mixture(base: DataFrame, override: DataFrame, key: str = "name") -> DataFrame:
    """Entries of a mixture that extends another: equal names are merged, the own fields first, then the base's; others stay."""
    fields = [c for c in base.columns if c != key]
    own = override.select(F.col(key).alias("own_key"), *[F.col(c).alias(f"own_{c}") for c in fields])
    joined = base.join(own, F.col(key) == F.col("own_key"), "full")
    return joined.select(F.coalesce(key, "own_key").alias(key), *[F.coalesce(f"own_{c}", c).alias(c) for c in fields])
