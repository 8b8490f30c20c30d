"""Mixing sources to target weights: random keys, distributed prefix sums, exact cuts.

Every document gets a random key from a hash of its doc_id (of its text, if it
has none). Within each source
the documents are ordered by key; a key's leading bits name a range, of which
there are more the more documents there are (about RANGE_DOCS of them to one).
Word counts are summed per range, the ranges' sums along each source, and the
range in which a source's budget ends is sorted document by document. No
source, however large, is ordered in one task.

A source's target is its share of all words by weight, at most ``max_epochs``
times its size; the excess goes to the others by weight. A target of k sizes
and a rest takes the whole source k times, then documents in key order until
the rest is used up; the document at the cut gives only the words that fit.

Defined results: a null text or one of blanks has size 0; a null source is one
source, ordered last; rows with equal doc_id are ordered by size and a hash of
the text, and rows that agree in these too are alike: at the cut they are taken
one by one until the budget is used up, whichever of them; a source without
words has target 0; an empty table gives no rows; other columns play no part.
Keys depend on doc_id, text and seed alone, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import BLANK, BLANKS, n_words, stage

RANGE_DOCS = 8192
KEY_BITS = 60
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def random_key(seed: int = 0) -> Column:
    """A number of KEY_BITS bits from doc_id (else the text) and the seed: the leading hex digits of an MD5."""
    nameless = F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit(""))))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), nameless))
    return F.conv(F.substr(F.md5(name), F.lit(1), F.lit(KEY_BITS // 4)), 16, 10).cast("long")


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.coalesce("source", F.lit("")).alias("name"),
        F.col("source").isNull().alias("nameless"),
        n_words(F.col("text")).alias("size"),
        random_key(seed).alias("key"),
        F.xxhash64("text").alias("mark"),
        F.monotonically_increasing_id().alias("mix_uid"),
    )


def ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (a table with mix_uid) with ``mix_rank`` from 0 in each group of ``keys``.

    A uid's high bits tell the task that made it: rows are counted per task and
    ranked in it, so that a group of any size is never ordered in one piece.
    """
    told = rows.withColumn("mix_task", F.shiftright("mix_uid", 33))
    before = Window.partitionBy(*keys).orderBy("mix_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    counts = told.groupBy(*keys, "mix_task").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*keys, "mix_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "mix_task").orderBy("mix_uid")) - 1
    return told.withColumn("mix_own", own).join(counts, [*keys, "mix_task"]).withColumn("mix_rank", F.col("mix_before") + F.col("mix_own")).drop("mix_own", "mix_before", "mix_task")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (name, nameless, source_size), one row per source, each source's target.

    Sources sorted by cap over weight reach their caps in that order; with the
    capped ones taken out, the others share what is left by weight.
    """
    one = F.lit(1)
    by_name = Window.partitionBy(one).orderBy("nameless", F.encode("name", "UTF-8"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), "nameless", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy(one)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    # The first source that stays below its cap sets the level of all after it.
    share = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return levels.select("name", "nameless", "source_size", F.coalesce(F.least(F.col("cap"), share * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, mark (hash of the text), epochs (whole takes), part (words at the cut), taken."""
    slim = stage(_slim(docs, seed), "mix")
    bits = max(4, math.ceil(math.log2(max(slim.count(), 1) / RANGE_DOCS + 1)))
    slim = slim.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    per_bucket = slim.groupBy("name", "nameless", "bucket").agg(F.sum("size").alias("words"))
    sizes = per_bucket.groupBy("name", "nameless").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.round("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))

    along = Window.partitionBy("name", "nameless").orderBy("bucket")
    sums = per_bucket.withColumn("upto", F.sum("words").over(along))
    at = sums.join(plan.select("name", "nameless", "rest"), ["name", "nameless"])
    before = F.col("upto") - F.col("words")
    cut_bucket = at.where((before < F.col("rest")) & (F.col("rest") <= F.col("upto"))).select("name", "nameless", "bucket", (F.col("rest") - before).alias("left"))

    by = ["name", "nameless"]
    place = F.struct("key", F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "size", "mark")
    # Rows that are alike are one row here.
    inside = slim.join(cut_bucket, [*by, "bucket"]).withColumn("place", place).groupBy(*by, "place").agg(F.first("left").alias("left"), F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.partitionBy(*by).orderBy("place")))
    left = F.col("left") - (F.col("upto") - F.col("words"))
    edge = inside.where((left > 0) & (F.col("left") <= F.col("upto"))).select(*by, F.col("place").alias("cut"), F.floor(left / F.col("place.size")).alias("full"), (left % F.col("place.size")).alias("more"))
    plan = plan.join(edge, by, "left")

    # Joined by key range too, so that a hot source is spread over its ranges.
    joined = slim.join(per_bucket.drop("words").join(plan, by), [*by, "bucket"])
    at_cut = F.coalesce(place == F.col("cut"), F.lit(False))
    columns = ("doc_id", "source", "size", "source_size", "target", "mark")

    def taken(rows: DataFrame, extra: Column, part: Column) -> DataFrame:
        epochs = (F.col("whole") + extra).cast("long")
        return rows.select(*columns, epochs.alias("epochs"), part.cast("long").alias("part"), (epochs * F.col("size") + part).cast("long").alias("taken"))

    others = taken(joined.where(~at_cut), F.coalesce(place < F.col("cut"), F.lit(False)).cast("int"), F.lit(0))
    alike = ranks(joined.where(at_cut), by)
    one_by_one = taken(alike, (F.col("mix_rank") < F.col("full")).cast("int"), F.when(F.col("mix_rank") == F.col("full"), F.col("more")).otherwise(0))
    return others.unionByName(one_by_one)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    bare = F.btrim(text, F.lit(BLANKS.decode()))
    return F.array_join(F.slice(F.split(bare, BLANK), 1, n), " ")


def _one_by_one(rows: DataFrame) -> DataFrame:
    """Documents that are alike, with epochs and part of their own."""
    rank = F.col("mix_rank")
    told = stage(rows.withColumn("mix_uid", F.monotonically_increasing_id()), "alike")
    ranked = ranks(told.withColumn("mix_group", F.struct("mix_source", "mix_id", "plan_size", "plan_mark")), ["mix_group"])
    epochs = F.col("mix_least") + (rank < F.col("mix_full")).cast("int")
    part = F.when(rank == F.col("mix_full"), F.col("mix_part")).otherwise(0)
    return ranked.withColumn("mix_epochs", epochs).withColumn("mix_cut", part).drop("mix_rank", "mix_uid", "mix_group")


def materialize(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of a mix with their own columns: a row per epoch, and a cut row where only a part is taken."""
    keys = ["mix_id", "mix_source", "mix_size", "mix_mark"]
    # Rows that agree in the keys are alike: all have ``least`` epochs, ``full`` of them one more and one has the part.
    told = mixed.toDF(*[{"doc_id": "mix_id", "source": "mix_source", "size": "mix_size", "mark": "mix_mark"}.get(c, c) for c in mixed.columns])
    plan = told.groupBy(*keys).agg(F.min("epochs").alias("mix_least"), F.sum("epochs").alias("all"), F.count(F.lit(1)).alias("n"), F.max("part").alias("mix_part"))
    plan = plan.withColumn("mix_full", F.col("all") - F.col("mix_least") * F.col("n")).withColumn("mix_even", (F.col("n") == 1) | ((F.col("mix_full") == 0) & (F.col("mix_part") == 0))).drop("all", "n")
    marked = docs.withColumn("mix_size", n_words(F.col("text"))).withColumn("mix_mark", F.xxhash64("text"))
    plan = stage(plan.withColumnsRenamed({"mix_size": "plan_size", "mix_mark": "plan_mark"}), "mix-plan")
    same = marked["doc_id"].eqNullSafe(F.col("mix_id")) & marked["source"].eqNullSafe(F.col("mix_source")) & (marked["mix_size"] == F.col("plan_size")) & (marked["mix_mark"] == F.col("plan_mark"))
    joined = marked.join(plan.where("mix_even").hint("shuffle_hash"), same).withColumn("mix_epochs", F.col("mix_least")).withColumn("mix_cut", F.col("mix_part"))
    # Of rows that are alike and not all taken alike, there is one group per source at most.
    if not plan.where("NOT mix_even").isEmpty():
        joined = joined.unionByName(_one_by_one(marked.join(plan.where("NOT mix_even"), same)))
    times = F.col("mix_epochs") + F.when(F.col("mix_cut") > 0, 1).otherwise(0)
    # Whole rows are repeated and at most one is cut; documents not taken go.
    rows = joined.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<bigint>"))))
    cut = F.col("mix_epoch") > F.col("mix_epochs")
    text = F.when(cut, first_words(F.col("text"), F.col("mix_cut").cast("int"))).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = {
    "op7_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, encode(source)) AS k FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
o AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM l WHERE cap > level * weight),
t AS (SELECT l.source, source_size, CASE WHEN l.k < coalesce(o.k, l.k + 1) THEN cap ELSE least(cap, o.level * weight) END AS target FROM l CROSS JOIN o),
p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (p.whole * d.size + greatest(0, least(d.size, round(p.target)::BIGINT - p.whole * p.source_size
    - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size))))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
""",
}
QUERIES = {"op7_source_mix": op7_source_mix}
