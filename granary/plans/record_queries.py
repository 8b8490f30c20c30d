"""Cleaned summaries, kinds of tokens, category orders, and entries of mixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import records
from granary.operators import ordering, sampling
from granary.plans.registry import query, table


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, '{"统计": [{"类别": "' || o_orderpriority || '"}]}' AS doc, o_orderpriority AS p FROM orders WHERE o_orderkey % 9 <> 8)
SELECT o_orderkey, CASE k WHEN 0 THEN doc WHEN 1 THEN doc WHEN 2 THEN '无关图片' WHEN 3 THEN p WHEN 4 THEN p || '，b' WHEN 5 THEN 'said ' || p WHEN 6 THEN '{"统计": [], "dataset": "' || p || '"}' ELSE p END AS summary FROM o"""
)
def clean_summaries(spark, sf_dir):
    """Objects alone and behind a header, the irrelevant word, other objects, plain texts, keys out of order; records with a null text."""
    p, kind = F.col("o_orderpriority"), F.col("o_orderkey") % 8
    doc = F.concat(F.lit('{"统计":[{"类别":"'), p, F.lit('"}]}'))
    said = F.when(kind == 0, F.concat(F.lit(" "), doc)).when(kind == 1, F.concat(F.lit("<DOMAIN=BBU>, <TASK=SUMMARY>\n"), doc, F.lit("\n"))).when(kind == 2, F.concat(F.lit("无关图片 "), p))
    said = said.when(kind == 3, F.concat(F.lit('{"n": 1, "图片_1": " '), p, F.lit(' "}'))).when(kind == 4, F.concat(F.lit('{"a": "'), p, F.lit('", "n": 2, "b": "b"}')))
    said = said.when(kind == 5, F.concat(F.lit("said "), p, F.lit("\n"))).when(kind == 6, F.concat(F.lit('{"dataset": "'), p, F.lit('", "统计": []}'))).otherwise(F.concat(F.lit('{"image_1": "'), p, F.lit('", "图片_1": "x"}')))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("image_1"), F.when(F.col("o_orderkey") % 9 != 8, said)).alias("per_image"))
    return records.clean_records(rows, "o_orderkey").where("per_image is not null").select("o_orderkey", F.element_at("per_image", "image_1").alias("summary"))


@query(
    """WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, c_custkey % 3 AS shift FROM customer)
SELECT c_custkey, array_to_string([-1, CASE WHEN shift = 2 THEN 3 ELSE 1 END, -1, CASE WHEN n >= 2 THEN CASE WHEN shift = 0 THEN 2 ELSE 3 END ELSE 3 END, 3], ',') AS kinds FROM c"""
)
def token_kinds(spark, sf_dir):
    """A description of two characters, a coordinate of one, and tokens of three that slide over them; some tokens are missing."""
    n, shift = F.col("c_custkey") % 4, (F.col("c_custkey") % 3).cast("int")
    at = lambda a, b, **more: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), *[F.lit(v).alias(k) for k, v in more.items()])
    spans = F.array(at(F.lit(0), F.lit(2), type=1), at(F.lit(10), F.lit(12), type=2))
    tokens = F.slice(F.array(at(shift, shift + 2), at(10 + 2 * shift, 12 + 2 * shift), at(F.lit(20), F.lit(20)), at(F.lit(30), F.lit(31))), 1, n.cast("int"))
    labels = F.array(*[F.lit(x) for x in (-100, 7, -100, 8, 9)])
    kinds = F.when(n == 0, F.array(F.lit(-1), F.when(shift == 2, 3).otherwise(1), F.lit(-1), F.lit(3), F.lit(3))).otherwise(records.token_types(tokens, spans, labels))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(kinds.cast("array<string>"), ",").alias("kinds"))


@query(
    """WITH e AS (SELECT DISTINCT user_id % 50 AS doc, CASE event_type WHEN (SELECT max(event_type) FROM events) THEN '站点距离' ELSE event_type END AS category FROM events)
SELECT doc, category, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN doc % 2 = 0 AND category = '站点距离' THEN 0 ELSE 1 END, category)::INT AS place FROM e"""
)
def category_order(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_type")).first()[0]
    rows = events.select((F.col("user_id") % 50).alias("doc"), F.when(F.col("event_type") == last, "站点距离").otherwise(F.col("event_type")).alias("category")).distinct()
    domain = F.when(F.col("doc") % 2 == 0, "rru").otherwise("bbu")
    within = Window.partitionBy("doc").orderBy(*ordering.category_order(domain, F.col("category")))
    return rows.select("doc", "category", F.row_number().over(within).alias("place"))


@query(
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS v, c_custkey % 2 = 0 AS aux FROM customer)
SELECT CASE WHEN aux THEN 'auxiliary' ELSE 'target' END AS role, CASE v WHEN 0 THEN NULL WHEN 5 THEN 'same' ELSE 'd' || k END AS name, CASE WHEN v IN (1, 2, 5, 6, 7) THEN 0.5 WHEN v = 4 AND k % 3 = 0 THEN -2.0 END::DOUBLE AS ratio,
  CASE v WHEN 7 THEN 'p' WHEN 0 THEN NULL ELSE 't' END AS template,
  CASE v WHEN 0 THEN 'no_name' WHEN 3 THEN 'ratio_not_number' WHEN 4 THEN CASE WHEN k % 3 = 0 THEN 'ratio_negative' ELSE 'ratio_missing' END WHEN 5 THEN 'duplicate' WHEN 6 THEN 'removed_field' END AS problem FROM c"""
)
def mixture_entries(spark, sf_dir):
    """Entries with fields beside the name and in params, and with each kind of fault."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 8
    name = F.when(kind == 5, "same").otherwise(F.concat(F.lit("d"), k))
    ratio = F.when(kind == 3, "many").when((kind == 4) & (k % 3 != 0), F.lit(None)).when(kind == 4, "-2").otherwise("0.5")
    params = F.when(kind == 7, F.struct(F.lit("p").alias("template")))
    fields = {"name": F.when(kind != 0, name), "ratio": F.when(kind != 0, ratio), "template": F.when(kind != 0, "t"), "params": params, "summary_label_grouping": F.when(kind == 6, "x")}
    rows = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "auxiliary").otherwise("target").alias("role"), F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("entry"))
    return sampling.mixture_entries(rows).select("role", "name", "ratio", "template", "problem")
