"""Guidance, payloads, table functions, phrases, workbooks and conversion jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import payloads, phrases, tables
from granary.operators import converter, guidance
from granary.plans.registry import query, table
from granary.session import shared_path, staged
from granary.sources import workbook


@query(
    """WITH c AS (SELECT c_custkey, c_custkey % 10 AS s, c_custkey % 7 AS k FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 1, 2, 4) THEN 'G' || s END AS guidance_key FROM c"""
)
def guidance_similarity(spark, sf_dir):
    """Edited guidance texts looked up in their mission's book: equal, longer by an eighth or a fifth, with other beginnings, punctuated, foreign."""
    book = table(spark, sf_dir, "supplier").where("s_suppkey < 10").select((F.col("s_suppkey") % 3).alias("mission"), "s_suppkey", F.md5(F.col("s_suppkey").cast("string")).alias("text"))
    entries = book.select("mission", F.concat(F.lit("G"), "s_suppkey").alias("guidance_key"), (F.col("s_suppkey") + 10).alias("ordinal"), "text")
    scaffold = book.select("mission", F.concat(F.lit("S"), "s_suppkey").alias("guidance_key"), F.col("s_suppkey").alias("ordinal"), "text")
    kind, text = F.col("c_custkey") % 7, F.md5((F.col("c_custkey") % 10).cast("string"))
    edited = (
        F.when(kind == 0, F.concat(F.upper(text), F.lit(" ! ")))
        .when(kind == 1, F.concat(text, F.lit("zzzzz")))
        .when(kind == 2, F.concat(text, F.lit("zzzzzz")))
        .when(kind == 3, F.concat(text, F.lit("zzzzzzzz")))
        .when(kind == 4, F.concat(F.lit("zz"), F.substring(text, 3, 30)))
        .when(kind == 5, F.concat(F.lit("zzzzz"), F.substring(text, 6, 27)))
        .otherwise(F.lit("?!"))
    )
    texts = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10 % 3).alias("mission"), edited.alias("text"))
    return guidance.similar_guidance(texts, entries.unionByName(scaffold), "c_custkey", "mission")


def _documents(spark, sf_dir):
    """Nested documents made of events, and overrides for two of three."""
    events, kind = table(spark, sf_dir, "events"), F.col("event_id") % 3
    document = F.concat(F.lit('{"n": "'), "event_type", F.lit('", "l": [1, 2], "a": {"s": true, "p": '), "props", F.lit("}}"))
    override = F.when(kind == 0, '{"a": {"p": {"k": null}, "x": 1}, "l": [3]}').when(kind == 1, '{"a": 5}')
    return events.select("event_id", document.alias("document")), events.select("event_id", override.alias("document")).where("document IS NOT NULL")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":{"p":{"k":null},"s":true,"x":1},"l":[3],"n":"' || event_type || '"}' WHEN 1 THEN '{"a":5,"l":[1,2],"n":"' || event_type || '"}'
  ELSE '{"n": "' || event_type || '", "l": [1, 2], "a": {"s": true, "p": ' || props || '}}' END AS document FROM events"""
)
def deep_merges(spark, sf_dir):
    base, override = _documents(spark, sf_dir)
    return payloads.merged_documents(base, override, "event_id", "document")


@query(
    """WITH e AS (SELECT event_id, replace(props, ' ', '') AS props, json_extract(props, '$.k')::VARCHAR AS k FROM events)
SELECT event_id, 'a.p.k' AS path, k AS "left", 'null' AS "right" FROM e WHERE event_id % 3 = 0 AND k IS NOT NULL
UNION ALL SELECT event_id, 'a.x', NULL, '1' FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'l', '[1,2]', '[3]' FROM e WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'a', '{"p":' || props || ',"s":true}', '5' FROM e WHERE event_id % 3 = 1"""
)
def recursive_differences(spark, sf_dir):
    """Where the merged documents differ from what they were."""
    base, override = _documents(spark, sf_dir)
    return payloads.document_differences(base, payloads.merged_documents(base, override, "event_id", "document"), "event_id", "document")


@query(
    """SELECT event_id, CASE event_id % 8 WHEN 7 THEN NULL ELSE 's' || user_id END AS signature, CASE event_id % 8 WHEN 0 THEN 'promoted' WHEN 7 THEN NULL ELSE 'candidate' END AS status,
  CASE event_id % 8 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN floor(value)::BIGINT WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 0 END AS support_cycles,
  CASE event_id % 8 WHEN 0 THEN '1,2,3' WHEN 7 THEN NULL ELSE '' END AS ids, CASE event_id % 8 WHEN 0 THEN 'k,5' WHEN 7 THEN NULL ELSE '' END AS keys FROM events"""
)
def lenient_payloads(spark, sf_dir):
    """Stored hypotheses whose numbers are numbers, texts, fractions, booleans or missing."""
    kind = F.col("event_id") % 8
    cycles = (
        F.when(kind == 0, F.col("event_id").cast("string"))
        .when(kind == 1, F.concat(F.lit('" '), "event_id", F.lit('"')))
        .when(kind == 2, F.col("value").cast("string"))
        .when(kind == 3, '"3.5"')
        .when(kind == 4, "true")
        .when(kind == 5, "[7]")
        .otherwise("null")
    )
    lists = F.when(kind == 0, ', "status": "promoted", "support_cycle_ids": [1, "2", 3.9, "x", null], "support_ticket_keys": ["k", " ", 5]').otherwise(', "status": 0, "support_cycle_ids": "12", "support_ticket_keys": null')
    payload = F.when(kind == 7, F.concat(F.lit("["), cycles, F.lit("]"))).otherwise(F.concat(F.lit('{"signature": " s'), "user_id", F.lit('", "support_cycles": '), cycles, lists, F.lit("}")))
    h = table(spark, sf_dir, "events").select("event_id", payloads.hypothesis(payload).alias("h"))
    joined = lambda c: F.when(F.col("h").isNotNull(), F.array_join(F.col(f"h.{c}").cast("array<string>"), ","))
    return h.select("event_id", "h.signature", "h.status", "h.support_cycles", joined("support_cycle_ids").alias("ids"), joined("support_ticket_keys").alias("keys"))


@query(
    """WITH p AS (SELECT p_partkey AS annotation_id, p_size AS s FROM part)
SELECT annotation_id, 0 AS part, CASE WHEN s % 2 = 0 THEN 'poly' ELSE 'bbox_2d' END AS kind, CASE WHEN s % 2 = 0 THEN 3 ELSE 5 END AS n_points, CASE WHEN s % 2 = 0 THEN 3.0 * s WHEN s > 40 THEN 40.0 * 40 ELSE 1.0 * s * s END::DOUBLE AS size FROM p
UNION ALL SELECT annotation_id, 3, 'poly', 3, 3.0::DOUBLE FROM p WHERE s % 5 <> 0"""
)
def polygon_parts(spark, sf_dir):
    """Segmentations of parts through the SQL table function: kept, too short, odd, far outside, and capped to a clipped box."""
    tables.register(spark)
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    first = F.when(F.col("p_size") % 2 == 0, F.array(zero, zero, s, zero, s, F.lit(1.0))).otherwise(F.array(zero, zero, s, zero, s, s, zero, s, zero, zero))
    last = F.when(F.col("p_size") % 5 == 0, F.array(zero, zero, F.lit(51.0), zero, zero, F.lit(1.0))).otherwise(F.array(zero, zero, F.lit(1.0), zero, F.lit(1.0), F.lit(1.0)))
    segmentation = F.array(first, F.array(zero, zero, s, s), F.array(zero, zero, s, s, s), last)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("annotation_id"), segmentation.alias("segmentation"), F.lit(40).alias("width"), F.lit(40).alias("height")).createOrReplaceTempView("part_marks")
    found = spark.sql("SELECT * FROM polygons(TABLE(part_marks), 4)")
    point = lambda k: F.get("points", F.lit(k))
    size = F.when(F.col("kind") == "poly", F.aggregate("points", zero, lambda a, x: a + x) + point(2) - point(5)).otherwise(point(2) * point(3))
    return found.select("annotation_id", "part", "kind", "n_points", size.alias("size"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderpriority, o_custkey % 3 AS n FROM orders), i AS (SELECT o_orderpriority, o_orderkey, unnest(range(1, n + 1)) AS image_index FROM o WHERE n > 0)
SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, image_index) - 1 AS job, o_orderkey AS group_id, image_index::INTEGER AS image_index, 'm' || image_index || '.jpg' AS image FROM i"""
)
def image_jobs(spark, sf_dir):
    """Numbered image jobs per priority through the SQL table function over a partitioned table."""
    tables.register(spark)
    n = (F.col("o_custkey") % 3).cast("int")
    images = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)), lambda k: F.concat(F.lit("m"), k, F.lit(".jpg")))
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), "o_orderpriority", images.alias("images")).createOrReplaceTempView("order_images")
    return spark.sql("SELECT * FROM image_jobs(TABLE(order_images) PARTITION BY (o_orderpriority) ORDER BY (group_id), 'o_orderpriority')")


@query(
    """SELECT o_orderkey, replace(replace(replace(replace(lower(o_orderpriority), 'not specified', 'open'), 'high', 'hi'), '-', ': '), 'low', 'lo') || CASE WHEN o_orderkey % 2 = 0 THEN '简体 abd' ELSE '' END AS text FROM orders"""
)
def phrase_conversion(spark, sf_dir):
    """Priorities with phrases replaced by a table, the longest first."""
    pairs = {"NOT SPECIFIED": "open", "NOT": "never", "HIGH": "hi", "LOW": "lo", "-": ": ", "URGENT": "urgent", "MEDIUM": "medium", "繁": "简", "體": "体", "abc": "abd", "ab": "x"}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "繁體 abc").otherwise("").alias("tail"))
    known = phrases.phrase_table(spark.createDataFrame(list(pairs.items()), "phrase string, replacement string"), "phrase", "replacement")
    return rows.select("o_orderkey", phrases.converted(F.concat("o_orderpriority", "tail"), known).alias("text"))


@query(
    """SELECT 'g' || o_custkey AS group_id, o_orderpriority AS mission, string_agg(DISTINCT 'r' || o_orderkey % 5, '|' ORDER BY 'r' || o_orderkey % 5) AS reasons FROM orders
WHERE o_orderkey % 4 = 1 AND o_orderkey % 9 <> 3 GROUP BY 1, 2"""
)
def workbook_reasons(spark, sf_dir):
    """Fail reasons from workbooks written of orders, a book per status: other flags, blanks and gaps are left out."""
    key = F.col("o_orderkey")
    reason = F.when(key % 9 == 3, F.when(key % 2 == 0, " ")).otherwise(F.concat(F.lit(" r"), key % 5))
    flag = F.when(key % 4 == 1, 2).when(key % 4 == 2, 1)
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.concat(F.lit("g"), "o_custkey").alias("g"), F.lit(None).cast("string").alias("none"), "o_orderpriority", reason.alias("r"), flag.alias("flag"))
    books = staged(workbook.workbooks(rows, "o_orderstatus", "o_orderkey", ["g", "none", "o_orderpriority", "none", "o_orderkey", "r", "flag"]), "books")
    found = workbook.fail_reasons(workbook.workbook_rows(books.withColumnRenamed("o_orderstatus", "path")))
    return found.select("group_id", "mission", F.array_join("reasons", "|").alias("reasons"))


@query(
    """SELECT count(*) FILTER (p_size % 4 <> 0) AS total_images, sum(p_size % 3) FILTER (p_size % 4 <> 0)::BIGINT AS total_objects, count(*) FILTER (p_size % 4 = 0) AS skipped_images, count(*) FILTER (p_type = 'ECONOMY') AS economy,
  count(*) FILTER (p_size % 4 <> 0) AS rows FROM part"""
)
def conversion_counts(spark, sf_dir):
    """Parts converted to records with boxes: the counts that the writing pass left beside them, and the rows written."""

    def sample(rows):
        box = F.struct(F.array(F.lit(0), F.lit(0), F.col("p_size"), F.lit(1)).alias("bbox_2d"), F.col("p_type").alias("desc"))
        return rows.select(F.array("p_name").alias("images"), F.array_repeat(box, (F.col("p_size") % 3).cast("int")).alias("objects"), "p_type", (F.col("p_size") % 4 != 0).alias("keep"))

    path = shared_path(spark, "converted")
    converter.convert(table(spark, sf_dir, "part"), sample, path, counts={"economy": F.count_if(F.col("p_type") == "ECONOMY")})
    stats = spark.read.schema("total_images bigint, total_objects bigint, skipped_images bigint, economy bigint").json(f"{path}_stats")
    return stats.crossJoin(spark.read.text(path).agg(F.count(F.lit(1)).alias("rows")))
