"""Sources and sinks: the driver's tables written out in other forms, with faults, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.session import shared_path, staged
from granary.sources import images, jsonl, sinks

SCHEMA = "doc_id bigint, text string, n_chars bigint"


def _lines(spark, sf_dir) -> str:
    """Documents as JSON lines: some cut off, some blank, some lists of numbers or of objects."""
    row, kind = F.to_json(F.struct("doc_id", "text", "n_chars")), F.col("doc_id") % 11
    line = F.when(kind == 3, F.expr("left(row, length(row) - 1)")).when(kind == 5, "").when(kind == 7, F.concat(F.lit("["), "doc_id", F.lit("]"))).when(kind == 9, F.concat(F.lit("["), "row", F.lit(", "), "row", F.lit("]"))).otherwise(F.col("row"))
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "documents").withColumn("row", row).select(line.alias("value")).write.text(path)
    return path


@query("SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 11 NOT IN (3, 5, 7, 9)")
def jsonl_lenient(spark, sf_dir):
    return jsonl.read(spark, _lines(spark, sf_dir), SCHEMA)


@query("SELECT CASE doc_id % 11 WHEN 3 THEN 'cut' ELSE 'list' END AS fault, count(*) AS n FROM documents WHERE doc_id % 11 IN (3, 7, 9) GROUP BY 1")
def jsonl_quarantine(spark, sf_dir):
    bad = F.col(jsonl.CORRUPT)
    fault = F.when(F.startswith(bad, F.lit("{")), "cut").otherwise("list")
    found = jsonl.read(spark, _lines(spark, sf_dir), SCHEMA, "quarantine").where(bad.isNotNull()).groupBy(fault.alias("fault"))
    return found.agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey // 500 AS file, row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) AS line FROM orders)
SELECT file, line::BIGINT AS line, CASE WHEN o_orderkey % 37 = 1 THEN 'malformed' ELSE 'kind' END AS fault FROM o WHERE o_orderkey % 37 IN (1, 2)"""
)
def jsonl_faults(spark, sf_dir):
    """Orders as JSON lines, a file per 500 keys in their order, with faults at known lines: every fault's file and line."""
    kind, key = F.col("o_orderkey") % 37, F.col("o_orderkey")
    row = F.to_json(F.struct("o_orderkey", "o_orderpriority"))
    line = F.when(kind == 1, F.concat(F.lit("{"), row)).when(kind == 2, F.concat(F.lit("["), row, F.lit("]"))).when(kind == 3, "").otherwise(row)
    path = shared_path(spark, "faults")
    rows = table(spark, sf_dir, "orders").select((key / 500).cast("bigint").alias("file"), key.alias("k"), line.alias("value"))
    # All rows of a file lie in one task, which writes them in their order to one file.
    rows.repartition("file").sortWithinPartitions("file", "k").drop("k").write.partitionBy("file").text(path)
    found = jsonl.faults(spark, path, "o_orderkey bigint, o_orderpriority string")
    return found.select(F.regexp_extract("path", r"/file=([0-9]+)/", 1).cast("bigint").alias("file"), "line", "fault")


@query(
    """WITH o AS (SELECT *, o_orderkey % 7 AS k FROM orders)
SELECT 'g' || o_orderkey || '::' || CASE k WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'pass' END AS ticket, CASE WHEN o_custkey % 2 = 0 THEN 'RRU' ELSE 'BBU' END || o_orderpriority AS mission, 2 AS n_images,
  CASE WHEN o_custkey % 2 = 0 THEN '{"统计": [{"类别": "站点距离", "n": 5}, {"类别": "BBU"}], "备注": ["站点距离=5"]}/ten, {"类别": "站点距离"}, end' ELSE '{"统计": [{"类别": "BBU"}], "备注": ["=5"]}/ten, end' END AS texts,
  CASE WHEN k <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, NULL::VARCHAR AS reason FROM o WHERE k IN (0, 1, 6)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE k WHEN 2 THEN 'label' WHEN 3 THEN 'images' WHEN 4 THEN 'texts' ELSE 'malformed' END FROM o WHERE k IN (2, 3, 4, 5)"""
)
def ticket_ingest(spark, sf_dir):
    """Inspection tickets, good and with each kind of fault."""
    kind = F.col("o_orderkey") % 7
    label = F.get(F.array(*[F.lit(x) for x in ("审核通过", " FAIL", "?", "pass", "pass", "pass", "1")]), kind.cast("int"))
    images = F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.jpg"), F.lit("b.jpg")))
    texts = F.when(kind == 4, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("image_10"), F.lit('ten, {"类别": "站点距离"}, end'), F.lit("图片_2"), F.lit('{"统计": [{"类别": "站点距离", "n": 5}, {"类别": "BBU"}], "备注": ["站点距离=5"]}')))
    stamp = F.when(kind == 1, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    fields = {"group_id": F.concat(F.lit("g"), "o_orderkey"), "mission": F.concat(F.when(F.col("o_custkey") % 2 == 0, "RRU").otherwise("BBU"), "o_orderpriority"), "label": label, "images": images, "per_image": texts, "label_timestamp": stamp}
    row = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    path = shared_path(spark, "tickets")
    rows = table(spark, sf_dir, "orders").withColumn("row", row)
    rows.select(F.when(kind == 5, F.expr("left(row, 20)")).otherwise(F.col("row")).alias("value")).write.text(path)
    found = jsonl.judged_tickets(spark, [path, f"{path}-of-yesterday"], require=True)
    n_images = F.when(F.col("reason").isNull(), F.size("images"))
    return found.select("ticket", "mission", n_images.alias("n_images"), F.array_join("texts", "/").alias("texts"), F.date_format("labelled_at", "yyyy-MM-dd").alias("day"), "reason")


@query(
    """SELECT s_suppkey AS annotation_id, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'n/' WHEN 1 THEN 'own/' ELSE 'coco/' END || n_nationkey || '.jpg' AS file_name, (s_suppkey % 50 + 1)::DOUBLE AS width FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def coco_read(spark, sf_dir):
    """A detection file with three collections, joined again."""
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    number = F.col("n_nationkey").cast("string")
    kind = F.col("n_nationkey") % 3
    named = lambda k, folder: F.when(kind >= k, F.concat(F.lit(folder), number, F.lit(".jpg")))
    images = nations.select(F.struct(F.col("n_nationkey").alias("id"), named(2, "coco/").alias("coco_file_name"), named(1, "own/").alias("file_name"), F.concat(F.lit("http://host/n/"), number, F.lit(".jpg")).alias("coco_url"), F.lit(640).alias("width"), F.lit(480).alias("height")).alias("x"))
    categories = nations.select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("f").alias("frequency")).alias("x"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("s_suppkey") % 50 + 1.0, F.lit(2.0))
    marks = suppliers.select(F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("image_id"), F.col("s_nationkey").alias("category_id"), box.alias("bbox")).alias("x"))
    one = lambda rows, name: rows.agg(F.collect_list("x").alias(name))
    path = shared_path(spark, "coco")
    one(images, "images").join(one(marks, "annotations")).join(one(categories, "categories")).write.json(path)
    i, a, c = jsonl.read_coco(spark, path)
    joined = a.join(i.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(c.select(F.col("id").alias("category_id"), "name"), "category_id")
    return joined.select(F.col("id").alias("annotation_id"), "name", "file_name", F.get("bbox", F.lit(2)).alias("width"))


def _bytes(number, size: int):
    """A number as so many bytes, the high ones first."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 2 * size, "0"))


@query(
    """WITH p AS (SELECT page_id, 16 + page_id * 37 % 4000 AS w, 16 + page_id * 53 % 3000 AS h, page_id % 5 = 0 AS png, CASE WHEN page_id % 5 = 0 OR page_id % 9 = 0 THEN 1 ELSE page_id % 9 END AS o FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 4 THEN NULL WHEN png THEN 'png' ELSE 'jpeg' END AS kind, CASE WHEN page_id % 11 <> 4 THEN o::INTEGER END AS orientation,
  CASE WHEN page_id % 11 <> 4 THEN (CASE WHEN o >= 5 THEN h ELSE w END)::INTEGER END AS image_width, CASE WHEN page_id % 11 <> 4 THEN (CASE WHEN o >= 5 THEN w ELSE h END)::INTEGER END AS image_height,
  CASE WHEN page_id % 7 = 1 THEN 'json' WHEN page_id % 7 = 2 THEN 'size' WHEN page_id % 7 = 3 THEN 'data' END AS fault FROM p WHERE page_id % 13 <> 0
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, CASE WHEN page_id % 7 = 1 THEN 'json' WHEN page_id % 7 = 2 THEN 'size' WHEN page_id % 7 = 3 THEN 'data' ELSE 'image' END FROM p WHERE page_id % 13 = 0"""
)
def image_scan(spark, sf_dir):
    """Image heads made of pages (both byte orders, segments before the frame, PNG, junk) beside annotation files with faults."""
    pages, key = table(spark, sf_dir, "pages"), F.col("page_id")
    w, h, turn = 16 + key * 37 % 4000, 16 + key * 53 % 3000, key % 9
    short = lambda x: F.when(key % 2 == 0, _bytes(x, 2)).otherwise(F.concat(_bytes(x % 256, 1), _bytes(F.floor(x / 256), 1)))
    long = lambda x: F.when(key % 2 == 0, _bytes(x, 4)).otherwise(F.concat(short(x), F.lit(bytes(2))))
    tiff = F.concat(F.when(key % 2 == 0, F.lit(b"MM\0*")).otherwise(F.lit(b"II*\0")), long(F.lit(8)), short(F.lit(2)), short(F.lit(0x0100)), F.lit(bytes(10)), short(F.lit(0x0112)), short(F.lit(3)), long(F.lit(1)), short(turn), F.lit(bytes(2)))
    segment = lambda marker, body: F.concat(F.lit(bytes([0xFF, marker])), _bytes(F.octet_length(body) + 2, 2), body)
    page = F.encode(F.left("html", F.lit(5000)), "UTF-8")
    exif = F.when(turn == 0, F.lit(b"")).otherwise(segment(0xE1, F.concat(F.lit(b"Exif\0\0"), tiff)))
    frame = F.concat(F.lit(b"\xff\xff\xc2\x00\x11\x08"), _bytes(h, 2), _bytes(w, 2), page)
    more = F.when(key % 3 == 0, segment(0xE2, F.concat(page, F.lit(b"\xff\xc0")))).otherwise(F.lit(b""))
    jpeg = F.concat(F.lit(b"\xff\xd8"), segment(0xE0, F.lit(b"JFIF")), more, exif, more, frame)
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR"), _bytes(w, 4), _bytes(h, 4), page)
    content = F.when(key % 11 == 4, page).when(key % 5 == 0, png).otherwise(jpeg)
    stem = F.concat(F.lit("set/"), key, F.lit(".v1"))
    # Some have a second image, whose ending comes later.
    endings = F.when(key % 2 == 0, F.array(F.lit(".jpeg"), F.lit(".jpg"))).otherwise(F.array(F.lit(".jpg")))
    files = pages.where(key % 13 != 0).select(F.explode(endings).alias("ending"), "*").select(F.concat(stem, "ending").alias("path"), "page_id", F.when((key % 2 == 0) & (F.col("ending") == ".jpg"), F.lit(b"GIF")).otherwise(content).alias("content"))
    info = F.when(key % 7 == 2, '{"width": 3}').otherwise('{"width": 3, "height": null}')
    data = F.when(key % 7 == 3, '"dataList": 5').when(key % 7 == 4, '"markResult": {"features": []}').otherwise('"dataList": [{}]')
    text = F.when(key % 7 == 1, "[5]").otherwise(F.concat(F.lit('{"info": '), info, F.lit(", "), data, F.lit("}")))
    found = images.with_images(pages.select(F.concat(stem, F.lit(".json")).alias("path"), text.alias("text")), images.image_heads(staged(files, "images")).drop("page_id"))
    page_id = F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("bigint").alias("page_id")
    kinds = images.image_heads(files).select(F.col("path").alias("image_path"), "kind")
    return found.join(kinds, "image_path", "left").select(page_id, "kind", "orientation", "image_width", "image_height", "fault")


@query("SELECT DISTINCT event_type || '-' || user_id % 20 AS key FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def key_lists(spark, sf_dir):
    """Keys written a list per category, one list read back."""
    events = table(spark, sf_dir, "events")
    keys = events.select("event_type", F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("key"))
    path = shared_path(spark, "keys")
    sinks.write_keys(keys, path, "event_type", "key")
    first = events.agg(F.min("event_type")).first()[0]
    return jsonl.read_keys(spark, f"{path}/event_type={first}")


@query("SELECT o_orderkey, o_orderstatus, 3 AS version FROM orders")
def table_versions(spark, sf_dir):
    """Three versions of a table, of which two are kept, then one whose writer died before the pointer was switched."""
    root = shared_path(spark, "versions")
    for number in (1, 2, 3):
        sinks.write_version(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(number).alias("version")), root, keep=2)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(4).alias("version")).write.parquet(f"{root}/v00000004")
    return sinks.read_version(spark, root)


@query("SELECT o_orderkey + 100 AS o_orderkey, o_orderstatus FROM orders")
def table_replace(spark, sf_dir):
    """A table replaced by one made from itself."""
    path = shared_path(spark, "replace")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.json(path)
    old = spark.read.schema(orders.schema).json(path)
    sinks.replace(old.withColumn("o_orderkey", F.col("o_orderkey") + 100), path)
    return spark.read.schema(orders.schema).json(path)


@query("SELECT doc_id % 3 = 0 AS held_out, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def split_files(spark, sf_dir):
    """One pass into a folder of JSON lines per split; nulls and non-ASCII texts survive."""
    path = shared_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "val").otherwise("train").alias("part"))
    sinks.write_splits(docs, path)
    back = spark.read.schema("doc_id bigint, text string, part string").json(path)
    return back.groupBy((F.col("part") == "val").alias("held_out")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
