"""Routing of missions, irrelevant pictures, predicates on summaries, built summaries, vocabularies, reports and entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import jsonx, records
from granary.operators import annotations, routing, summaries
from granary.plans.registry import query, table
from granary.session import shared_path
from granary.sources import sinks


@query(
    """WITH o AS (SELECT *, CASE o_orderpriority[1:1] WHEN '1' THEN 'BBU接地线检查' WHEN '2' THEN 'RRU线缆' WHEN '3' THEN 'RRU安装检查' ELSE '挡风板安装检查' END AS mission FROM orders)
SELECT o_orderkey, mission, CASE WHEN mission IN ('RRU线缆', 'RRU安装检查') THEN 'rru' ELSE 'bbu' END AS domain FROM o WHERE o_orderkey % 7 <> 3 AND NOT (o_custkey % 5 = 0 AND o_orderstatus = 'O')"""
)
def domain_routing(spark, sf_dir):
    """Tickets without those that a list and a table name, with the domain of their mission by a map and its default."""
    first = F.left("o_orderpriority", F.lit(1))
    mission = F.when(first == "1", "BBU接地线检查").when(first == "2", "RRU线缆").when(first == "3", "RRU安装检查").otherwise("挡风板安装检查")
    orders = table(spark, sf_dir, "orders")
    ticket = F.concat(F.col("o_custkey") % 5, F.lit("::"), "o_orderstatus")
    tickets = orders.select("o_orderkey", mission.alias("mission"), F.when(F.col("o_orderkey") % 7 == 3, F.concat(F.lit("k"), F.col("o_orderkey") % 7)).otherwise(ticket).alias("ticket"))
    listed = orders.where("o_custkey % 5 = 0 AND o_orderstatus = 'O'").select(F.concat(F.lit(" "), ticket, F.lit(" ")).alias("key"))
    kept = routing.without_tickets(tickets, [" k3 ", ""], listed)
    domains = {"RRU线缆": " RRU ", "RRU安装检查": "rru"}
    return kept.select("o_orderkey", routing.known_mission(F.col("mission")).alias("mission"), routing.domain_of(F.col("mission"), domains, "BBU").alias("domain"))


@query(
    """WITH p AS (SELECT p_partkey, 100 + p_size * 32 AS w, 64 * (1 + p_partkey % 9) AS h FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 9)
SELECT 'set/' || p_partkey || '.JPG' AS image, 'irrelevant' AS label, '无关图片' AS summary, (w - 4)::BIGINT AS width, h::BIGINT AS height, 4 AS corners FROM p"""
)
def irrelevant_records(spark, sf_dir):
    """Records of pictures without relevance; other files and unreadable pictures are left out."""
    key = F.col("p_partkey")
    path = F.concat(F.lit("set/"), key, F.when(key % 4 == 0, ".gif").otherwise(".JPG"))
    width = F.when(key % 10 == 9, F.when(key % 20 == 9, 40000)).otherwise(100 + F.col("p_size") * 32)
    height = F.when(key % 10 == 9, 64).otherwise(64 * (1 + key % 9))
    made = routing.irrelevant_records(table(spark, sf_dir, "part").select(path.alias("path"), width.alias("width"), height.alias("height")))
    first = F.get("objects", F.lit(0))
    fits = (F.get(first["bbox_2d"], F.lit(2)) == F.col("width")) & (F.get(first["bbox_2d"], F.lit(3)) == F.col("height"))
    return made.where(fits).select(F.get("images", F.lit(0)).alias("image"), first["desc"].alias("label"), "summary", "width", "height", F.size(first["bbox_2d"]).alias("corners"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id || ',7' WHEN 1 THEN '3' ELSE '' END AS distances, event_id % 6 IN (1, 2, 5) AS readable FROM events"""
)
def summary_predicates(spark, sf_dir):
    """Distances and legible labels that summaries state: by either key, unreadable, blank, as plain text, called missing."""
    key = F.col("event_id") % 6
    wrap = lambda *entries: F.concat(F.lit('{"统计": ['), *[F.lit(e) if isinstance(e, str) else e for e in entries], F.lit("]}"))
    said = (
        F.when(key == 0, wrap('{"类别": "站点距离", "站点距离": {"', F.col("user_id").cast("string"), '": 2, "远": 1, "7": 1}}, {"类别": "标签", "可读性": {"不可读": 2}}'))
        .when(key == 1, wrap('{"类别": "站点距离", "站点距离": 4, "距离": {"3": 1}}, {"类别": "标签", "文本": {"A1": 1}}'))
        .when(key == 2, wrap('{"类别": "标签", "文本": {" ": 1}, "可读性": {"可读": 1, "不可读": 1}}'))
        .when(key == 3, wrap('{"类别": "标签", "文本": {" ": 1}, "可读性": {" ": 1}}'))
        .when(key == 4, "标签/A1,无法识别")
        .otherwise("标签/A1")
    )
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("s"), jsonx.document(said).alias("doc"))
    return rows.select("event_id", F.coalesce(F.array_join(routing.summary_distances(F.col("doc")), ","), F.lit("")).alias("distances"), routing.has_readable_label(F.col("s")).alias("readable"))


@query(
    """SELECT doc_id, source AS dataset, source || '!' AS user, CASE WHEN source = (SELECT min(source) FROM documents) THEN 'summary' ELSE 'dense' END AS mode, true AS own_system, false AS augment FROM documents WHERE source = (SELECT min(source) FROM documents)"""
)
def evaluation_split(spark, sf_dir):
    """The first source as evaluation rows with the prompts of its policy, not augmented."""
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("source")).first()[0]
    policies = docs.where("source is not null").select(F.col("source").alias("dataset")).distinct()
    policies = policies.withColumns({"mode": F.when(F.col("dataset") == first, "summary").otherwise("dense"), "system": F.lit("s"), "user": F.concat("dataset", F.lit("!")), "augmented": F.lit(True)})
    rows = routing.evaluation_rows(docs.select("doc_id", F.col("source").alias("dataset")), policies, first, clean=True)
    own = (F.col("system_summary") == "s") & F.col("system_dense").isNull() & (F.col("user_summary") == F.col("user"))
    return rows.select("doc_id", "dataset", "user", "mode", own.alias("own_system"), "augment")


@query(
    """WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, CASE l_linenumber % 3 WHEN 0 THEN '标签' ELSE '电线' END AS c, l_returnflag AS f, 'r' || l_suppkey % 3 AS r FROM lineitem),
v AS (SELECT o, c, f, count(*) AS n, min(i) AS i FROM l GROUP BY ALL), e AS (SELECT o, c, '{"类别": "' || c || '", "属性": {' || string_agg('"' || f || '": ' || n, ', ' ORDER BY i) || '}}' AS e FROM v GROUP BY 1, 2),
s AS (SELECT o, string_agg(e, ', ' ORDER BY c) AS s FROM e GROUP BY 1), r AS (SELECT o, r, min(i) AS i FROM l GROUP BY 1, 2), q AS (SELECT o, string_agg('"' || r || '"', ', ' ORDER BY i) AS q FROM r GROUP BY 1)
SELECT o AS l_orderkey, CASE WHEN o % 7 > 2 THEN '{"统计": [' || s || '], "备注": [' || q || ']}' END AS summary, CASE o % 7 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS n_invalid, CASE o % 7 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_unknown, CASE o % 7 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_conflict FROM s JOIN q USING (o)"""
)
def built_summaries(spark, sf_dir):
    """Summaries of orders from their lines' descriptions, values and remarks in the order in which they come; three kinds of faults."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    category = F.when(F.col("l_linenumber") % 3 == 0, "标签").otherwise("电线")
    fault = F.when(F.col("place") > 1, "").otherwise(F.element_at(F.array(F.lit(",=x"), F.lit(""), F.lit(",y=合格|不合格"), *[F.lit("")] * 4), (F.col("l_orderkey") % 7 + 1).cast("int")))
    rows = table(spark, sf_dir, "lineitem").withColumn("place", place)
    named = F.when((F.col("l_orderkey") % 7 == 1) & (F.col("place") == 1), "外星").otherwise(category)
    desc = F.concat(F.lit("类别="), named, F.lit(" , 属性 ="), "l_returnflag", F.lit("|,备注=r"), F.col("l_suppkey") % 3, fault)
    return summaries.built(rows.select("l_orderkey", "place", desc.alias("desc")), "l_orderkey", "place", "desc")


@query(
    """WITH p AS (SELECT p_partkey, p_size % 4 AS k, p_type AS t, p_size AS s FROM part), d AS (SELECT *, CASE k WHEN 0 THEN '类别=' || t || ',属性=' || s || ',备注=a,b' WHEN 1 THEN '标签/' || t || '/x/y' WHEN 2 THEN 'stray,类别=' || t END AS d FROM p),
a AS (SELECT 'full_descriptions' AS kind, d AS label FROM d WHERE d IS NOT NULL UNION SELECT 'object_types', CASE k WHEN 1 THEN '标签' ELSE t END FROM d WHERE k < 3 UNION SELECT 'properties', CASE k WHEN 0 THEN s::VARCHAR ELSE t END FROM d WHERE k < 2
  UNION SELECT 'extra', CASE k WHEN 0 THEN 'a,b' WHEN 1 THEN 'x/y' ELSE 'stray' END FROM d WHERE k < 3),
u AS (SELECT kind, label FROM a WHERE kind <> 'extra' UNION SELECT 'all_unique_labels', label FROM a WHERE kind <> 'full_descriptions'
  UNION SELECT 'unique_labels_excluded_tag', unnest(CASE k WHEN 0 THEN [t, s::VARCHAR, 'a,b'] WHEN 2 THEN [t, 'stray'] ELSE [] END) FROM d)
SELECT kind, label FROM u"""
)
def label_vocabulary(spark, sf_dir):
    """Samples written by part with their vocabulary, statistics and invalid rows beside them; the vocabulary read back, and as one document."""
    kind, size = F.col("p_size") % 4, F.col("p_size")
    desc = F.when(kind == 0, F.concat(F.lit("类别="), "p_type", F.lit(",属性="), size, F.lit(",备注=a,b"))).when(kind == 1, F.concat(F.lit("标签/"), "p_type", F.lit("/x/y"))).when(kind == 2, F.concat(F.lit("stray,类别="), "p_type"))
    parts = table(spark, sf_dir, "part")
    samples = parts.select("p_partkey", F.array(F.struct(desc.alias("desc")), F.struct(F.lit(None).cast("string").alias("desc"))).alias("objects"), F.when(size % 5 == 0, "val").otherwise("train").alias("part"))
    path = shared_path(spark, "outputs")
    stats = sinks.write_outputs(samples, path, invalid=parts.where("p_size < 3"))
    rows = sinks.read_vocabulary(spark, f"{path}/vocabulary")
    # The same as one document, kept where the statistics count as many labels of the kind.
    entry = F.map_from_entries(F.collect_list(F.struct("kind", "labels"))).alias("vocabulary")
    rows.groupBy("kind").agg(F.sort_array(F.collect_list("label")).alias("labels")).agg(entry).write.json(f"{path}/document")
    counted = stats.select(F.col("name").alias("kind"), "n")
    document = sinks.read_vocabulary(spark, f"{path}/document", document=True)
    sized = document.groupBy("kind").agg(F.count(F.lit(1)).alias("m")).join(counted, "kind").where("n = m").select("kind")
    return document.join(rows, ["kind", "label"], "left_semi").join(sized, "kind", "left_semi")


@query(
    """SELECT c_custkey AS "编号", c_name AS "名称", true AS marked FROM customer"""
)
def csv_report(spark, sf_dir):
    """A report with a byte order mark in every file, read back by names."""
    path = shared_path(spark, "report")
    sinks.write_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("编号"), F.col("c_name").alias("名称")), path, mark=True)
    marked = spark.read.format("binaryFile").load(path).agg(F.bool_and(F.startswith("content", F.lit(b"\xef\xbb\xbf"))).alias("marked"))
    back = spark.read.option("header", True).schema("`编号` bigint, `名称` string").csv(path)
    return back.crossJoin(F.broadcast(marked))


@query(
    """SELECT coalesce(b.s, o.s) AS name, coalesce(o.x, b.x) AS x, CASE WHEN b.s IS NULL THEN 1 ELSE 0 END AS appended, coalesce(b.s, o.s) AS ordinal FROM (SELECT s_suppkey AS s, 'b' || s_nationkey AS x FROM supplier WHERE s_suppkey % 3 <> 0) b
FULL JOIN (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 4 <> 0 THEN 'o' || s_nationkey END AS x FROM supplier WHERE s_suppkey % 2 = 0) o ON b.s = o.s"""
)
def entry_merge(spark, sf_dir):
    """Entries merged by name: overrides win where they have a value, new ones come behind."""
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    side = lambda of, x: s.where(of).select(key.alias("name"), key.alias("ordinal"), x.alias("x"))
    base = side(key % 3 != 0, F.concat(F.lit("b"), "s_nationkey"))
    override = side(key % 2 == 0, F.when(key % 4 != 0, F.concat(F.lit("o"), "s_nationkey")))
    merged = annotations.merged_entries(base, override)
    return merged.select("name", "x", F.col("position")[merged.schema["position"].dataType.names[0]].alias("appended"), "position.ordinal")


@query(
    """SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role = 'assistant' THEN '<DOMAIN=' || CASE WHEN conv_id % 2 = 0 THEN 'BBU' ELSE 'RRU' END || '>, <TASK=SUMMARY>' || chr(10) ELSE NULL END AS prefix,
  CASE WHEN conv_id % 5 = 0 THEN 'own' WHEN conv_id % 5 = 1 THEN 'template' ELSE 'default' END AS prompt FROM conversations"""
)
def chat_clean(spark, sf_dir):
    """Turns with the station distance cut out, the answer's prefix, and the prompt that comes first: own, template's, default."""
    key = F.col("conv_id")
    said = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((key % 3 == 0) & (F.col("role") == "user"), F.concat(F.lit("站点距离=3\n"), said, F.lit("\n站点距离：4"))).otherwise(said).alias("text"))
    own, template = F.when(key % 5 == 0, "own").when(key % 5 == 1, ""), F.when(key % 5 < 2, "template")
    tidy = F.when((key % 3 == 0) & (F.col("role") == "user"), records.without_distance(F.col("text"))).otherwise(F.col("text"))
    domain = F.when(key % 2 == 0, "BBU").otherwise("RRU")
    prefix = F.when(F.col("role") == "assistant", records.assistant_prefix(domain, F.lit("SUMMARY")))
    return turns.select("conv_id", "turn", "role", tidy.alias("text"), prefix.alias("prefix"), records.prompt_for(own, template, "default").alias("prompt"))
