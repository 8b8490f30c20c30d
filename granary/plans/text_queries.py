"""Texts, JSON, chats and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import jsonx, numeric, text
from granary.operators import ordering, profiles, summary_scores
from granary.plans.registry import query, table

DESC = "类别={t}/a,品牌={b}, 备注 = {n}"


def _descriptions(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    desc = F.concat(F.lit("类别="), "p_type", F.lit("/a,品牌="), "p_brand", F.lit(",stray, 备注 = "), "p_name", F.lit("=x"))
    return parts.select("p_partkey", "p_type", "p_brand", "p_name", desc.alias("desc"))


@query("SELECT p_partkey, 3 AS n_pairs, '类别' AS k1, replace(p_type, ' ', '') || '/a' AS v1, replace(p_name, ' ', '') || '=x' AS remark, replace(p_brand, ' ', '') AS brand, p_type AS head FROM part")
def kv_parse(spark, sf_dir):
    pairs = text.kv_pairs(F.col("desc"))
    rows = _descriptions(spark, sf_dir).select("p_partkey", pairs.alias("pairs"), "desc")
    return rows.select(
        "p_partkey",
        F.size("pairs").alias("n_pairs"),
        F.get("pairs", F.lit(0))["k"].alias("k1"),
        F.get("pairs", F.lit(0))["v"].alias("v1"),
        text.kv_first(F.col("pairs"), text.REMARK).alias("remark"),
        F.element_at(text.kv_map(F.col("pairs")), "品牌").alias("brand"),
        text.head(F.col("desc")).alias("head"),
    )


@query("SELECT p_partkey, '类别=' || p_type || '/a,品牌=' || p_brand || ',备注 = ' || p_name || '=x,备注=stray' AS folded, '类别=' || p_type || '/a,品牌=' || p_brand || ', 备注 = ' || p_name || '=x' AS dropped FROM part")
def kv_rewrite(spark, sf_dir):
    return _descriptions(spark, sf_dir).select("p_partkey", text.fold_stray(F.col("desc")).alias("folded"), text.drop_tokens(F.col("desc"), "stray").alias("dropped"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\s　]+', '', 'g'))::INT AS n_bare, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS short FROM documents")
def text_sanitize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.char_length(text.strip_all_blanks(F.col("text"))).alias("n_bare"), text.shorten(F.col("text"), 40).alias("short"))


@query(r"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY regexp_replace(lower(text), '[\p{P}\p{S}\s]+', '', 'g')")
def signature_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(text.signature(F.col("text")).alias("sig")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("sig")


RULES = {"mail": "[a-z]@[a-z]", "number": "[0-9]{3}", "license": "(?i)license", "table": r" \| "}


@query(
    r"""WITH c AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[a-z]@[a-z]') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' END, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN regexp_matches(text, ' \| ') THEN 'table' END], lambda x: x IS NOT NULL) AS c FROM documents)
SELECT unnest(CASE WHEN len(c) = 0 THEN ['other'] ELSE c END) AS category, count(*) AS n FROM c GROUP BY 1"""
)
def multi_category(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(text.categories(F.col("text"), RULES)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN -1 ELSE (json_extract_string(props, '$.k'))::BIGINT END AS k FROM events")
def json_extract(spark, sf_dir):
    """Objects alone, behind a prefix, on a line among others, in a fence, cut off, and two of them."""
    props, kind = F.col("props"), F.col("event_id") % 6
    said = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("result: "), props)).when(kind == 2, F.concat(F.lit("so\n  "), props, F.lit("\nend")))
    said = said.when(kind == 3, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 4, F.expr("left(props, length(props) - 1)"))
    found = jsonx.object_in(said.otherwise(F.concat(props, F.lit('\n{"k": -1}'))))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("bigint").alias("k"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant(spark, sf_dir):
    return ordering.last_message(table(spark, sf_dir, "conversations"))


@query(
    """WITH v AS (SELECT o_orderkey, o_orderpriority AS r, CASE o_orderkey % 9 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 8 THEN 'pass' END AS verdict FROM orders)
SELECT o_orderkey, verdict IS NOT NULL AS format_ok, verdict, CASE WHEN verdict IS NOT NULL THEN r END AS reason FROM v"""
)
def verdict_parse(spark, sf_dir):
    """Two good lines in several dresses; a third line, no reason, an unknown word, lines turned round, one line."""
    kind, r = F.col("o_orderkey") % 9, F.col("o_orderpriority")
    shapes = {0: ("Verdict: 通过\nReason: ", ""), 1: ("\nVERDICT： FAIL\n\nReason： ", " \n"), 2: ("verdict:2\nreason:", ""), 3: ("Verdict: pass\nReason: ", "\nmore"), 4: ("Verdict: pass\nBecause: ", "")}
    shapes |= {5: ("Verdict: maybe\nReason: ", ""), 6: ("Reason: ", "\nVerdict: pass"), 7: ("Verdict: pass ", ""), 8: ("Verdict: 审核通过 \n \nReason: ", "")}
    said = F.lit(None).cast("string")
    for k, (before, after) in shapes.items():
        said = F.when(kind == k, F.concat(F.lit(before), r, F.lit(after))).otherwise(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.verdict_of(said).alias("v")).select("o_orderkey", "v.*")


@query(r"SELECT doc_id, CASE WHEN strpos(text, '.') = 0 AND strpos(text, ',') = 0 THEN text ELSE left(text, least(CASE strpos(text, '.') WHEN 0 THEN 1000000 ELSE strpos(text, '.') END, CASE strpos(text, ',') WHEN 0 THEN 1000000 ELSE strpos(text, ',') END)::INT - 1) END AS cut FROM documents")
def truncate_at(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_at(F.col("text"), (".", ",")).alias("cut"))


@query("SELECT c_custkey, regexp_extract(c_name, '[0-9]+') AS digits, regexp_extract(c_name, '[0-9]+')::BIGINT AS number FROM customer")
def first_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.first_digits(F.col("c_name")).alias("digits"), text.first_int(F.col("c_name")).alias("number"))


@query("SELECT p_partkey, 'img' || p_partkey || '.jpg' AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey)::INT AS rank FROM part")
def natural_order(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("name"))
    return ordering.ranked_per_group(parts, ["p_type"], [text.natural_key(F.col("name"))], 1 << 30).drop("p_type")


LABELS = ("pass", "FAIL ", " 1", "2", "通过", "审核不通过", "审核通过 ", "不通过", "passed", "", "0", "未通过")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 IN (0, 2, 4, 6) THEN 'pass' WHEN o_orderkey % 13 IN (1, 3, 5, 7) THEN 'fail' END AS label FROM orders")
def label_normalize(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("o_orderkey") % 13).cast("int"))  # 12: null
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normal_label(raw).alias("label"))


@query(
    """WITH b AS (SELECT p_partkey, p_size * 37 AS h, p_partkey % 700 + 20 AS w FROM part), r AS (SELECT *, greatest(28, (round_even(h / 28, 0) * 28)::BIGINT) AS rh, greatest(28, (round_even(w / 28, 0) * 28)::BIGINT) AS rw, sqrt(h * w / 500000.0) AS shrink, sqrt(3136.0 / (h * w)) AS grow FROM b)
SELECT p_partkey, CASE WHEN greatest(h, w) / least(h, w) > 50 THEN NULL WHEN rh * rw > 500000 THEN greatest(28, floor(h / shrink / 28)::BIGINT * 28) WHEN rh * rw < 3136 THEN ceil(h * grow / 28)::BIGINT * 28 ELSE rh END AS height,
CASE WHEN greatest(h, w) / least(h, w) > 50 THEN NULL WHEN rh * rw > 500000 THEN greatest(28, floor(w / shrink / 28)::BIGINT * 28) WHEN rh * rw < 3136 THEN ceil(w * grow / 28)::BIGINT * 28 ELSE rw END AS width FROM r"""
)
def smart_resize(spark, sf_dir):
    sides = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).alias("h"), (F.col("p_partkey") % 700 + 20).alias("w"))
    size = numeric.smart_resize(F.col("h"), F.col("w"), 28, 3136, 500_000, 50.0)
    return sides.select("p_partkey", size.alias("s")).select("p_partkey", "s.height", "s.width")


def _summaries(spark, sf_dir):
    """A generated and a reference summary per order, from its odd and even lines; the order's number tells what is wrong with it."""
    # Dealt by order once, for all of the groupings below.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey").repartition("l_orderkey")
    flag, status, kind = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_orderkey") % 12
    category = F.when(flag == "A", "光纤").when(flag == "N", "标签").otherwise("电线")
    facts = lines.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("half"), category.alias("c"), F.when(status == "O", "捆扎").otherwise("文本").alias("a"), F.concat(F.lit("v "), (F.col("l_partkey") % 5).cast("string")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    values = facts.groupBy("l_orderkey", "half", "c", "a").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("m", "n"))))).alias("v"))
    shown = F.concat(F.lit('"'), "a", F.lit('": '), "v")
    entries = values.groupBy("l_orderkey", "half", "c").agg(F.array_join(F.sort_array(F.collect_list(shown)), ", ").alias("e"))
    entry = F.concat(F.lit('{"类别": "'), "c", F.lit('", '), "e", F.lit("}"))
    docs = entries.groupBy("l_orderkey", "half").agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("d"))
    sides = docs.groupBy("l_orderkey").agg(F.max(F.when(F.col("half") == 1, F.col("d"))).alias("p"), F.max(F.when(F.col("half") == 0, F.col("d"))).alias("r")).where("p is not null and r is not null")
    stats = lambda d: F.concat(F.lit('"统计": ['), d, F.lit("]"))
    note = F.concat(F.lit(', "备注": ["n'), (F.col("l_orderkey") % 5 % 3).cast("string"), F.lit('"]'))
    more = F.when(kind == 4, F.concat(F.lit(", "), stats(F.col("p")))).when(kind == 5, note).when(kind == 7, ', "备注": ["x"]').when(kind == 8, ', "分组统计": {"1": 2}').otherwise("")
    known = F.when(kind == 5, ', "备注": ["N 0", "n1"]').when(kind == 8, ', "分组统计": {"01": "3"}').otherwise("")
    domain = F.when(kind.between(6, 9), "RRU").otherwise("BBU")
    head = F.concat(F.lit("<DOMAIN="), F.when(kind == 1, "RRU").otherwise(domain), F.lit(">, <TASK=SUMMARY>\n{"))
    pred = F.concat(head, stats(F.col("p")), more, F.when(kind == 3, "").when(kind == 2, "}\nmore").otherwise("}"))
    return sides.select(
        "l_orderkey",
        F.when(kind == 10, "无关图片").otherwise(pred).alias("completion"),
        F.when(kind == 9, "无关图片").otherwise(F.concat(F.lit("{"), stats(F.col("r")), known, F.lit("}"))).alias("summary_ref"),
        domain.alias("domain"),
        (kind >= 10).alias("irrelevant"),
    )


SUMMARY_SQL = """WITH l AS (
  SELECT l_orderkey AS k, l_returnflag AS f, l_linestatus = 'O' AS bound, l_partkey % 5 AS m,
    count(*) FILTER (l_linenumber % 2 = 1) AS a, count(*) FILTER (l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1, 2, 3, 4),
o AS (
  SELECT k, k % 12 AS v, k % 12 IN (6, 7, 8, 9) AS rru, k % 12 IN (0, 4, 5, 6, 8) AS compared, sum(a) AS na, sum(b) AS nb, sum(least(a, b)) AS h,
    sum(a) FILTER (bound OR k % 12 IN (6, 8)) AS ta, sum(b) FILTER (bound OR k % 12 IN (6, 8)) AS tb, sum(least(a, b)) FILTER (bound OR k % 12 IN (6, 8)) AS th,
    bool_and(a = b) AS same FROM l GROUP BY k HAVING sum(a) > 0 AND sum(b) > 0),
c AS (
  SELECT k, f, sum(a) > 0 AS p, sum(b) > 0 AS r, count(*) FILTER (bound AND a > 0) > 0 AS pb, count(*) FILTER (NOT bound AND a > 0) > 0 AS pt,
    count(*) FILTER (bound AND b > 0) AS rb, count(*) FILTER (bound AND b > 0 AND a > 0) AS hb FROM l GROUP BY k, f),
s AS (
  SELECT *, p AND r AND (f = 'N' OR k % 12 NOT BETWEEN 6 AND 9) AS counts,
    CASE f WHEN 'A' THEN 0.0 WHEN 'N' THEN pt::INT ELSE pb::INT END AS complete,
    CASE f WHEN 'A' THEN (pb::INT + pt::INT) / 4 WHEN 'N' THEN pb::INT / CASE WHEN k % 12 BETWEEN 6 AND 9 THEN 3 ELSE 2 END ELSE pt::INT END AS extra FROM c),
g AS (
  SELECT k, count(*) FILTER (p AND r) AS shared, count(*) FILTER (p) AS ca, count(*) FILTER (r) AS cb,
    avg(pb::INT) FILTER (r AND rb > 0) AS keys, avg(hb / rb) FILTER (p AND r AND rb > 0) AS paths,
    avg(complete) FILTER (counts) - 0.35 * avg(extra) FILTER (counts) - 0.25 * count(*) FILTER (p AND NOT r) / count(*) FILTER (r) AS tree
  FROM s GROUP BY k HAVING count(*) FILTER (r) > 0),
t AS (
  SELECT k, sum(least(a, b)) AS h, sum(b) AS nb, count(*) FILTER (a > 0) AS ua, count(*) FILTER (b > 0) AS ub
  FROM (SELECT k, m, sum(a) AS a, sum(b) AS b FROM l WHERE NOT bound GROUP BY k, m) GROUP BY k),
x AS (
  SELECT o.*, g.* EXCLUDE (k), coalesce(t.h, 0) AS xh, coalesce(t.nb, 0) AS xb, coalesce(t.ua, 0) AS ua, coalesce(t.ub, 0) AS ub, CASE v WHEN 5 THEN 1 WHEN 8 THEN 2 ELSE 0 END AS ea,
    CASE v WHEN 5 THEN 2 WHEN 8 THEN 3 ELSE 0 END AS eb, CASE v WHEN 5 THEN (k % 5 % 3 = 1)::INT WHEN 8 THEN 2 ELSE 0 END AS eh,
    CASE v WHEN 8 THEN 2 ELSE 0 END AS ga, CASE v WHEN 8 THEN 3 ELSE 0 END AS gb, CASE v WHEN 8 THEN 2 ELSE 0 END AS gh
  FROM o JOIN g USING (k) LEFT JOIN t USING (k))
SELECT k AS l_orderkey,
  CASE WHEN v IN (2, 3, 11) THEN 0.0 ELSE 1.0 END::DOUBLE AS format,
  CASE WHEN v = 11 THEN -1.0 WHEN v IN (1, 10) THEN 0.0 ELSE 1.0 END::DOUBLE AS header,
  CASE WHEN v IN (1, 2) THEN -1.0 ELSE 0.0 END::DOUBLE AS strict,
  CASE WHEN v = 3 THEN -1.0 ELSE 0.0 END::DOUBLE AS parse,
  CASE WHEN compared AND v IN (0, 4, 6) AND same THEN 1.0 ELSE 0.0 END::DOUBLE AS content_eq,
  CASE WHEN v IN (1, 2, 10, 11) THEN 0.0 ELSE 1.0 END::DOUBLE AS dataset,
  CASE WHEN v = 4 THEN -1.0 ELSE 0.0 END::DOUBLE AS no_dup_keys,
  CASE WHEN compared THEN round(shared / cb, 6) ELSE 0.0 END::DOUBLE AS category_recall,
  CASE WHEN compared THEN round(coalesce(keys, 0), 6) ELSE 0.0 END::DOUBLE AS attr_key_recall,
  CASE WHEN compared THEN round(coalesce(paths, 0), 6) ELSE 0.0 END::DOUBLE AS attr_path_recall,
  CASE WHEN compared THEN round(greatest(-1, least(1, coalesce(tree, 0))), 6) ELSE 0.0 END::DOUBLE AS schema_tree,
  CASE WHEN NOT compared THEN 0.0 WHEN coalesce(ta, 0) + ga + coalesce(tb, 0) + gb = 0 THEN 1.0 WHEN coalesce(tb, 0) + gb = 0 THEN 0.0
    ELSE round((coalesce(th, 0) + gh) / (coalesce(th, 0) + gh + CASE WHEN rru THEN 0.6 ELSE 0.3 END * (coalesce(ta, 0) + ga - coalesce(th, 0) - gh) + coalesce(tb, 0) + gb - coalesce(th, 0) - gh), 6) END::DOUBLE AS content_tversky,
  CASE WHEN compared AND NOT rru THEN round(greatest(-1, CASE WHEN xb > 0 THEN xh / xb ELSE 0 END - 0.1 * greatest(0, ua - ub - 2)), 6) ELSE 0.0 END::DOUBLE AS "text",
  CASE WHEN v = 5 AND k % 5 % 3 = 1 THEN 0.5 WHEN v = 5 AND k % 5 % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS notes,
  CASE WHEN compared THEN round(2 * (h + eh) / (na + nb + ea + eb), 6) ELSE 0.0 END::DOUBLE AS content_f1,
  CASE WHEN compared THEN round(2 * shared / (ca + cb), 6) ELSE 0.0 END::DOUBLE AS category_f1,
  CASE WHEN v = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS notes_presence,
  CASE WHEN v = 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS group_stats_presence
FROM x"""


@query(SUMMARY_SQL)
def summary_scores_all(spark, sf_dir):
    scored = summary_scores.score(_summaries(spark, sf_dir), irrelevant="irrelevant")
    return scored.select("l_orderkey", *[F.round(n, 6).alias(n) for n in summary_scores.SCORES])


@query(f"SELECT l_orderkey, header, strict, dataset, category_recall, content_f1, content_tversky FROM ({SUMMARY_SQL})")
def summary_scores_sql(spark, sf_dir):
    names = ["header", "strict", "dataset", "category_recall", "content_f1", "content_tversky"]
    scored = summary_scores.score(_summaries(spark, sf_dir), names, irrelevant="irrelevant")
    return scored.select("l_orderkey", *[F.round(n, 6).alias(n) for n in names])


@query("SELECT l_orderkey, sum(n)::BIGINT AS n_objects FROM (SELECT l_orderkey, l_returnflag, greatest(1, count(*)) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def objects_estimate(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("f1"), F.lit("状态").alias("f2"), F.lit(1).alias("n"))
    return profiles.objects_estimate(facts).withColumnRenamed("doc", "l_orderkey")
