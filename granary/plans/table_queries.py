"""Joins, sets, curation, sampling, validation and order on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.numeric import f_beta, ratio, tversky
from granary.operators import joins, knowledge, ordering, profiles, sampling, validation
from granary.plans.registry import query, table


# --- joins and sets ---


@query(
    "WITH f AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), "
    "s AS (SELECT l_orderkey, l_suppkey, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS reasons FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT f.l_orderkey, f.l_suppkey, s.reasons FROM f LEFT JOIN s USING (l_orderkey, l_suppkey)"
)
def reasons_left_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_suppkey"]
    tickets = lines.where("l_returnflag = 'R'").select(*keys).distinct()
    out = joins.attach_reasons(tickets, lines.where("l_returnflag = 'A'"), keys, "l_linestatus")
    return out.select(*keys, F.array_join("reasons", ",").alias("reasons"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def exclude_anti(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.exclude(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount > 0.05)")
def keys_semi(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, ["o_orderkey"])


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS present FROM customer")
def presence_split(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.split_by_presence(table(spark, sf_dir, "customer").select("c_custkey"), keys, ["c_custkey"])


@query(
    "WITH x AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'R') AS f, max(l_partkey) FILTER (l_returnflag = 'N') AS a, max(l_partkey) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, a AS pass_part, b AS fail_part, CASE WHEN a = b THEN 1 ELSE 2 END AS n_parts FROM x WHERE p = 1 AND f = 1"
)
def merge_pass_fail(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "R", "fail")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", label.alias("label"))
    pairs = joins.pass_fail_pairs(rows, "l_orderkey", "label")
    both = pairs.select("l_orderkey", F.array("pass_row.l_partkey").alias("a"), F.array("fail_row.l_partkey").alias("b"))
    return both.select("l_orderkey", F.get("a", F.lit(0)).alias("pass_part"), F.get("b", F.lit(0)).alias("fail_part"), F.size(joins.append_missing("a", "b")).alias("n_parts"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def name_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT p_partkey FROM part WHERE p_size > 40")
def key_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    either = lines.where("l_returnflag = 'R' OR l_discount > 0.09").select(F.col("l_partkey").alias("k")).distinct()
    return either.join(table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("k")), "k", "left_anti")


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (NOT known) AS n_unknown FROM (SELECT p_brand, s_suppkey IS NOT NULL AS known FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey) GROUP BY p_brand")
def annotation_joins(spark, sf_dir):
    annotations = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_suppkey").alias("category_id"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file_name"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = joins.annotations_with_names(annotations, images, names)
    return found.groupBy(F.col("file_name").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("n_unknown"))


FACTS = """WITH l AS (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) FILTER (l_linenumber % 2 = 1) AS a, count(*) FILTER (l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT l_orderkey, sum(a)::BIGINT AS n_left, sum(b)::BIGINT AS n_right, sum(least(a, b))::BIGINT AS n_both FROM l GROUP BY 1) SELECT *, """


@query(
    FACTS
    + "round(CASE WHEN n_both + 0.3 * (n_left - n_both) + (n_right - n_both) = 0 THEN 0 ELSE n_both / (n_both + 0.3 * (n_left - n_both) + (n_right - n_both)) END, 6) AS tversky, "
    "round(CASE WHEN n_left = 0 OR n_right = 0 OR n_both = 0 THEN 0 ELSE 2 * (n_both / n_left) * (n_both / n_right) / (n_both / n_left + n_both / n_right) END, 6) AS f1 FROM o"
)
def fact_scores(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    half = lambda k: lines.where(F.col("l_linenumber") % 2 == k).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    over = joins.fact_overlap(half(1), half(0), "l_orderkey", ["l_returnflag", "l_linestatus"])
    hit, a, b = F.col("n_both"), F.col("n_left"), F.col("n_right")
    return over.withColumn("tversky", F.round(tversky(hit, a - hit, b - hit, 0.3, 1.0), 6)).withColumn("f1", F.round(f_beta(ratio(hit, a), ratio(hit, b)), 6))


@query(
    "WITH e AS (SELECT l_orderkey, max(l_linenumber)::INT AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT l_orderkey, rows = n AND d = n AS ok FROM e JOIN s USING (l_orderkey)"
)
def complete_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    expected = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    shards = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("index"), F.col("l_returnflag").alias("text"))
    return joins.complete_groups(expected, shards, "l_orderkey", "index", "text").select("l_orderkey", "ok")


# --- curation ---


@query(
    "WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (contains(text, 'the')) AS useless FROM conversations GROUP BY 1) SELECT conv_id, n AS total, useless, CASE WHEN n - useless < 2 AND useless >= 1 THEN 'fail' ELSE 'pass' END AS label FROM c"
)
def flip_label(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.contains("text", F.lit("the"))).alias("useless"))
    return turns.withColumn("label", F.when(validation.flips_to_fail(F.col("total"), F.col("useless"), 2), "fail").otherwise("pass"))


@query(
    "WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS passed, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1) "
    "SELECT CASE WHEN passed = 0 THEN 'none' WHEN failed / passed < 2 THEN '<2' WHEN failed / passed < 3 THEN '<3' WHEN failed / passed < 5 THEN '<5' ELSE '>=5' END AS bucket, failed - passed AS difference, count(*) AS n, count(*) FILTER (passed <= 2 AND failed >= 3) AS suspicious FROM c GROUP BY 1, 2"
)
def ratio_buckets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("passed"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    bucket = F.when(F.col("passed") == 0, "none").otherwise(profiles.ratio_bucket(F.col("failed"), F.nullif("passed", F.lit(0))))
    suspicious = (F.col("passed") <= 2) & (F.col("failed") >= 3)
    return orders.groupBy(bucket.alias("bucket"), (F.col("failed") - F.col("passed")).alias("difference")).agg(F.count(F.lit(1)).alias("n"), F.count_if(suspicious).alias("suspicious"))


@query("SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(p_type, ' '))) AS value FROM part) WHERE value <> '' GROUP BY 1")
def reason_frequency(spark, sf_dir):
    return profiles.value_counts(table(spark, sf_dir, "part"), "p_type", " ")


@query("SELECT p_type, count(*) AS n_objects, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS records FROM part GROUP BY 1")
def category_index(spark, sf_dir):
    return profiles.category_index(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("records", F.array_join("records", ","))


@query("SELECT l_linestatus, l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def nested_counts(spark, sf_dir):
    found = profiles.nested_counts(table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("string")), "l_linestatus", "l_returnflag", "l_linenumber")
    flat = found.select("l_linestatus", F.explode("attributes").alias("l_returnflag", "v"))
    values = flat.select("l_linestatus", "l_returnflag", F.explode(F.from_json("v", "map<string,bigint>")).alias("l_linenumber", "n"))
    return values.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT event_type AS decision, count(*) AS n, round(max(value), 6) AS max_rer, round(arg_max(value, user_id * 10000000 + event_id), 6) AS last_score FROM events GROUP BY 1")
def run_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("decision"), F.col("user_id").alias("iteration"), F.col("event_id").alias("line_no"), F.col("value").alias("score"), F.col("value").alias("rer"))
    return profiles.run_summary(log).withColumns({c: F.round(c, 6) for c in ("max_rer", "last_score")})


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS loss, round(count(*) FILTER (l_linenumber = l_quantity::INT % 7)::DOUBLE / count(*)::DOUBLE, 6) AS accuracy FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1, 2"
)
def masked_means(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("label_id"), (F.col("l_quantity").cast("int") % 7).alias("pred_id"), F.col("l_discount").alias("loss"))
    return profiles.masked_means(tokens, ["l_returnflag", "l_linestatus"], ignore=1).withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})


# --- length profiles ---

PROFILE = "round_even(quantile_cont(n_chars, {q}), 0)::BIGINT AS p{n}"


@query(
    "SELECT source, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS deviation, "
    + ", ".join(PROFILE.format(q=q, n=n) for q, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))
    + ", count(*) FILTER (n_chars > 2048) AS n_over, max(greatest(n_chars - 2048, 0)) AS worst_excess FROM documents GROUP BY 1"
)
def length_profile(spark, sf_dir):
    return profiles.length_summary(table(spark, sf_dir, "documents"), "n_chars", 2048, ["source"]).withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("SELECT lang, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median FROM documents GROUP BY 1")
def upper_median(spark, sf_dir):
    return profiles.upper_median(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def longest_documents(spark, sf_dir):
    return profiles.longest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 15)


# --- sampling ---


@query(
    "WITH p AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 0.5 WHEN 'src1' THEN 1.5 WHEN 'src2' THEN 0.25 END AS ratio FROM documents GROUP BY 1) SELECT source, n, round_even(n * coalesce(ratio, 1.0), 0)::BIGINT AS quota, (SELECT round_even(0.35 * sum(round_even(n * coalesce(ratio, 1.0), 0)), 0)::BIGINT FROM p) AS auxiliary FROM p"
)
def quotas(spark, sf_dir):
    pools = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("source") == "src0", 0.5).when(F.col("source") == "src1", 1.5).when(F.col("source") == "src2", 0.25)
    targets = sampling.target_quotas(pools.withColumn("ratio", share))
    return targets.crossJoin(F.broadcast(sampling.auxiliary_quota(0.35, targets).withColumnRenamed("quota", "auxiliary"))).select("source", "n", "quota", "auxiliary")


DRAW = """WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY source) AS size FROM documents),
q AS (SELECT DISTINCT source, size, CASE WHEN source IN ('src0', 'src1') THEN size + 5 ELSE size // 2 END AS quota FROM h)"""


def _quota_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    quota = F.when(F.col("source").isin("src0", "src1"), F.col("size") + 5).otherwise(F.floor(F.col("size") / 2))
    return docs, sizes.select("source", quota.cast("long").alias("quota"))


@query(
    DRAW
    + """ SELECT h.source, doc_id, rank AS draw, false AS fallback FROM h JOIN q USING (source) WHERE quota <= h.size AND rank <= quota
UNION ALL SELECT q.source, h.doc_id, d AS draw, true FROM (SELECT *, unnest(range(1, quota + 1)) AS d FROM q WHERE quota > size) q JOIN h ON h.source = q.source AND h.rank = ('0x' || substr(md5('3:draw:' || q.source || ':' || d), 1, 12))::BIGINT % q.size + 1"""
)
def quota_draw(spark, sf_dir):
    docs, plan = _quota_plan(spark, sf_dir)
    return sampling.draw(docs, plan, "source", "doc_id", seed=3)


@query(DRAW + " SELECT h.source, doc_id, rank + r * h.size AS draw FROM h JOIN q USING (source), range(0, 3) x(r) WHERE rank + r * h.size <= quota")
def oversample(spark, sf_dir):
    docs, plan = _quota_plan(spark, sf_dir)
    return sampling.oversample(docs, plan, "source", "doc_id", seed=3)


@query(
    DRAW + ", o AS (SELECT h.source, doc_id, rank + r * h.size AS draw FROM h JOIN q USING (source), range(0, 3) x(r) WHERE rank + r * h.size <= quota) "
    "SELECT *, row_number() OVER (ORDER BY md5('3:1:' || source || ':' || doc_id || ':' || draw), source, doc_id, draw) AS position FROM o"
)
def epoch_schedule(spark, sf_dir):
    docs, plan = _quota_plan(spark, sf_dir)
    return sampling.schedule(sampling.oversample(docs, plan, "source", "doc_id", seed=3), "source", "doc_id", seed=3, epoch=1)


@query(
    """WITH s AS (SELECT quality, count(*) AS size FROM labels GROUP BY 1), x AS (SELECT quality, size * 37 / (SELECT sum(size) FROM s) AS exact FROM s),
f AS (SELECT *, floor(exact)::BIGINT AS fl FROM x), t AS (SELECT quality, fl + (row_number() OVER (ORDER BY exact - fl DESC, quality) <= 37 - (SELECT sum(fl) FROM f))::INT AS take FROM f),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id), doc_id) AS rank FROM labels) SELECT doc_id, quality, rank <= take AS held_out FROM r JOIN t USING (quality)"""
)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 37, seed=5)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS part FROM documents")
def train_val(spark, sf_dir):
    return sampling.train_val(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, seed=1)


@query(
    """WITH s AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), t AS (SELECT p_type, size, greatest(1, floor(size * 50 / (SELECT sum(size) FROM s)))::BIGINT AS take FROM s),
r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('2:' || p_partkey), p_partkey) AS rank FROM part) SELECT p_partkey, p_type FROM r JOIN t USING (p_type) WHERE rank <= take ORDER BY size DESC, p_type, rank LIMIT 50"""
)
def proportional_sample(spark, sf_dir):
    return sampling.proportional(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 50, seed=2)


@query("SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5('2:' || p_partkey), p_partkey) AS rank FROM part) WHERE rank <= 4")
def uniform_sample(spark, sf_dir):
    return sampling.per_group(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 4, seed=2)


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 3)")
def top_category_rows(spark, sf_dir):
    return sampling.of_top_categories(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 3)


@query("SELECT doc_id FROM documents ORDER BY md5('9:' || doc_id), doc_id LIMIT 28")
def hashed_sample(spark, sf_dir):
    return sampling.take_hashed(table(spark, sf_dir, "documents").select("doc_id"), 28, ["doc_id"], seed=9)


@query(
    "WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' END AS label FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('4:' || o_orderkey), o_orderkey) AS rank FROM o) SELECT o_orderkey, label FROM r WHERE label = 'pass' AND rank <= 40 OR label = 'fail' AND rank <= 25"
)
def pass_fail_quota(spark, sf_dir):
    label = F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", label.alias("label"))
    return sampling.pass_fail_sample(rows, "label", "o_orderkey", 40, 25, seed=4)


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 2 AS route FROM documents")
def md5_route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.route(F.col("doc_id")).alias("route"))


#: CRC-32 of a name, a bit at a time.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(source, ''), lambda c: ord(c)::BIGINT)), lambda crc, byte:
list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""


@query(f"SELECT doc_id, ((xor({CRC}, 4294967295) & 65535) << 32) | (doc_id & 4294967295) AS sample_id FROM documents")
def sample_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.sample_id(F.col("source"), F.col("doc_id")).alias("sample_id"))


@query(
    "WITH n AS (SELECT count(*) AS n, count(*) // 7 AS size, count(*) % 7 AS more FROM documents) "
    "SELECT doc_id, CASE WHEN doc_id < more * (size + 1) THEN doc_id // (size + 1) ELSE more + (doc_id - more * (size + 1)) // size END AS shard, doc_id % 7 AS strided FROM documents, n"
)
def shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sampling.shard(F.col("doc_id"), docs.count(), 7).alias("shard"), (F.col("doc_id") % 7).alias("strided"))


# --- validation ---

RULES = [("negative_discount", "critical", "l_discount", "l_discount < 0"), ("high_tax", "warning", "l_tax", "l_tax > 0.07"), ("large_quantity", "warning", "l_quantity", "l_quantity > 45"), ("late_open", "critical", "l_linestatus", "l_linestatus = 'O' AND l_quantity < 2")]


def _checked(spark, sf_dir):
    rules = [(t, s, f, F.expr(e)) for t, s, f, e in RULES]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", validation.violations(rules).alias("violations"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS type, '{s}' AS severity, count(*) AS n FROM lineitem WHERE {e} HAVING count(*) > 0" for t, s, f, e in RULES))
def validate_rules(spark, sf_dir):
    return validation.report(_checked(spark, sf_dir))


@query(
    "WITH v AS (SELECT " + ", ".join(f"({e})::INT AS r{i}" for i, (*_, e) in enumerate(RULES)) + " FROM lineitem) SELECT count(*) AS n, count(*) FILTER (r0 + r3 = 0) AS n_valid, sum(r0 + r1 + r2 + r3)::BIGINT AS n_violations, round(count(*) FILTER (r0 + r3 = 0) / count(*), 6) AS success_rate FROM v"
)
def validation_summary(spark, sf_dir):
    return validation.summary(_checked(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) = 1)")
def group_integrity(spark, sf_dir):
    return validation.without_singletons(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_suppkey")


# --- order ---


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_event(spark, sf_dir):
    return ordering.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event(spark, sf_dir):
    return ordering.latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ranked_orders(spark, sf_dir):
    return ordering.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("SELECT * FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 20")
def ranked_per_segment(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ordering.ranked_per_group(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 20).drop("c_acctbal")


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT source, doc_id, k, 0::BIGINT AS pack, n AS total FROM d WHERE k = 1 UNION ALL
  SELECT d.source, d.doc_id, d.k, p.pack + (p.total + d.n > 8000 OR d.n >= 8000)::INT, CASE WHEN p.total + d.n > 8000 OR d.n >= 8000 THEN d.n ELSE p.total + d.n END FROM p JOIN d ON d.source = p.source AND d.k = p.k + 1)
SELECT source, doc_id, pack FROM p"""
)
def pack_sequential(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ordering.packs(docs, "source", ["doc_id"], "n_chars", 8000).drop("n_chars")


@query("SELECT event_id, round(CASE WHEN event_id <= 100 THEN 0.5 * event_id / 100 WHEN event_id <= 600 THEN 0.5 + 0.25 * (event_id - 100) / 500 ELSE 0.75 END, 6) AS value FROM events")
def curriculum_lerp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(ordering.phase_value(F.col("event_id"), [(100, 0.5), (600, 0.75)], 0.0), 6).alias("value"))


@query(
    "WITH i AS (SELECT user_id, event_id, value, sum((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - (island > 0)::INT)::INT AS without_gain FROM i"
)
def patience(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, 1).otherwise(0).alias("gain"))
    return ordering.patience(rows, ["event_id"], "gain", ["user_id"]).select("user_id", "event_id", F.col("without_gain").cast("int").alias("without_gain"))


@query("SELECT user_id, count(*) FILTER (prev IS DISTINCT FROM event_type) AS n_runs FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY 1")
def consecutive_repeats(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("kinds"))
    return kinds.select("user_id", F.size(ordering.without_repeats(F.col("kinds"))).cast("long").alias("n_runs"))


# --- keyed state ---


@query(
    "WITH e AS (SELECT event_type, user_id, event_id, event_id % 5 AS cycle FROM events) SELECT event_type AS text, count(DISTINCT cycle) AS n_cycles, count(DISTINCT user_id) AS n_keys, count(DISTINCT cycle) >= 2 AND count(DISTINCT user_id) >= 2 AS eligible FROM e GROUP BY 1"
)
def hypothesis_support(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("text"), (F.col("event_id") % 5).alias("cycle"), F.array(F.col("user_id").cast("string")).alias("evidence"), F.col("event_id").alias("ordinal"))
    return knowledge.support(rows).select("text", "n_cycles", F.size("evidence").cast("long").alias("n_keys"), "eligible")


GUIDE = """WITH g AS (SELECT 'G' || s_suppkey AS key, s_name AS text, s_suppkey % 4 AS hit, s_suppkey % 3 AS miss FROM supplier),
o AS (SELECT 'G' || l_suppkey AS key, count(*) FILTER (l_returnflag = 'N') AS h, count(*) FILTER (l_returnflag <> 'N') AS m FROM lineitem GROUP BY 1),
t AS (SELECT key, text, hit + coalesce(h, 0) AS hit, miss + coalesce(m, 0) AS miss FROM g LEFT JOIN o USING (key))"""


def _guidance(spark, sf_dir):
    key = F.concat(F.lit("G"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(key.alias("key"), F.col("s_name").alias("text"), (F.col("s_suppkey") % 4).alias("hit"), (F.col("s_suppkey") % 3).alias("miss"))


def _tallied(spark, sf_dir):
    outcomes = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("key"), (F.col("l_returnflag") == "N").alias("hit"))
    return knowledge.tally(_guidance(spark, sf_dir), outcomes)


@query(GUIDE + " SELECT *, round(hit / (hit + miss + 1e-5), 6) AS confidence FROM t")
def guidance_tally(spark, sf_dir):
    return _tallied(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(GUIDE + " SELECT key, text, hit, miss FROM t WHERE key = 'G0' OR NOT (hit / (hit + miss + 1e-5) < 0.33 AND miss >= 3)")
def guidance_cleanup(spark, sf_dir):
    return knowledge.cleanup(_tallied(spark, sf_dir), least=0.33).drop("confidence")


@query(
    GUIDE + ", x AS (SELECT 'G' || s_suppkey AS source, 'G' || (s_suppkey % 3 + 1) AS target FROM supplier WHERE s_suppkey > 3), f AS (SELECT target, sum(hit)::BIGINT AS h, sum(miss)::BIGINT AS m, count(*) AS n FROM x JOIN g ON key = source GROUP BY 1) "
    "SELECT key, hit + coalesce(h, 0) AS hit, miss + coalesce(m, 0) AS miss, coalesce(n, 0) AS n_merged FROM g LEFT JOIN f ON target = key WHERE key NOT IN (SELECT source FROM x)"
)
def guidance_merge(spark, sf_dir):
    name = lambda c: F.concat(F.lit("G"), c.cast("string"))
    k = F.col("s_suppkey")
    merges = table(spark, sf_dir, "supplier").where("s_suppkey > 3").select(name(k).alias("source"), name(k % 3 + 1).alias("target"))
    return knowledge.merge(_guidance(spark, sf_dir), merges).select("key", "hit", "miss", F.size("merged_from").cast("long").alias("n_merged"))


@query(GUIDE + " SELECT key FROM t ORDER BY round(hit / (hit + miss + 1e-5), 12), length(key), key LIMIT 10")
def ablation_candidates(spark, sf_dir):
    return knowledge.ablation_order(_tallied(spark, sf_dir).withColumn("confidence", F.round("confidence", 12)), 10).select("key")
