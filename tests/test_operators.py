"""Operators on small inputs with known results."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import geometry, jsonx, numeric, text
from granary.operators import joins, knowledge, matching, ordering, sampling, summary_scores, validation, votes


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {k}" for n, k in zip(names, KINDS(values))))
    return row.select(column.alias("x")).first()["x"]


def KINDS(values):
    kinds = {str: "string", int: "bigint", float: "double"}
    return ["array<double>" if isinstance(v, list) else kinds[type(v)] for v in values.values()]


# --- votes ---


def test_majority_rules(spark):
    rows = [("a", "pass"), ("a", "fail"), ("b", None), ("b", "?"), ("c", "pass"), ("c", "pass"), ("c", "fail")]
    got = {r["ticket"]: r for r in votes.majority(spark.createDataFrame(rows, "ticket string, verdict string")).collect()}
    assert got["a"]["pred"] == "fail" and got["b"]["pred"] is None and got["b"]["difficulty"] == 0.5
    assert got["c"]["pred"] == "pass" and got["c"]["agreement"] == pytest.approx(2 / 3)


def pairs(spark, rows):
    return spark.createDataFrame([(str(i), *r, 1.0, 1.0) for i, r in enumerate(rows)], "ticket string, truth string, base string, new string, base_agreement double, new_agreement double")


def test_comparison_and_bootstrap(spark):
    full = pairs(spark, [("pass", "fail", "pass"), ("pass", "pass", "pass")])
    assert votes.comparison(full).first()["rer"] == pytest.approx(1.0)
    better = pairs(spark, [("pass", "fail", "pass")] * 20)
    assert votes.bootstrap_probability(better, 0.1, 100).first()["probability"] == 1.0
    assert votes.comparison(pairs(spark, [("pass", "fail", "pass"), ("pass", "fail", "fail")])).first()["changed"] == 0.5
    assert votes.bootstrap_probability(better.limit(0), 0.1, 10).first()["probability"] == 0.0


def test_confusion_counts_null_as_error(spark):
    rows = [("pass", "pass"), ("pass", None), ("fail", "pass"), ("fail", "fail")]
    got = votes.confusion(spark.createDataFrame(rows, "truth string, pred string")).first()
    assert (got["n"], got["correct"], got["fn"], got["fp"]) == (4, 2, 1, 1) and got["fn_rate"] == 0.25


# --- text ---


def test_text_cases(spark):
    for given, want in (("373、", "373"), (" 67 ", "67"), ("距离:128m", "128"), ("无法识别", None), ("", None)):
        assert one(spark, text.first_digits(F.col("t")), t=given) == want
    assert one(spark, text.clean_free_text(F.col("t")), t=" A ,B|C=1 ") == "A,B|C=1"
    assert one(spark, text.clean_free_text(F.col("t")), t="备注1,这里已经帮助修改,请注意参考学习,备注2") == "备注1,备注2"
    assert one(spark, text.fold_stray(F.col("t")), t="类别=BBU设备,挡风板需求=免装,无法判断品牌") == "类别=BBU设备,挡风板需求=免装,备注=无法判断品牌"
    assert one(spark, text.fold_stray(F.col("t")), t="类别=标签,文本=中国联通,坪地横坑仔") == "类别=标签,文本=中国联通,坪地横坑仔"
    assert one(spark, text.signature(F.col("t")), t="如果 A 则 B") == one(spark, text.signature(F.col("t")), t="若A则B")
    assert one(spark, text.nfkc(F.col("t")), t="Ａ１") == "A1"
    assert one(spark, F.size(text.lines(F.col("t"))), t="a\r\n\n b c ") == 3


def test_maps_of_pairs(spark):
    pairs_ = text.kv_pairs(F.col("t"))
    assert one(spark, text.kv_map(pairs_), t="a=1,b=2,a=3") == {"a": "3", "b": "2"}
    assert one(spark, text.kv_multimap(pairs_), t="a=1|2,b=2,a=3") == {"a": ["1", "2", "3"], "b": ["2"]}


# --- JSON and scores ---


def test_json_extraction(spark):
    head = "<DOMAIN=BBU>, <TASK=SUMMARY>\n"
    assert one(spark, jsonx.object_in(F.col("t")), t=head + '{"a":1}\n{"b":2}') == '{"b":2}'
    assert one(spark, jsonx.object_in(F.col("t")), t="hello") is None
    assert one(spark, jsonx.object_in(F.col("t")), t='统计=[{"类别":"x"}]') == '{"统计": [{"类别":"x"}]}'
    assert one(spark, jsonx.has_duplicate_keys(F.col("t")), t='{"a":{"b":1,"b":2}}') is True
    assert one(spark, jsonx.stable_json(F.col("t")), t='{"备注":[],"统计":[1]}') == '{"统计": [1], "备注": []}'


HEAD = {d: f"<DOMAIN={d}>, <TASK=SUMMARY>\n" for d in ("BBU", "RRU")}


def scored(spark, *names, pred, ref='{"统计": []}', domain="BBU", irrelevant=False):
    rows = spark.createDataFrame([(pred, ref, domain, irrelevant)], "completion string, summary_ref string, domain string, irrelevant boolean")
    got = summary_scores.score(rows, names, irrelevant="irrelevant").first()
    return [round(got[n], 6) for n in names]


def summary(*entries, **more):
    return json.dumps({"统计": list(entries), **more}, ensure_ascii=False)


def entry(category, **attributes):
    return {"类别": category, **attributes}


def test_summary_layout_scores(spark):
    head, doc = HEAD["BBU"], summary(entry("A", x={"1": 1}))
    names = ("format", "header", "strict", "parse", "dataset", "content_eq")
    assert scored(spark, *names, pred=head + doc + "<|im_end|>", ref=doc) == [1, 1, 0, 0, 1, 1]
    assert scored(spark, *names, pred=HEAD["RRU"] + doc, ref=doc) == [1, 0, -1, 0, 0, 0]
    assert scored(spark, *names, pred=head + doc + "\nmore", ref=doc) == [0, 1, -1, 0, 0, 0]
    assert scored(spark, *names, pred=head + "\n" + doc, ref=doc) == [0, 1, -1, -1, 0, 0]
    assert scored(spark, *names, pred=head + doc[:-1], ref=doc) == [0, 1, 0, -1, 1, 0]
    assert scored(spark, *names, pred=doc, ref=doc) == [0, 0, -1, -1, 0, 0]
    assert scored(spark, *names, pred=None, ref=doc) == [0, 0, -1, -1, 0, 0]
    assert scored(spark, *names, pred=" 无关图片\n", irrelevant=True) == [1, 0, 0, 0, 0, 0]
    assert scored(spark, *names, pred=head + doc, irrelevant=True) == [0, -1, 0, 0, 0, 0]
    assert scored(spark, *names, pred=head + doc, ref="无关图片") == [1, 1, 0, 0, 1, 0]
    assert scored(spark, "content_eq", pred=head + summary(entry("B"), entry("A", y=1, x=2)), ref=summary(entry("A", x=2, y=1), entry("B"))) == [1]
    twice = '{"统计": [{"类别": "A", "x": {"1": 1, "1": 2}}]}'
    assert scored(spark, "no_dup_keys", pred=head + twice) == [-1] and scored(spark, "no_dup_keys", pred=twice) == [0]


def test_summaries_are_parsed_once_for_all_scores(spark):
    rows = spark.createDataFrame([("", "", "BBU")], "completion string, summary_ref string, domain string")
    plan = summary_scores.score(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "canonical_json" not in plan
    # Texts that are equal once normal count together, in whatever order they come.
    mine, theirs = {f"t{k}" for k in range(40)} | {"（A", "(a", ""}, {f"T{k}" for k in range(20, 60)} | {"(A"}
    facts = lambda ts: [entry("A", 文本=dict.fromkeys(sorted(ts), 2)), entry("A", 文本={"t0": 1}), entry(" B ", x={}), entry("A", 文本=[])]
    names = ("text", "category_f1", "content_eq", "attr_key_recall", "content_f1")
    got = scored(spark, *names, pred=HEAD["BBU"] + summary(*facts(mine)), ref=summary(*facts(theirs)))
    assert got == [round(43 / 83, 6), 1, 0, 1, round(2 / (85 + 83), 6)]


def test_summaries_of_orders_are_dealt_once(spark, sf_dir):
    from granary.plans import text_queries

    plan = text_queries._summaries(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_summary_domains(spark):
    noted, grouped = summary(entry("A"), 备注=["x"]), summary(entry("A"), 分组统计={"1": 2})
    names = ("category_recall", "content_f1", "notes", "notes_presence", "group_stats_presence")
    assert scored(spark, *names, pred=HEAD["BBU"] + noted, ref=noted) == [1, 1, 1, 1, 0]
    assert scored(spark, *names, pred=HEAD["RRU"] + noted, ref=noted, domain="RRU") == [0, 0, 0, 0, 0]
    assert scored(spark, *names, pred=HEAD["BBU"] + grouped, ref=grouped) == [0, 0, 0, 0, 0]
    assert scored(spark, *names, pred=HEAD["RRU"] + grouped, ref=grouped, domain="RRU") == [1, 1, 0, 0, 1]
    assert scored(spark, "notes", pred=HEAD["BBU"] + noted, ref=summary()) == [-1] and scored(spark, "notes", pred=HEAD["BBU"] + summary(), ref=summary()) == [0]
    assert scored(spark, "notes", pred=HEAD["BBU"] + summary(备注=["（a） b"]), ref=summary(备注=["(A)b", "c"])) == [0.5]


def test_summary_recalls(spark):
    one, two = entry("A", 可见性={"完整": 1}, 文本={"t": 1}), entry("B", 捆扎={"整齐": 2, "263": 1, "k=v": 1}, 品牌={"x": 1})
    names = ("category_recall", "category_f1", "attr_key_recall", "attr_path_recall")
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(one), ref=summary(one, two)) == [0.5, round(2 / 3, 6), 0.5, 1]
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(one, entry("B", 捆扎={"散乱": 1})), ref=summary(one, two)) == [1, 1, 0.75, 0.5]
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(), ref=summary()) == [1, 1, 1, 0]
    assert scored(spark, "attr_key_recall", pred=HEAD["BBU"] + summary(entry("C")), ref=summary(entry("A", 文本="t"))) == [0]


def test_summary_content(spark):
    a, b = entry("A", 可见性={"完整": 1}), entry("B", 可见性={"完整": 1})
    text_ = entry("标签", 文本={"x": 3})
    names = ("content_tversky", "content_f1")
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(a, b), ref=summary(a)) == [round(1 / 1.3, 6), round(2 / 3, 6)]
    assert scored(spark, *names, pred=HEAD["RRU"] + summary(a, b), ref=summary(a), domain="RRU") == [round(1 / 1.6, 6), round(2 / 3, 6)]
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(a), ref=summary(a, b)) == [0.5, round(2 / 3, 6)]
    assert scored(spark, *names, pred=HEAD["BBU"] + summary(a, text_), ref=summary(a)) == [1, round(2 / 5, 6)]
    assert scored(spark, *names, pred=HEAD["RRU"] + summary(a, text_), ref=summary(a), domain="RRU") == [round(1 / 2.8, 6), round(2 / 5, 6)]
    far = lambda v: summary(entry("站点距离", 站点距离=v))
    assert scored(spark, "content_f1", pred=HEAD["RRU"] + far({"013米": "2"}), ref=far({"13": 2}), domain="RRU") == [1]
    assert scored(spark, "content_f1", pred=HEAD["RRU"] + far(["13", 13]), ref=far({"13": 2.0, "7": True, "8": -1}), domain="RRU") == [1]
    labels = lambda *t: summary(entry("标签", 文本={x: 1 for x in t}))
    assert scored(spark, "text", pred=HEAD["BBU"] + labels("5g（1）"), ref=labels("5G(1)", "b")) == [0.5]
    assert scored(spark, "text", pred=HEAD["BBU"] + labels("b", "c", "d", "e", "f"), ref=labels("b")) == [0.8]
    assert scored(spark, "text", pred=HEAD["RRU"] + labels("b"), ref=labels("b"), domain="RRU") == [0]


def test_summary_schema_score(spark):
    wire, fibre = entry("电线", 捆扎={"整齐": 1}), entry("光纤", 弯曲半径={"合格": 1})
    value = lambda pred, ref, domain="BBU": scored(spark, "schema_tree", pred=HEAD[domain] + pred, ref=ref, domain=domain)[0]
    assert value(summary(wire), summary(wire)) == 1 and value(summary(fibre), summary(fibre)) == 0.5
    assert value(summary(entry("电线", 捆扎=1, 颜色=1)), summary(wire)) == 0.65
    assert value(summary(wire, entry("新", x=1)), summary(wire)) == 0.75
    assert value(summary(wire, dataset="d"), summary(wire)) == 0.85
    assert value(summary(wire), summary()) == 0 and value(summary(entry("新", x=1)), summary(entry("新", x=1))) == 0
    far = lambda v: summary(entry("站点距离", 站点距离=v))
    assert value(far({"13": 1}), far({"13": 1}), "RRU") == 1
    assert value(far({"13m": 1}), far({"13": 1}), "RRU") == 0.4 and value(far("13"), far({"13": 1}), "RRU") == 0.4


def test_patience_over_ranges(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([-1.0, 0.0, 0.0, 0.0, 1.0]) if k > 12 else 0.0, "x") for k in range(60)]
    want, since = {}, 0
    for k, gain, _ in rows:
        since = 0 if gain > 0 else since + 1
        want[k] = since
    df = spark.createDataFrame(rows, "step long, gain double, _x string").repartition(5)
    assert {r["step"]: r["without_gain"] for r in ordering.patience(df, ["step"], "gain").collect()} == want
    assert {r["step"]: r["without_gain"] for r in ordering.patience(df, ["step"], "gain", ["_x"]).collect()} == want


# --- matching ---


@pytest.mark.parametrize("at_once", [200_000, 10])
def test_greedy_matches_against_a_plain_loop(spark, at_once, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    rows = [(i, g, p, rng.randrange(1, 9) / 8) for i in range(4) for g in range(8) for p in range(8) if rng.random() < (0.2, 0.9)[i % 2]]
    df = spark.createDataFrame(rows, "image long, gt_idx long, pr_idx long, iou double")
    want, left, right = set(), set(), set()
    for i, g, p, iou in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if iou >= 0.25 and (i, g) not in left and (i, p) not in right:
            left.add((i, g))
            right.add((i, p))
            want.add((i, g, p, iou))
    assert {tuple(r) for r in matching.greedy(df, 0.25).collect()} == want
    assert {tuple(r) for r in matching.greedy(df, 0.75).collect()} == {r for r in want if r[3] >= 0.75}


def test_weighted_attributes_with_bonus(spark):
    rows = [
        ("a", 1, "光纤", "可见性", "完整", "x"),
        ("a", 1, "光纤", "品牌", "h", "h"),
        ("a", 1, "光纤", "文本", "t", "t"),
        ("a", 2, "站点距离", "站点距离", "13", "013"),
        ("b", 1, "光纤", "类别", "光纤", "光纤"),
    ]
    df = spark.createDataFrame(rows, "image string, gt_idx long, category string, key string, gt_value string, pr_value string")
    got = {r["image"]: r["score"] for r in matching.weighted_attribute_recall(df).collect()}
    assert got["a"] == pytest.approx((1 / 1.1 + 6 / 7.1 + 1) / 2) and got["b"] == 0


def test_merged_mixture(spark):
    base = spark.createDataFrame([("a", 1.0, "t"), ("b", 2.0, "t")], "name string, ratio double, template string")
    more = spark.createDataFrame([("b", 3.0, None), ("c", 4.0, "u")], "name string, ratio double, template string")
    assert {tuple(r) for r in sampling.merged_mixture(base, more).collect()} == {("a", 1.0, "t"), ("b", 3.0, "t"), ("c", 4.0, "u")}


# --- geometry ---


def test_shapes():
    square = np.array([0, 0, 10, 0, 10, 10, 0, 10], float)
    box = np.array([0, 0, 10, 10], float)
    assert geometry.raster_iou("bbox", box, "poly", square) == 1.0
    line = np.array([0, 0, 50, 0], float)
    assert geometry.raster_iou("line", line, "line", line) == 1.0
    assert geometry.raster_iou("line", line, "line", line + np.array([0, 200, 0, 200])) == 0.0
    near = line + np.array([0, 10, 0, 10])
    assert geometry.raster_iou("line", line, "line", near, 1.0) == 0.0 < geometry.raster_iou("line", line, "line", near, 8.0)
    assert geometry.convex_iou(square, square + 5) == pytest.approx(25 / 175)
    assert geometry.line_iou(line, line) == 1.0
    assert geometry.clip_to_box(square.reshape(-1, 2), (5, 5, 20, 20)).tolist() and abs(len(geometry.hull_points(np.array([[0, 0], [1, 1], [2, 0], [1, 0.5]]))) - 3) == 0
    assert geometry.clip_segment((0, 0), (10, 10), (2, 0, 4, 20)) == ((2.0, 2.0), (4.0, 4.0))
    r = geometry.min_area_rectangle(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [2, 1]]))
    assert sorted(map(tuple, np.round(r, 6).tolist())) == [(0, 0), (0, 2), (4, 0), (4, 2)]


def test_geometry_columns(spark):
    pts = [10.0, 10.0, 0.0, 10.0, 0.0, 0.0, 10.0, 0.0]
    assert one(spark, geometry.start_top_left(F.col("p")), p=pts) == [0, 0, 10, 0, 10, 10, 0, 10]
    assert one(spark, geometry.angle_order(F.col("p")), p=pts)[:2] == [0, 0]
    assert one(spark, geometry.drop_repeats(F.col("p")), p=[0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0]) == [0, 0, 1, 1]
    assert one(spark, matching.clamp_box(F.col("p")), p=[-5.0, 0.0, 1000.0, 1001.0]) == [0, 0, 999, 999]
    assert one(spark, geometry.exif_oriented(F.col("p"), F.lit(6), 100, 50), p=[10.0, 20.0]) == [30.0, 10.0]


def test_greedy_matching_on_a_tie(spark):
    rows = [(1, g, p, 1.0) for g in (0, 1) for p in (0, 1)]
    got = matching.greedy(spark.createDataFrame(rows, "image long, gt_idx long, pr_idx long, iou double"), 0.5).collect()
    assert sorted((r["gt_idx"], r["pr_idx"]) for r in got) == [(0, 0), (1, 1)]


def test_object_orders(spark):
    rows = spark.createDataFrame([([("bbox", [0.0, 0.0, 100.0, 10.0], "wide"), ("bbox", [60.0, 1.0, 70.0, 2.0], "small")],)], "o array<struct<kind:string,points:array<double>,desc:string>>")
    order = lambda policy: [x["desc"] for x in rows.select(ordering.object_order(F.col("o"), policy).alias("o")).first()["o"]]
    assert order("center") == ["small", "wide"] and order("reference") == ["wide", "small"]


# --- samples, state, validation ---


def test_shards_cover_and_balance(spark):
    got = spark.range(23).select(sampling.shard(F.col("id"), 23, 5).alias("s")).groupBy("s").count().collect()
    sizes = [r["count"] for r in got]
    assert len(sizes) == 5 and sum(sizes) == 23 and max(sizes) - min(sizes) <= 1


def test_quotas_and_pools(spark):
    pools = spark.createDataFrame([("a", 100, 0.5), ("b", 200, None), ("c", 300, 1.5)], "name string, n long, ratio double")
    assert [r["quota"] for r in sampling.target_quotas(pools).orderBy("name").collect()] == [50, 200, 450]
    for total, wanted, size in ((10, 512.0, 10), (10, 5.0, 5), (10, 0.2, 2)):
        assert one(spark, numeric.pool_size(F.col("n"), F.col("w")), n=total, w=wanted) == size


def test_cap_items_keeps_order(spark):
    got = one(spark, sampling.cap_items(F.col("p"), 3, F.lit("s")), p=[5.0, 1.0, 4.0, 2.0, 3.0])
    assert len(got) == 3 and [x for x in [5.0, 1.0, 4.0, 2.0, 3.0] if x in got] == got


def test_support_and_edits(spark):
    schema = "text string, cycle long, evidence array<string>, ordinal long"
    first = [("如果 a", 1, ["t1"], 0)]
    assert not knowledge.support(spark.createDataFrame(first, schema)).first()["eligible"]
    both = spark.createDataFrame([*first, ("若a", 2, ["t2", "t1"], 1)], schema)
    got = knowledge.support(both).collect()
    assert len(got) == 1 and got[0]["eligible"] and got[0]["evidence"] == ["t1", "t2"]
    state = spark.createDataFrame([("G0", "keep", 0, 9, 0.0), ("G1", "old rule", 1, 0, 1.0)], "key string, text string, hit long, miss long, confidence double")
    edits = spark.createDataFrame([(None, "Old  rule!", 0), (None, "new", 1)], "key string, text string, ordinal long")
    assert {r["key"]: r["hit"] for r in knowledge.upsert(state, edits).collect()} == {"G0": 0, "G1": 2, "G2": 1}
    assert {r["key"] for r in knowledge.remove(state, state.select("key")).collect()} == {"G0"}
    assert {r["key"] for r in knowledge.cleanup(state).collect()} == {"G0", "G1"}


def test_validation_columns(spark):
    ok = validation.per_image_contract(F.from_json(F.col("m"), "map<string,string>"), F.split("i", ","))
    assert one(spark, ok, m='{"image_1":"a","image_2":"b"}', i="x,y") and not one(spark, ok, m='{"image_1":"a","image_3":"b"}', i="x,y")
    assert one(spark, validation.proposal_problems(F.col("t")), t="若缺失则不通过") == []
    assert "not_binary" in one(spark, validation.proposal_problems(F.col("t")), t="需复核")


def test_complete_groups(spark):
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "g string, n long")
    parts = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "x"), ("b", 0, "z")], "g string, i long, v string")
    got = {r["g"]: (r["ok"], r["values"]) for r in joins.complete_groups(expected, parts, "g", "i", "v").collect()}
    assert got == {"a": (True, ["x", "y"]), "b": (False, None), "c": (False, None)}


# --- annotations ---


def test_features_and_descriptions(spark):
    from granary.operators import annotations as a

    schema = "id long, data_list array<struct<start:struct<x:double,y:double>,end:struct<x:double,y:double>,label:string>>, features array<struct<kind:string,points:array<double>,label:string>>"
    rows = [(1, [(((9.0, 8.0)), ((2.0, -3.0)), "t/p/e/f")], None), (2, None, [("line", [0.0, 0.0, 1.0, 1.0], "u")])]
    got = {r["id"]: r for r in a.features(spark.createDataFrame(rows, schema), "id").collect()}
    assert got[1]["points"] == [2, 0, 9, 8] and (got[1]["type"], got[1]["property"], got[1]["extra"]) == ("t", "p", "e/f")
    assert got[2]["kind"] == "line" and got[2]["property"] is None
    desc = a.leveled_description(F.lit("A"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("")), ["y", "x"], F.array(F.lit("g10"), F.lit("g2"), F.lit("2")))
    assert one(spark, desc, k=1) == "类别=A,x=1,组=2|10"
    assert one(spark, a.mapped_value(F.col("t"), ["不完整", "完整"], ("不完整",)), t="完整|不完整x") == "不完整"


def test_predictions_and_polygons(spark):
    from granary.operators import annotations as a

    text_ = '{"o1":{"desc":"d","bbox_2d":[0,0,5,5]},"o2":{"desc":"d","bbox_2d":[0,0,5,5],"line":[0,0,1,1]},"o3":{"desc":"d","line":[0,0,1,1],"line_points":3}}'
    assert [o["name"] for o in one(spark, a.parsed_prediction(F.col("t")), t=text_)] == ["o1"]
    assert one(spark, a.parsed_prediction(F.col("t")), t="no") == []
    rows = [(1, [0.0, 0.0, 10.0, 10.0], [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0]]), (2, [0.0, 0.0, 10.0, 10.0], [[0.0, 0.0, 50.0, 0.0, 10.0, 10.0]]), (3, [0.0, 0.0, 1.0, 1.0], None)]
    got = {r["id"]: r["kind"] for r in a.capped_polygons(spark.createDataFrame(rows, "id long, bbox array<double>, segmentation array<array<double>>"), 12).collect()}
    assert got == {1: "poly", 2: "bbox", 3: "bbox"}


def test_distances_distill_entries(spark):
    from granary.operators import annotations as a

    rows = spark.createDataFrame([("站点距离=12|3,x=1", True), ("站点距离=3", False), ("x", True)], "desc string, rru boolean")
    assert {r["distance"]: r["has"] for r in a.by_distance(rows, {"has": F.col("rru")}).collect()} == {12: True, 3: True}
    said = spark.createDataFrame([("t", 1, "b", True), ("t", 0, "x", False), ("t", 2, "c", True)], "ticket string, candidate_index long, text string, format_ok boolean")
    got = a.distilled(said, spark.createDataFrame([("t", "p")], "ticket string, prompt string")).first()["messages"]
    assert [m["content"] for m in got] == ["p", "b"]
    base = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1)], "name string, ratio double, ordinal long")
    new = spark.createDataFrame([("c", 5.0, 0), ("b", 3.0, 1)], "name string, ratio double, ordinal long")
    assert [(r["name"], r["ratio"]) for r in a.merged_entries(base, new).orderBy("position").collect()] == [("a", 1.0), ("b", 3.0), ("c", 5.0)]
    known = F.array(F.lit("alpha beta"), F.lit("gamma delta epsilon"))
    assert one(spark, a.similar_text(known, F.col("t")), t="gamma delta epsilom") == "gamma delta epsilon" and one(spark, a.similar_text(known, F.col("t")), t="zeta") is None


# --- records ---


def test_record_rules(spark):
    from granary.functions import records as r

    df = spark.createDataFrame([(1, 2, 3)], "id long, eval_a long, b long")
    train, held = r.split_by_prefix(df, "eval_", ["id"])
    assert train.columns == ["id", "b"] and held.columns == ["id", "a"]
    assert one(spark, r.first_present(F.col("a"), F.col("b")), a=" ", b="x") == "x"
    assert one(spark, r.assistant_prefix(F.col("a"), F.lit("DENSE")), a="BBU") == "<DOMAIN=BBU>, <TASK=DENSE>\n"
    got = one(spark, r.phase_of(F.col("t"), {}), t="螺丝、光纤插头/BBU安装螺丝,完整,符合")
    assert (got["phase"], got["category"]) == ("螺丝、光纤插头", "BBU安装螺丝")
    assert one(spark, r.phase_of(F.col("t"), {"BBU": "设备"}), t="类别=BBU设备,x=1")["phase"] == "设备"
    assert one(spark, r.without_distance(F.col("t")), t="a\n站点距离=3\nb") == "a\nb"
    sizes = lambda w, h: F.array(F.lit(w), F.lit(h))
    assert one(spark, r.needs_turn(F.col("o"), sizes(100, 50), sizes(100, 50), sizes(50, 100)), o=6) is True
    assert one(spark, r.needs_turn(F.col("o"), sizes(100, 50), sizes(50, 100), sizes(50, 100)), o=6) is False


def test_polygon_rules(spark):
    from granary.functions import records as r

    square = [0.0, 0.0, 5.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]
    assert one(spark, r.without_collinear(F.col("p")), p=square) == [0, 0, 10, 0, 10, 10, 0, 10]
    half = F.array(*[F.lit(v) for v in (0.0, 0.0, 5.0, 20.0)])
    assert one(spark, r.coverage(F.col("p"), half), p=square) == pytest.approx(0.5)
    shift = F.array(*[F.lit(v) for v in (1.0, 0.0, 5.0, 0.0, 1.0, 0.0)])
    assert one(spark, r.moved_polygon(F.col("p"), shift, F.lit(30), F.lit(30)), p=square)[:2] == [5, 0]
    assert max(one(spark, r.moved_polygon(F.col("p"), shift, F.lit(10), F.lit(30)), p=square)[0::2]) == pytest.approx(10)
    assert one(spark, r.clipped_line(F.col("p"), half), p=[-5.0, 1.0, 2.0, 1.0, 9.0, 1.0]) == [0, 1, 2, 1, 5, 1]
    shown = one(spark, r.rendered_objects(F.col("t")), t='[{"desc":"d","kind":"line","points":[1,2,3,4]}]')
    assert shown == '{"object_1": {"desc": "d", "line": [[1, 2], [3, 4]], "line_points": 2}}'
    spans = one(spark, r.json_spans(F.col("t")), t=shown)
    assert [shown[s["start"] : s["end"]] for s in spans if s["kind"] == "desc"] == ["d"] and sum(s["kind"] == "coord" for s in spans) == 4


def _random_boxes(spark, n=400):
    rng = random.Random(5)
    rows = [(k % 2, k, "bbox", [x, y, x + rng.randrange(0, 9), y + rng.randrange(0, 9)], str(k % 3)) for k in range(n) for x, y in [(float(rng.randrange(30)), float(rng.randrange(30)))]]
    both = spark.createDataFrame(rows, "image long, idx long, kind string, points array<double>, label string")
    return both.where("idx % 4 < 2"), both.where("idx % 4 >= 2")


@pytest.mark.parametrize("same_label", [False, True])
def test_matches_from_boxes_are_those_from_pairs(spark, monkeypatch, same_label):
    """bands and blocks give the matches that all pairs give; many boxes are equal, some empty."""
    truth, pred = _random_boxes(spark)
    want = matching.greedy(matching.candidates(truth, pred), 0.3, same_label=same_label).collect()
    monkeypatch.setattr(matching, "OVERLAPS_AT_ONCE", 0)
    monkeypatch.setattr(matching, "BLOCK", 30)
    monkeypatch.setattr(matching, "STRIP", 7)
    assert sorted(matching.greedy_boxes(truth, pred, 0.3, same_label=same_label).collect()) == sorted(want)


def test_box_pairs_are_all_that_meet(spark, monkeypatch):
    """boxes that only touch meet too."""
    truth, pred = _random_boxes(spark)
    monkeypatch.setattr(matching, "BLOCK", 30)
    got = matching.box_pairs(matching.boxed(truth), matching.boxed(pred))
    assert sorted(got.collect()) == sorted(matching.candidates(truth, pred, cell=4.0).select(*got.columns).collect())


def test_best_boxes(spark, monkeypatch):
    """the best IoU of each true box, 0 where none meets it."""
    truth, pred = _random_boxes(spark)
    monkeypatch.setattr(matching, "BLOCK", 30)
    got = matching.best_boxes(truth, pred.where("idx < 40")).select("idx", "best")
    want = matching.best_per_truth(truth, matching.candidates(truth, pred.where("idx < 40"))).select("idx", "best")
    assert sorted(got.collect()) == sorted(want.collect())
