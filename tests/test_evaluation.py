"""Dumps, routing, built summaries, vocabularies, exact overlaps and versions against plain loops on small random rows."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import geometry
from granary.operators import evaluation, matching, routing, summaries
from granary.sources import sinks

UMBRELLA = "螺丝、光纤插头"


def random_object(rng):
    desc = rng.choice(["类别=a", "类别=b,x=1", "a/y", f"{UMBRELLA}/b, c/z", f"{UMBRELLA}/ ,", "", " ", "/a", "b", "x=1"])
    x, y = rng.randrange(0, 60), rng.randrange(0, 60)
    w, h = rng.randrange(5, 40), rng.randrange(5, 40)
    kind = rng.choice(["bbox_2d", "poly", "line"])
    points = {"bbox_2d": [x, y, x + w, y + h], "poly": [x, y, x + w, y, x + w, y + h, x, y + h], "line": [x, y, x + w, y]}[kind]
    return {"type": kind, "points": points, "desc": desc}


def plain_labels(desc):
    desc = desc.strip(" ")
    if "类别=" in desc:
        value = desc.split("类别=", 1)[1].split(",")[0].strip()
        return value, value
    phase, slash, rest = desc.partition("/")
    phase = phase.strip()
    finer = [t.strip() for t in rest.split("/")[0].split(",") if t.strip()]
    return phase, finer[0] if phase == UMBRELLA and finer else phase


def test_scores_of_random_dumps(spark):
    rng = random.Random(5)
    images = {i: ([random_object(rng) for _ in range(rng.randrange(0, 6))], [random_object(rng) for _ in range(rng.randrange(0, 6))]) for i in range(40)}
    rows = [(i, json.dumps(g, ensure_ascii=False), json.dumps(p, ensure_ascii=False)) for i, (g, p) in images.items()] + [(99, None, "[1, {}, null]"), (98, "{", "")]
    dump = spark.createDataFrame(rows, "image int, gt string, pred string")
    truth, pred = evaluation.objects(dump, "image", "gt").cache(), evaluation.objects(dump, "image", "pred").cache()
    pairs = evaluation.overlaps(truth, pred, cell=20.0).cache()
    short = {"bbox_2d": "bbox", "poly": "poly", "line": "line"}
    want, totals = {}, []
    for mode, part in (("localization", None), ("phase", 0), ("category", 1)):
        for t in (0.2, 0.5):
            count = 0
            for gt, pr in images.values():
                found = []
                for gi, g in enumerate(gt):
                    for pi, p in enumerate(pr):
                        iou = geometry.raster_iou(short[g["type"]], np.array(g["points"], float), short[p["type"]], np.array(p["points"], float))
                        lg, lp = plain_labels(g["desc"]), plain_labels(p["desc"])
                        if g["type"] != "line" and p["type"] != "line":
                            a, b = (np.array(o["points"], float).reshape(-1, 2) for o in (g, p))
                            if not (np.minimum(a.max(0), b.max(0)) > np.maximum(a.min(0), b.min(0))).all():
                                iou = 0.0
                        if iou >= t and (part is None or (lg[part] and lg[part] == lp[part])):
                            found.append((-iou, gi, pi))
                used_g, used_p = set(), set()
                for _, gi, pi in sorted(found):
                    if gi not in used_g and pi not in used_p:
                        used_g.add(gi), used_p.add(pi)
                        count += 1
            want[mode, t] = count
    got = evaluation.scores(truth, pred, pairs, thresholds=(0.5, 0.2)).cache()
    assert {(r["mode"], r["threshold"]): r["matched_gt"] for r in got.where("kind is null").collect()} == want
    assert want["localization", 0.2] > want["phase", 0.2] > 0
    totals = got.where("kind is null and threshold = 0.5 and mode = 'phase'").first()
    assert (totals["n_gt"], totals["n_pred"]) == tuple(sum(len(v[k]) for v in images.values()) for k in (0, 1))
    assert {r["mode"] for r in evaluation.mean_f1(got).collect()} == set(evaluation.MODES)
    none = truth.where("false")
    assert evaluation.scores(none, none, evaluation.overlaps(none, none)).count() == 0
    assert evaluation.attribute_scores(evaluation.attributes(none, none, evaluation.matches(evaluation.overlaps(none, none), "phase", 0.5))).first()["weighted_recall"] == 0


def test_objects_of_a_dump_are_clamped_and_judged(spark):
    said = [{"type": "bbox_2d", "points": [-5, 2000.5, True, 1e400], "desc": 3}, {"type": "line", "points": []}, {"type": "poly", "points": "12"}, [], {"type": ["line"], "points": [1, 2]}]
    text = json.dumps(said).replace("Infinity", "1e400")
    found = evaluation.objects(spark.createDataFrame([(1, text)], "image int, gt string"), "image", "gt").orderBy("idx").collect()
    assert [(r["idx"], r["kind"], r["points"], r["desc"]) for r in found][1:] == [(1, "line", [], "")]
    assert found[0]["points"][:3] == [0.0, 999.0, 1.0] and found[0]["desc"] == ""


def test_near_lines_make_pairs(spark):
    line = lambda y: [(1, 0, "line", [10.0, y, 90.0, y], "")]
    schema = "image int, idx int, kind string, points array<double>, desc string"
    pair = lambda y: evaluation.overlaps(spark.createDataFrame(line(10.0), schema), spark.createDataFrame(line(y), schema)).collect()
    assert 0 < pair(16.0)[0]["iou"] < 1 and pair(10.0)[0]["iou"] == 1 and not pair(90.0)


def test_exact_overlaps_of_polygons():
    rng = random.Random(2)
    for _ in range(30):
        shapes = []
        for _ in range(2):
            c, r, n = np.array([rng.uniform(30, 50), rng.uniform(30, 50)]), rng.uniform(10, 30), rng.randrange(3, 9)
            a = np.sort([rng.uniform(0, 2 * np.pi) for _ in range(n)])
            shapes.append(c + r * np.stack([np.cos(a), np.sin(a)], 1))
        p, q = shapes
        # Either way round is the same, and it equals clipping the hulls of these convex shapes.
        want = geometry.convex_iou(p.ravel(), q.ravel())
        for a, b in ((p, q), (p[::-1], q), (p, q[::-1]), (q, p)):
            assert geometry.exact_iou("poly", a.ravel(), "poly", b.ravel()) == pytest.approx(want, abs=1e-9)
    box = np.array([0, 0, 10, 10.0])
    assert geometry.exact_iou("bbox", box, "bbox", box) == 1 and geometry.exact_iou("bbox", box, "line", box) == 0
    assert geometry.exact_iou("poly", box, "poly", box) == 1 and geometry.exact_iou("poly", box[:0], "poly", box) == 0
    assert geometry.exact_iou("poly", np.array([0, 0, 1, 1, 2, 2.0]), "poly", np.array([0, 0, 1, 1, 2, 2.0])) == 0


def plain_summary(descs, rru=False):
    """The rules written out as loops; None where a description is at fault."""
    stats, remarks, groups = {}, [], {}
    known = summaries.CATEGORIES["RRU" if rru else "BBU"]
    for desc in descs:
        pairs, stray, free, bad = [], [], False, False
        for token in [t.strip(" ") for t in (desc or "").split(",") if t.strip(" ")]:
            key, has, value = token.partition("=")
            if has and key.strip(" "):
                pairs.append([key.strip(" "), value.strip(" ")])
                free = pairs[-1][0] in summaries.FREE
            elif has:
                bad, free = True, False
                stray.append(token)
            elif free:
                pairs[-1][1] += ("," if pairs[-1][1] else "") + token
            else:
                stray.append(token)
        values = [(k, v) for k, vs in pairs for v in ([vs] if k in summaries.FREE else vs.split("|")) if v]
        values += [("备注", ",".join(stray))] if stray else []
        category = next((v for k, v in values if k == "类别"), None)
        signs = {}
        for k, v in values:
            signs.setdefault(k, set()).add(any(m in v for m in summaries.NEGATIVE))
        if bad or any(not v for _, v in pairs) or category not in known or any(len(s) == 2 for s in signs.values()):
            return None
        own = stats.setdefault(category, {})
        for k, v in values:
            if k == "备注":
                remarks += [] if v in remarks or rru else [v]
            elif k != "类别":
                counts = own.setdefault(k, {})
                counts[v] = counts.get(v, 0) + 1
                if k == "组":
                    groups[v] = groups.get(v, 0) + 1
    order = sorted(stats, key=lambda c: (0, "") if rru and c == "站点距离" else (1, c))
    out = {"统计": [{"类别": c} | {k: stats[c][k] for k in sorted(stats[c])} for c in order]}
    if remarks:
        out["备注"] = remarks
    if rru and groups:
        out["分组统计"] = groups
    return json.dumps(out, ensure_ascii=False, separators=(", ", ": "))


@pytest.mark.parametrize("domain", ["BBU", "RRU"])
def test_built_summaries(spark, domain):
    rng = random.Random(7)
    tokens = ["属性=好", " 属性 = b|a|a", "备注=r1", "备注=r2,more", '文本=q"x\\', "组=1", "组=2|1", "stray", "x=不能", "x=y", "=", "k=", "属性=|"]
    records = {}
    for record in range(150):
        records[record] = []
        for _ in range(rng.randrange(1, 4)):
            some = rng.choices(tokens[:8] if record % 3 else tokens, k=rng.randrange(0, 4))
            records[record].append(",".join([f"类别={rng.choice(['标签', '标签', '电线' if domain == 'BBU' else '站点距离'])}"] + some) if rng.random() < 0.97 else rng.choice([None, "", "类别=外星"]))
    rows = [(r, i, d) for r, ds in records.items() for i, d in enumerate(ds)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "r int, i int, d string").repartition(5)
    got = {x["r"]: x["summary"] for x in summaries.built(table, "r", "i", "d", domain).collect()}
    want = {r: plain_summary(ds, domain == "RRU") for r, ds in records.items()}
    assert got == want and sum(v is None for v in want.values()) > 10 and sum(v is not None for v in want.values()) > 50
    with pytest.raises(Exception, match="summary with faults"):
        summaries.built(table, "r", "i", "d", domain, strict=True).collect()
    assert summaries.built(table.limit(0), "r", "i", "d", domain).count() == 0


def test_descriptions_are_parsed_in_one_place(spark):
    table = spark.createDataFrame([(1, 1, "类别=标签,备注=r")], "r int, i int, d string")
    plan = summaries.built(table, "r", "i", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_components_and_vocabulary(spark):
    rows = [("类别=a,属性=p,备注=r,s",), ("x,类别=a,y",), ("标签/p/e/f",), ("plain",), ("",), (None,)]
    df = spark.createDataFrame(rows, "desc string")
    got = [tuple(r["c"]) for r in df.where("desc <> ''").select(summaries.components(F.col("desc")).alias("c")).collect()]
    assert got == [("a", "p", "r,s"), ("a", "", "x"), ("标签", "p", "e/f"), ("plain", "", "")]
    words = {}
    for r in summaries.vocabulary(df).collect():
        words.setdefault(r["kind"], set()).add(r["label"])
    assert words["unique_labels_excluded_tag"] == {"a", "p", "r,s", "x", "plain"} and words["all_unique_labels"] == {"a", "p", "r,s", "x", "plain", "标签", "e/f"}
    assert words["properties"] == {"p"} and len(words["full_descriptions"]) == 4


def test_routes_and_their_errors(spark):
    df = spark.createDataFrame([("RRU线缆",), ("RRU位置检查",)], "m string")
    m = F.col("m")
    assert [r[0] for r in df.select(routing.domain_of(m, {"RRU线缆": "rru"}, "BBU ")).collect()] == ["rru", "bbu"]
    for column, fault in ((routing.domain_of(m, {}), "no domain"), (routing.domain_of(m, {"RRU线缆": " "}, "bbu"), "no domain"), (routing.domain_of(m, {}, "x"), "unknown domain"), (routing.known_mission(F.lit(None).cast("string")), "unsupported mission")):
        with pytest.raises(Exception, match=fault):
            df.select(column).collect()
    tickets = spark.createDataFrame([("a",), ("b",), (None,)], "ticket string")
    assert {r[0] for r in routing.without_tickets(tickets, [" a"]).collect()} == {"b", None}
    assert {r[0] for r in routing.without_tickets(tickets, [], spark.createDataFrame([("b ",), ("",)], "key string")).collect()} == {"a", None}


def test_versions_stay_whole(spark, tmp_path):
    root = str(tmp_path / "v")
    one = spark.range(3)
    assert sinks.current_version(spark, root) is None
    for n in (1, 2, 3):
        assert sinks.write_version(spark.range(n), root, keep=2).endswith(f"v{n:08d}")
    one.write.parquet(f"{root}/v00000004")
    assert sinks.current_version(spark, root).endswith("v00000003") and sinks.read_version(spark, root).count() == 3
    # The next version is made from the current one, and takes a number of its own.
    assert sinks.write_version(sinks.read_version(spark, root).where("id > 0"), root, keep=2).endswith("v00000005")
    assert sinks.read_version(spark, root).count() == 2
    assert [p.name for p in sorted((tmp_path / "v").iterdir()) if not p.name.startswith((".", "_"))] == ["v00000004", "v00000005"]


def test_candidates_take_a_score(spark):
    schema = "image int, idx int, kind string, points array<double>, label string"
    a = spark.createDataFrame([(1, 0, "bbox", [0.0, 0.0, 2.0, 2.0], "x")], schema)
    assert matching.candidates(a, a, score=F.lit(0.25)).first()["iou"] == 0.25


def test_upright_polygons_have_the_cells_of_their_boxes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        x, y, w, h = (rng.randrange(0, 30) for _ in range(4))
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        turn = rng.randrange(4)
        ring = (ring[turn:] + ring[:turn])[:: rng.choice([1, -1])]
        if i % 5 == 0:
            ring[0], ring[1] = ring[1], ring[0]
        rows.append((i % 6, i, "poly" if i % 3 else "bbox", [c + (0.5 if i % 7 == 0 else 0.0) for p in ring for c in p] if i % 3 else [float(v) for v in (x, y, x + w, y + h)], ""))
    df = spark.createDataFrame(rows, "image int, idx int, kind string, points array<double>, desc string")
    pairs = evaluation.overlaps(df, df, cell=10.0)
    got = {(r["image"], r["gt_idx"], r["pr_idx"]): r["iou"] for r in pairs.collect()}
    want = {}
    for i, k, kind, p, _ in rows:
        for j, m, other, q, _ in rows:
            a, b = (np.array(s).reshape(-1, 2) for s in (p, q))
            if i == j and (np.minimum(a.max(0), b.max(0)) > np.maximum(a.min(0), b.min(0))).all():
                want[i, k, m] = geometry.raster_iou(kind, np.array(p), other, np.array(q))
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}) and len(got) > 100
    # The shapes that are drawn are drawn once, and a filter on the result does not draw them again.
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_boxes_are_not_drawn(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0, 2.0, 2.0])], "image int, idx int, points array<double>").selectExpr("*", "'bbox' AS kind", "'x' AS label")
    pairs = matching.candidates(df, df)
    assert pairs.first()["iou"] == 1.0 and "ArrowEvalPython" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_are_matched_where_they_lie(spark, monkeypatch):
    rng = random.Random(11)

    def turned(rng):
        o = random_object(rng)
        if o["type"] == "poly" and rng.random() < 0.5:
            o["points"] = o["points"][:6]
        return o

    some = lambda k: [turned(rng) for _ in range(rng.randrange(0, k))]
    rows = [(i, json.dumps(some(9), ensure_ascii=False), json.dumps(some(9), ensure_ascii=False)) for i in range(60)] + [(99, None, "[1, {}, null]"), (98, "{", ""), (97, "[]", "[]")]
    dump = spark.createDataFrame(rows, "image int, gt string, pred string")
    truth, pred = evaluation.objects(dump, "image", "gt").cache(), evaluation.objects(dump, "image", "pred").cache()
    pairs = evaluation.overlaps(truth, pred).cache()
    read = evaluation.pictures(dump).cache()
    assert sorted(map(str, evaluation.objects_of(read, "gt").collect())) == sorted(map(str, truth.collect()))
    want = {(m, r["image"], r["gt_idx"], r["pr_idx"], r["iou"]) for m in evaluation.MODES for r in evaluation.matches(pairs, m, 0.2).collect()}
    found = evaluation.picture_matches(read, tuple(evaluation.MODES), 0.2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    named = lambda rows: {(r["mode"], r["image"], r["gt_idx"], r["pr_idx"], r["iou"]) for r in rows.collect()}
    assert len(want) > 30 and named(found) == want
    # Rows of a picture may come in several batches, and a picture with many pairs is dealt to cells.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert named(found) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(matching, "PAIRS_AT_ONCE", 20)
    assert named(evaluation.picture_matches(read, tuple(evaluation.MODES), 0.2)) == want
    monkeypatch.undo()
    old = evaluation.scores(truth, pred, pairs, thresholds=(0.2, 0.5))
    assert sorted(map(str, evaluation.scores(truth, pred, None, thresholds=(0.2, 0.5), found=found).collect())) == sorted(map(str, old.collect()))
    own = evaluation.matches(pairs, "localization", 0.2)
    placed = found.where("mode = 'localization'")
    assert sorted(map(str, evaluation.attributes(truth, pred, own, whole=True).collect())) == sorted(map(str, evaluation.attributes(None, None, placed, whole=True).collect()))


def test_vectors_match_as_a_loop_does():
    rng = np.random.default_rng(3)
    cases = [(rng.integers(0, 5, 400), rng.integers(0, 9, 400), rng.integers(0, 9, 400), rng.integers(1, 4, 400) / 4) for _ in range(5)]
    chain = np.arange(101)
    cases.append((np.zeros(101, int), chain // 2, (chain + 1) // 2, 1 - chain / 200))  # each pair waits for the one before
    cases.append(tuple(np.zeros(0, t) for t in (int, int, int, float)))
    for image, gt, pr, iou in cases:
        want, used = [], set()
        for k in np.lexsort((pr, gt, -iou, image)):
            keys = {(image[k], "g", gt[k]), (image[k], "p", pr[k])}
            if not keys & used:
                used |= keys
                want.append(k)
        assert matching.greedy_rows(image, gt, pr, iou).tolist() == want
