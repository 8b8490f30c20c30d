"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from granary.sources import jsonl, sinks
from granary.streaming import progress


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"images":["x.jpg","/y.jpg"],"width":3}\n\nnot json\n', encoding="utf-8")
    path = str(tmp_path / "a.jsonl")
    assert jsonl.read(spark, path, jsonl.RECORD_SCHEMA).select("width").collect()[0]["width"] == 3
    bad = jsonl.read(spark, path, jsonl.RECORD_SCHEMA, "quarantine").cache().where(F.col(jsonl.CORRUPT).isNotNull())
    assert [r[jsonl.CORRUPT] for r in bad.collect()] == ["not json"]
    images = jsonl.with_image_paths(jsonl.read(spark, path, jsonl.RECORD_SCHEMA)).first()["images"]
    assert images[0].endswith("/x.jpg") and images[0].startswith("file:") and images[1] == "/y.jpg"


def test_tickets(spark, tmp_path):
    rows = [
        {"group_id": "g1", "mission": "m", "label": "通过", "images": ["a", "b"], "per_image": {"image_10": "ten", "image_2": "two"}, "label_timestamp": "x"},
        {"group_id": "g2", "mission": "m", "label": "?", "images": ["a"], "per_image": {"image_1": "t"}},
        {"group_id": "g3", "mission": "m", "label": "fail", "images": [], "per_image": {"image_1": "t"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    good, rejected = jsonl.read_tickets(spark, [str(tmp_path / "t.jsonl")])
    got = good.collect()
    assert [r["ticket"] for r in got] == ["g1::pass"] and got[0]["texts"] == ["two", "ten"] and got[0]["labelled_at"] is None
    assert sorted(r["reason"] for r in rejected.cache().collect()) == ["images", "label"]


def test_tickets_and_rejected_rows_come_from_one_pass(spark, tmp_path):
    row = {"group_id": "g", "mission": "RRU", "label": "fail", "images": ["a"], "per_image": {"image_10": " ten ", "image_2": "无关图片 x"}, "label_timestamp": "2024-01-02"}
    rows = [json.dumps(row | more) for more in ({}, {"mission": "BBU"}, {"label": "?"}, {"per_image": {}}, {"mission": None})] + ["\u2003[1]\u3000", "{", "\u2003\x85"]
    (tmp_path / "t.jsonl").write_text("\n".join(rows), encoding="utf-8")
    found = jsonl.judged_tickets(spark, [str(tmp_path / "t.jsonl")], require=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = sorted((r["reason"] or "", r["mission"] or "", r["texts"]) for r in found.collect())
    assert got == [("", "", ["无关图片", "ten"]), ("", "BBU", ["无关图片", "ten"]), ("", "RRU", ["无关图片 x", " ten "]), ("label", "", None), ("malformed", "", None), ("malformed", "", None), ("texts", "", None)]
    good, rejected = jsonl.read_tickets(spark, [str(tmp_path / "t.jsonl")])
    assert good.columns == list(jsonl.TICKET) and rejected.columns[-2:] == [jsonl.CORRUPT, "reason"]
    assert (good.count(), sorted(r["reason"] for r in rejected.collect())) == (3, ["label", "malformed", "malformed", "texts"])


def test_coco_keys_and_tree(spark, tmp_path):
    doc = {"images": [{"id": 1, "coco_url": "http://h/train/7.jpg", "width": 4, "height": 5}], "annotations": [{"id": 2, "image_id": 1, "category_id": 3, "bbox": [0.0, 0.0, 1.0, 1.0]}], "categories": [{"id": 3, "name": "cat"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, annotations, categories = jsonl.read_coco(spark, str(tmp_path / "c.json"))
    assert images.first()["file_name"] == "train/7.jpg" and annotations.count() == categories.count() == 1
    (tmp_path / "k.txt").write_text("# note\n\n a \nb\n")
    assert [r["key"] for r in jsonl.read_keys(spark, str(tmp_path / "k.txt")).collect()] == ["a", "b"]
    for name in ("img10.jpg", "img2.jpg"):
        folder = tmp_path / "root" / "mission" / "审核通过" / "group"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    got = jsonl.image_tree(spark, str(tmp_path / "root")).collect()
    assert len(got) == 1 and got[0]["label"] == "pass" and [p[-9:] for p in got[0]["images"]] == ["/img2.jpg", "img10.jpg"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "train"), (2, None, "val")], "id long, t string, part string")
    path = str(tmp_path / "o")
    sinks.write_jsonl(df, path)
    sinks.replace(spark.read.schema(df.schema).json(path).where("id = 1"), path)
    assert [r["t"] for r in spark.read.schema(df.schema).json(path).collect()] == ["é"]
    for _ in range(4):
        last = sinks.write_version(df, str(tmp_path / "v"), keep=2)
    assert last.endswith("v00000004") and len([p for p in (tmp_path / "v").iterdir() if p.is_dir()]) == 2
    assert sinks.read_version(spark, str(tmp_path / "v")).count() == 2
    sinks.write_splits(df, str(tmp_path / "s"))
    sinks.write_keys(df, str(tmp_path / "k"), "part", "id")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert (tmp_path / "s" / "part=val").exists() and (tmp_path / "k" / "part=train").exists()


def stream(spark, frame, mode, name):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_state_machine_and_packs(spark, tmp_path):
    rows = [("s1", 1, "a", False), ("s1", 2, "b", False), ("s2", 1, "a", True), ("s3", 1, "a", False)]
    schema = "signature string, cycle long, key string, rejected boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "p"))
    got = stream(spark, progress.promote(progress.read_jsonl(spark, str(tmp_path / "p"), schema)), "update", "promoted")
    assert {r["signature"]: r["status"] for r in got} == {"s1": "promoted", "s2": "rejected", "s3": "candidate"}
    spark.createDataFrame([("g", k, n) for k, n in enumerate([3, 4, 5, 10, 2])], "g string, ordinal long, n long").coalesce(1).write.json(str(tmp_path / "q"))
    frame = progress.read_jsonl(spark, str(tmp_path / "q"), "g string, ordinal long, n long")
    got = stream(spark, progress.packs(frame, "g", "n", 8), "append", "packed")
    assert sorted((r["pack"], r["n"]) for r in got) == [(0, 3), (0, 4), (1, 5), (2, 10), (3, 2)]


def test_packs_of_a_group_that_comes_in_many_frames(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'a' AS g", "id AS ordinal", "id * 37 % 23 AS n")
    rows.orderBy(F.xxhash64("ordinal")).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = stream(spark, progress.packs(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "g", "n", 40), "append", "many")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    pack, total, want = -1, 0, []
    for n in (i * 37 % 23 for i in range(3000)):
        pack, total = (pack + 1, n) if pack < 0 or total + n > 40 else (pack, total + n)
        want.append((pack, n))
    assert sorted((r["pack"], r["n"]) for r in got) == sorted(want)
