"""Image heads, JSON lines, guidance, ordered streams, payloads, table functions, phrases, workbooks, conversion jobs."""

import difflib
import io
import json
import random
import struct
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import payloads, phrases, records, tables
from granary.operators import converter, guidance
from granary.sources import images, jsonl, workbook
from granary.streaming import ordered

# --- images ---


def jpeg(w, h, orientation=None, little=True, before=b"", frame=0xC0):
    out = b"\xff\xd8\xff\xe0\x00\x06JFIF" + before
    if orientation is not None:
        e = "<" if little else ">"
        tiff = (b"II*\0" if little else b"MM\0*") + struct.pack(e + "IHHHIH", 8, 2, 0x100, 3, 1, 7) + b"\0\0" + struct.pack(e + "HHIH", 0x112, 3, 1, orientation) + b"\0\0"
        out += b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return out + b"\xff" + bytes([frame]) + b"\x00\x11\x08" + struct.pack(">HH", h, w) + b"rest" * 9


def test_image_files_beside_annotations(spark, tmp_path):
    long = b"".join(b"\xff\xe2\xff\xff" + bytes(65533) for _ in range(4))
    files = {
        "a/1.jpeg": jpeg(640, 480),
        "a/1.jpg": b"never looked at",
        "a/2.jpg": jpeg(640, 480, 6),
        "a/3.jpg": jpeg(5, 70000 % 65536, 8, little=False, before=long, frame=0xC2),
        "b/4.jpg": jpeg(9, 8, 300),
        "b/5.jpg": jpeg(9, 8)[:16],
        "b/6.jpg": b"",
        "b/7.jpg": b"\xff\xd8\xff\xda\x00\x02",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    good = {"info": {"width": 1, "height": 2}, "dataList": []}
    texts = {"a/1": good, "a/2": {"info": {"width": 1, "height": None}, "markResult": {"features": []}}, "a/3": {"info": {"width": 1}, "dataList": []}, "b/4": {"info": {"width": 1, "height": 2}, "dataList": "[]"}, "b/5": good, "b/6": [good], "b/7": good, "b/8": good}
    for name, doc in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = {r["path"][-8:-5]: r for r in images.image_scan(spark, str(tmp_path)).collect()}
    assert [(k, r["image_width"], r["image_height"], r["fault"]) for k, r in sorted(got.items())] == [
        ("a/1", 640, 480, None), ("a/2", 480, 640, None), ("a/3", 70000 % 65536, 5, "size"), ("b/4", 9, 8, "data"), ("b/5", None, None, None), ("b/6", None, None, "json"), ("b/7", None, None, None), ("b/8", None, None, "image"),
    ]
    assert got["a/1"]["image_path"].endswith("1.jpeg") and got["a/3"]["orientation"] == 8 and got["b/4"]["orientation"] == 1 and got["a/2"]["width"] == 1
    with pytest.raises(ValueError, match="a/3.json: size"):
        images.image_scan(spark, str(tmp_path), strict=True)
    assert images.image_heads(spark.createDataFrame([("x", None)], "path string, content binary")).first()["kind"] is None


# --- JSON lines, tickets, COCO ---


def test_faulty_lines_have_their_numbers(spark, tmp_path):
    rows = ['{"a":1}', "", '[{"a":5},{"a":6}]', '{"a":2} x', '{"a":3},{"a":4}', "5", '"s"', "null", '{"a":"q"}', '  {"a":7}  ', '{"a":8', "[1"] + ['{"a":9}' if k % 7 else "bad" for k in range(3000)]
    (tmp_path / "f.jsonl").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = [(r["line"], r["fault"]) for r in jsonl.faults(spark, str(tmp_path), "a int").orderBy("line").collect()]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    head = [(3, "kind"), (4, "malformed"), (5, "malformed"), (6, "kind"), (7, "kind"), (8, "kind"), (9, "malformed"), (11, "malformed"), (12, "malformed")]
    assert got == head + [(13 + k, "malformed") for k in range(0, 3000, 7)]
    with pytest.raises(ValueError, match=r"f.jsonl:3 \(kind\)"):
        jsonl.read(spark, str(tmp_path), "a int", "strict")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.jsonl").write_text('{"a":1}\n\n{"a":2}')
    assert jsonl.read(spark, str(tmp_path / "g"), "a int", "strict").count() == 2
    assert jsonl.read(spark, str(tmp_path / "f.jsonl"), "a int").where("a IS NULL").count() == 0


def test_tickets_missing_files_and_none_at_all(spark, tmp_path, caplog):
    gone = str(tmp_path / "gone.jsonl")
    with pytest.raises(ValueError, match="none of the files"):
        jsonl.read_tickets(spark, [gone], require=True)
    good, rejected = jsonl.read_tickets(spark, [gone])
    assert good.count() == rejected.count() == 0 and gone in caplog.text
    (tmp_path / "t.jsonl").write_text('{"group_id":"g","label":"?"}\n[1]\n')
    with pytest.raises(ValueError, match="no row"):
        jsonl.read_tickets(spark, [gone, str(tmp_path / "t.jsonl")], require=True)


def test_station_distance_is_stripped(spark):
    texts = [
        "无关图片 x", None, "", "plain",
        '<DOMAIN=BBU>, <TASK=SUMMARY>\n{"备注": [], "统计": [{"类别": "站点距离", "a": {"b": 1}}, {"类别": "BBU"}], "分组统计": {"站点距离": 1, "BBU": 2}, "x": "站点距离5"}',
        '{"统计": [{"类别": "BBU"}, {"类别": "站点距离", "站点距离": {"5": 1}}, {"类别": "光纤"',
        '统计 {"类别": "站点距离"}, {"类别": "BBU"}, "分组统计": {"站点距离": {"a": 1}, "BBU": 2} 站点距离',
        'x {"统计": [{"类别": "站点距离", "站点距离": {"5"',
    ]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    got = df.select(records.strip_station_distance("t").alias("t")).first()["t"]
    assert got[:4] == ["无关图片", None, "", "plain"]
    assert got[4] == '{"统计": [{"类别": "BBU"}], "备注": [], "分组统计": {"BBU": 2}, "x": "5"}'
    assert got[5] == '{"统计": [{"类别": "BBU"}, {"类别": "光纤"' and "BBU" in got[6]
    assert not any("站点距离" in t for t in got if t) and '{"类别": "BBU"}' in got[6] and '"BBU": 2' in got[6] and got[7] == 'x {"统计": ['


def test_coco_file_without_a_collection(spark, tmp_path):
    doc = {"images": [{"id": 1, "coco_file_name": "c.jpg", "file_name": "f.jpg"}, {"id": 2, "coco_file_name": "", "file_name": "f.jpg"}, {"id": 3, "coco_url": "x.jpg"}], "annotations": [], "categories": [{"id": 1, "name": "n"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    found, marks, kinds = jsonl.read_coco(spark, str(tmp_path / "a.json"))
    assert [r["file_name"] for r in found.orderBy("id").collect()] == ["c.jpg", "f.jpg", None] and marks.count() == 0 and kinds.first()["frequency"] == "unknown"
    del doc["annotations"]
    (tmp_path / "b.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="annotations"):
        jsonl.read_coco(spark, str(tmp_path / "b.json"))


# --- guidance ---


def test_block_ratio_is_that_of_difflib(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab接地c ") for _ in range(rng.randrange(0, 300 if rng.random() < 0.05 else 30)))
    pairs = []
    for k in range(10_000):
        a = word()
        b = a[: rng.randrange(len(a) + 1)] + rng.choice("xyab") + a[rng.randrange(len(a) + 1) :] if k % 2 else word()
        pairs.append((k, a, b))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    got = df.select("k", guidance.block_ratio()("a", "b").alias("r"), guidance.block_ratio(0.9)("a", "b").alias("s")).collect()
    for r in got:
        _, a, b = pairs[r["k"]]
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert r["r"] == want and (r["s"] == want if want >= 0.9 else r["s"] < 0.9)


def test_similar_guidance_takes_the_first_near_match(spark):
    book = [("m", "S1", 0, "check the ground bar"), ("m", "G2", 1, "check the ground bars now"), ("m", "G3", 2, "Check, the ground bar."), ("m", "G4", 3, "check the ground bar"), ("n", "G5", 1, "check the ground bar"), ("m", "G6", 4, " ")]
    texts = [(1, "m", "check the ground bar"), (2, "n", "check the ground bat"), (3, "m", "label missing"), (4, "o", "check"), (5, "m", "?!"), (6, "m", "check the ground bars nou")]
    got = guidance.similar_guidance(spark.createDataFrame(texts, "id int, mission string, text string"), spark.createDataFrame(book, "mission string, guidance_key string, ordinal int, text string"), "id", "mission")
    assert {r["id"]: r["guidance_key"] for r in got.collect()} == {1: "G3", 2: "G5", 3: None, 4: None, 5: None, 6: "G2"}


# --- streams ---


def run(spark, path, schema, make, rows=0):
    """A stream over the new files until they end, or, where it would go on, until it has read so many rows."""
    with ordered.rocksdb(spark):
        made = make(spark.readStream.schema(schema).json(f"{path}/in"))
        out = made.writeStream.format("json").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        if rows:
            job, until = out.start(), time.time() + 40
            while sum(p["numInputRows"] for p in job.recentProgress) < rows and time.time() < until:
                time.sleep(0.3)
            job.stop()
        else:
            out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).json(f"{path}/out").collect()


def test_rows_come_in_order_over_a_restart(spark, tmp_path):
    schema = "g string, seq long, p string, bad boolean"
    first = [("a", 2, "a2", False), ("a", 0, "a0", False), ("a", 0, "again", False), ("b", 1, "b1", False), ("a", 3, "a3", True)]
    later = [("a", 1, "a1", False), ("a", 2, "late", False), ("a", 5, "a5", False), ("b", 2, "b2", False)]
    spark.createDataFrame(first, schema).write.json(f"{tmp_path}/in")
    make = lambda rows: ordered.in_order(rows, "g", "seq", "p", "bad")
    assert [(r["g"], r["place"], r["seq"]) for r in run(spark, tmp_path, schema, make)] == [("a", 0, 0)]
    spark.createDataFrame(later, schema).write.mode("append").json(f"{tmp_path}/in")
    got = sorted((r["g"], r["place"], r["seq"], r["p"]) for r in run(spark, tmp_path, schema, make))
    assert [x[:3] for x in got] == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2)] and got[2][3] == "a2"  # 3 failed, 4 never came, b waits for 0
    spark.createDataFrame([("b", 0, "b0", True), ("a", 4, "a4", False)], schema).write.mode("append").json(f"{tmp_path}/in")
    got = sorted((r["g"], r["place"], r["seq"]) for r in run(spark, tmp_path, schema, make))
    assert got[3:] == [("a", 3, 4), ("a", 4, 5), ("b", 0, 1), ("b", 1, 2)]


def test_first_arrivals_over_a_restart_with_time_to_live(spark, tmp_path):
    schema = "s string, o string, n long"
    make = lambda rows: ordered.first_arrivals(rows, "s", "o", "n", ttl="1 hour", parts=3)
    spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("a", "y", 5), ("b", "x", 3)], schema).write.json(f"{tmp_path}/in")
    assert sorted(tuple(r) for r in run(spark, tmp_path, schema, make, 4)) == [("a", "x", 1), ("a", "y", 5), ("b", "x", 3)]
    spark.createDataFrame([("a", "x", 0), ("b", "y", 7)], schema).write.mode("append").json(f"{tmp_path}/in")
    assert sorted(tuple(r) for r in run(spark, tmp_path, schema, make, 2)) == [("a", "x", 1), ("a", "y", 5), ("b", "x", 3), ("b", "y", 7)]


# --- payloads ---


def random_json(rng, depth=3):
    kind = rng.randrange(6 if depth else 4)
    if kind >= 4:
        return {rng.choice("abcd"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(3), "é", [1, rng.randrange(2)]][rng.randrange(5)]


def test_merge_and_differences_of_random_documents(spark):
    rng = random.Random(6)
    docs = [(k, *({rng.choice("abcd"): random_json(rng) for _ in range(3)} for _ in range(2))) for k in range(500)]

    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in docs], "k int, a string, b string")
    for r in df.select("k", payloads.deep_merge("a", "b").alias("m"), payloads.differences("a", "b").alias("d")).collect():
        _, a, b = docs[r["k"]]
        assert json.loads(r["m"]) == merge(a, b)
        undone = json.loads(json.dumps(b))
        for path, left, _ in r["d"]:  # put back what differs
            *where, last = path.split(".")
            at = undone
            for step in where:
                at = at[step]
            if left is None:
                del at[last]
            else:
                at[last] = json.loads(left)
        assert undone == a and (a == b) == (not r["d"])
    nulls = spark.createDataFrame([(None, None), ('{"a":1}', None), (None, '{"a":1}')], "a string, b string")
    got = [(r["m"], len(r["d"])) for r in nulls.select(payloads.deep_merge("a", "b").alias("m"), payloads.differences("a", "b").alias("d")).collect()]
    assert got == [(None, 0), ('{"a":1}', 1), ('{"a":1}', 1)]


def test_lenient_hypotheses(spark):
    rows = ['{"signature": 5, "falsifier": "", "promoted_at": null, "support_cycles": 1e2, "support_cycle_ids": [true, "1_0", "+2", [], 1.9]}', "[]", "x", None, '{"status": " ", "text": [1]}']
    got = [r["h"] for r in spark.createDataFrame([(r,) for r in rows], "p string").select(payloads.hypothesis(F.col("p")).alias("h")).collect()]
    assert got[1] is got[2] is got[3] is None
    assert (got[0]["signature"], got[0]["falsifier"], got[0]["promoted_at"], got[0]["support_cycles"], got[0]["support_cycle_ids"]) == ("5", "", None, 100, [1, 10, 2, 1])
    assert got[4]["text"] == "[1]" and got[4]["support_ticket_keys"] == []


def test_a_hypothesis_is_parsed_once(spark):
    rows = spark.range(3).select(F.format_string('{"status": %d, "text": {"a": [%d]}, "support_ticket_keys": [{"k": 1}, null, " "]}', "id", "id").alias("p"))
    found = rows.select(payloads.hypothesis(F.col("p")).alias("h"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1, plan
    got = [(r["h"]["status"], r["h"]["text"], r["h"]["support_ticket_keys"]) for r in found.collect()]
    assert got == [("candidate", '{"a":[0]}', ['{"k":1}', "null"]), ("1", '{"a":[1]}', ['{"k":1}', "null"]), ("2", '{"a":[2]}', ['{"k":1}', "null"])]


# --- table functions ---


def test_table_functions_check_their_tables(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="lacks segmentation"):
        spark.sql("SELECT * FROM polygons(TABLE(SELECT 1 AS annotation_id, 2 AS width, 3 AS height))").collect()
    rows = spark.sql("SELECT * FROM polygons(TABLE(SELECT 1 AS annotation_id, array(array(0D, 0D, 4D, 0D, NULL, 4D), NULL, array(-11D, 0D, 4D, 0D, 4D, 4D), array(-9D, 0D, 4D, 0D, 4D, 4D)) AS segmentation, 5 AS width, 5 AS height))").collect()
    assert [(r["part"], r["kind"]) for r in rows] == [(3, "poly")]


# --- phrases ---


def test_phrases_against_a_plain_loop(spark):
    rng = random.Random(8)
    table = {"".join(rng.choice("abc繁體") for _ in range(rng.randrange(1, 5))): rng.choice(["", "x", "简", "ab"]) for _ in range(60)}

    def plain(text):
        out, at = "", 0
        while at < len(text):
            for n in range(4, 0, -1):
                if text[at : at + n] in table and len(text[at : at + n]) == n:
                    out, at = out + table[text[at : at + n]], at + n
                    break
            else:
                out, at = out + text[at], at + 1
        return out

    texts = [None, ""] + ["".join(rng.choice("abc繁體d") for _ in range(rng.randrange(40))) for _ in range(10_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in df.select("k", phrases.converted(F.col("t"), table).alias("c")).collect():
        assert r["c"] == (None if texts[r["k"]] is None else plain(texts[r["k"]]))
    with pytest.raises(ValueError, match="more than 1"):
        phrases.phrase_table(spark.createDataFrame([("a", "b"), ("c", "d")], "p string, r string"), "p", "r", most=1)


# --- workbooks ---


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="s"><v>0</v></c><c r="F2" t="str"><v>why</v></c><c r="G2"><v>2.0</v></c></row><row><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row><row r="9"/></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>mission</t></si><si><t>g1</t></si></sst>")
    (tmp_path / "w.xlsx").write_bytes(out.getvalue())
    rows = workbook.workbook_rows(workbook.workbook_files(spark, str(tmp_path)))
    assert [(r["row"], r["cells"]) for r in rows.orderBy("row").collect()] == [(2, ["g1", None, "mission", None, None, "why", "2.0"]), (3, ["1", None, "ab"]), (9, [])]
    assert [tuple(r) for r in workbook.fail_reasons(rows).collect()] == [("g1", "mission", ["why"])]


def test_written_workbooks_are_read_back(spark):
    data = [("x", k, f"<&é {k}" if k % 3 else None, k / 4) for k in range(25_000)] + [("y", 1, "", 1.0)]
    df = spark.createDataFrame(data, "book string, k int, t string, v double")
    books = workbook.workbooks(df, "book", "k", ["k", *["t"] * 27, "v"])
    got = workbook.workbook_rows(books.withColumnRenamed("book", "path")).collect()
    assert len(got) == len(data)
    for r in got:
        k = int(r["cells"][0])
        assert r["row"] == (k + 1 if r["path"] == "x" else 1) and r["cells"][27] == ((f"<&é {k}" if k % 3 else None) if r["path"] == "x" else "") and float(r["cells"][28]) == (k / 4 if r["path"] == "x" else 1.0)


# --- conversion ---


def test_conversion_counts_come_from_the_writing_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["c"]), (4, [])], "id int, objects array<string>")
    made = lambda df: df.withColumn("keep", F.when(F.col("id") != 4, F.col("id") != 3))
    got = converter.convert(rows, made, f"{tmp_path}/out", counts={"large": F.count_if(F.size("objects") > 1)})
    assert got == {"total_images": 2, "total_objects": 2, "skipped_images": 2, "large": 1}
    assert spark.read.json(f"{tmp_path}/out").count() == 2 and spark.read.json(f"{tmp_path}/out_stats").first()["skipped_images"] == 2


def test_large_groups_are_several_workbooks(spark):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 > 0 THEN 'b' END AS book", "id AS k", "id AS v")
    books = workbook.workbooks(df, "book", "k", ["k", "v"], most=100)
    assert {(r["book"], r["count"]) for r in books.groupBy("book").count().collect()} == {("b", 6), (None, 3)}
    got = [(r["book"], r["cells"]) for r in workbook.workbook_rows(books.selectExpr("coalesce(book, '') AS book", "content").withColumnRenamed("book", "path")).selectExpr("path AS book", "cells").collect()]
    assert len(got) == 900 and {int(c[0]) for _, c in got} == set(range(900))


class _Calls(dict):
    """A map of the state store that counts what is asked of it."""

    calls = 0

    def _asked(self, result):
        self.calls += 1
        return result

    def containsKey(self, key):
        return self._asked(key in self)

    def getValue(self, key):
        return self._asked(self[key])

    def updateValue(self, key, value):
        self._asked(self.__setitem__(key, value))

    def removeKey(self, key):
        self._asked(self.pop(key))


def _fed(processor, frames):
    import pandas as pd

    maps = {}
    processor.init(type("Handle", (), {"getMapState": lambda self, name, *_: maps.setdefault(name, _Calls())})())
    rows = [list(r) for f in frames for part in processor.handleInputRows((0,), iter([pd.DataFrame(f, columns=processor.columns)]), None) for r in part.itertuples(index=False, name=None)]
    return rows, sum(m.calls for m in maps.values()), maps


def test_waiting_rows_cost_state_calls_by_page():
    """2,500 rows that wait for the first one cost some calls, not some per row; a null group is one of its own."""
    late = [("g", s, str(s), s % 2 == 1) for s in range(1, 2501)]
    rows, calls, maps = _fed(ordered._InOrder(["g", "seq", "p", "bad"], 0), [late + [(None, 0, "n", False)], [("g", 0, "0", False), ("g", 7, "again", False)]])
    assert rows == [[None, 0, 0, "n"]] + [["g", k, 2 * k, str(2 * k)] for k in range(1251)]
    assert calls < 30 and not maps["waiting"] and maps["place"]["g",] == (2501, 1251)


def test_first_arrivals_of_many_streams_in_a_part():
    """one group holds many streams; each keeps its own objects and the smallest ordinal of a batch."""
    rows, calls, _ = _fed(ordered._FirstArrivals(["s", "o", "n"], None), [[("a", "x", 5), ("b", "x", 4), ("a", "x", 3)], [("a", "x", 1), ("a", "y", 2)]])
    assert rows == [["a", "x", 3], ["b", "x", 4], ["a", "y", 2]] and calls == 7
