"""JSON-lines and other text sources, with declared schemas."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import shared_path

CORRUPT = "_corrupt_record"
#: Annotation records and ticket rows as they lie in JSON lines.
OBJECT = "bbox_2d:array<double>,poly:array<double>,line:array<double>,poly_points:int,line_points:int,desc:string"
RECORD_SCHEMA = f"images array<string>, width int, height int, summary string, objects array<struct<{OBJECT}>>"
TICKET_SCHEMA = "group_id string, mission string, label string, images array<string>, per_image map<string,string>, label_timestamp string, gt_fail_reason_text string"


def lines(spark: SparkSession, paths) -> DataFrame:
    """value, path, block, ordinal of text lines; blank lines count.

    ``block`` is the place in the file where the part begins that a task reads,
    and ``ordinal`` ascends within a block by one a line.
    """
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(paths).select("value", *place, F.monotonically_increasing_id().alias("ordinal"))


def _fault(value: Column, parsed: Column) -> Column:
    """What is wrong with a line: 'malformed', or 'kind' for JSON that is no object; blank lines are fine."""
    from granary.functions.jsonx import is_object
    from granary.functions.text import strip_blanks

    text = strip_blanks(value)
    listed = F.rlike(text, F.lit(r'^(?s)(\[.*\]|".*"|-?[0-9][0-9.eE+-]*|true|false|null)$')) & (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1)
    good = F.startswith(text, F.lit("{")) & is_object(text) & parsed[CORRUPT].isNull()
    return F.when((text == "") | F.coalesce(good, F.lit(False)), None).when(F.coalesce(listed, F.lit(False)), "kind").otherwise("malformed")


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the line as a struct of the schema and CORRUPT, and its fault."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    with_line = rows.where(~F.rlike("value", F.lit(r"(?U)^\s*$"))).withColumn("parsed", F.from_json("value", f"{schema}, {CORRUPT} string", options))
    return with_line.withColumn("fault", _fault(F.col("value"), F.col("parsed")))


def faults(spark: SparkSession, paths, schema: str) -> DataFrame:
    """path, line (from 1), fault, value of lines that are no JSON objects of the schema.

    Files are read in parts, as Spark splits them: a part counts its lines, the
    counts are summed over a file's parts, and a faulty line adds its place.
    """
    bad = _parsed(lines(spark, paths), schema).where("fault IS NOT NULL").select("path", "block", "ordinal", "fault", "value")
    blocks = lines(spark, paths).groupBy("path", "block").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a file
    at = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return bad.join(at, ["path", "block"]).select("path", (F.col("before") + F.col("ordinal") - F.col("first") + 1).alias("line"), "fault", "value")


def read(spark: SparkSession, paths, schema: str, mode: str = "lenient") -> DataFrame:
    """JSON lines that are objects; blank lines are skipped, and lists and scalars are faults like malformed lines.

    lenient: faulty lines are left out; strict: the first one is an error that
    names file and line, raised here after one pass over the files; quarantine:
    they come in CORRUPT.
    """
    if mode == "strict":
        first = faults(spark, paths, schema).orderBy("path", "line").first()
        if first:
            raise ValueError(f"no JSON object at {first['path']}:{first['line']} ({first['fault']})")
    rows = _parsed(spark.read.text(paths), schema)
    fields = [f.name for f in rows.schema["parsed"].dataType.fields if f.name != CORRUPT]
    good = F.col("fault").isNull()
    if mode != "quarantine":
        return rows.where(good).select(*[F.col("parsed")[n].alias(n) for n in fields])
    return rows.select(*[F.when(good, F.col("parsed")[n]).alias(n) for n in fields], F.when(~good, F.col("value")).alias(CORRUPT))


def with_image_paths(rows: DataFrame, column: str = "images") -> DataFrame:
    """Relative image paths joined to the folder of the file they were read from."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    absolute = lambda p: p.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    return rows.withColumn(column, F.transform(column, lambda p: F.when(absolute(p), p).otherwise(F.concat(folder, F.lit("/"), p))))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths (or patterns) that match something; the others are told in a warning."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        matches = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        if matches:
            found.append(path)
        else:
            logging.getLogger(__name__).warning("left out, there is no such file: %s", path)
    return found


TICKET = ("ticket", "group_id", "mission", "label", "images", "texts", "labelled_at", "gt_fail_reason_text")


def judged_tickets(spark: SparkSession, paths: list[str], require: bool = False) -> DataFrame:
    """Every row of the files with its ``reason``, null for a ticket: raw, the row as it was read, and a ticket's columns.

    One pass over the files, for those who want tickets and rejected rows alike;
    see ``read_tickets``. What is not a ticket has its columns null.
    """
    from granary.functions.records import strip_station_distance
    from granary.functions.text import normal_label

    paths = existing(spark, paths)
    if not paths and require:
        raise ValueError("no tickets: none of the files exists")
    if not paths:
        paths = [shared_path(spark, "no-tickets")]
        spark.createDataFrame([], "value string").write.text(paths[0])
    raw = read(spark, paths, TICKET_SCHEMA, "quarantine")
    number = lambda k: F.coalesce(F.regexp_extract(k, "([0-9]+)", 1).try_cast("int"), F.lit(0))
    texts = F.transform(F.sort_array(F.transform(F.map_entries("per_image"), lambda e: F.struct(number(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: e["value"])
    label = normal_label(F.col("label"))
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "malformed")
        .when(F.col("_label").isNull(), "label")
        .when(F.coalesce(F.size("images"), F.lit(0)) < 1, "images")
        .when(F.coalesce(F.size(F.map_keys("per_image")), F.lit(0)) < 1, "texts")
    )
    judged = raw.withColumn("_label", label).select(F.struct(*raw.columns).alias("raw"), *raw.columns, "_label", reason.alias("reason"))
    judged = judged.withColumn("_texts", F.when(F.col("reason").isNull(), texts))
    kept = F.startswith(F.trim(F.coalesce("mission", F.lit(""))), F.lit("RRU"))
    # Only texts that may lose something go to Python.
    judged = judged.withColumns({"_kept": kept, "_bare": strip_station_distance(F.when(~kept, F.col("_texts")))})
    ticket = {
        "ticket": F.concat_ws("::", "group_id", "_label"),
        "group_id": F.col("group_id"),
        "mission": F.col("mission"),
        "label": F.col("_label"),
        "images": F.col("images"),
        "texts": F.when(F.col("_kept"), F.col("_texts")).otherwise(F.col("_bare")),
        "labelled_at": F.try_to_timestamp("label_timestamp"),
        "gt_fail_reason_text": F.col("gt_fail_reason_text"),
    }
    found = judged.select("raw", "reason", *[F.when(F.col("reason").isNull(), ticket[n]).alias(n) for n in TICKET])
    if require and found.where("reason is null").select("reason").isEmpty():
        raise ValueError("no tickets: no row of the files is one")
    return found


def read_tickets(spark: SparkSession, paths: list[str], require: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tickets, rejected): rows with a known label, images and texts; the others with a reason.

    Missing files are left out with a warning. Ticket keys are group_id::label;
    image texts are numbered anew in order of the numbers in their keys, and
    lose what they say about the station distance unless the mission begins with
    RRU; timestamps that do not parse are null. With ``require``, it is an error
    if there is no ticket at all.
    """
    judged = judged_tickets(spark, paths, require)
    return judged.where("reason is null").select(*TICKET), judged.where("reason is not null").select("raw.*", "reason")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """One key a line; blanks and lines that start with # are left out."""
    key = F.trim("value")
    return spark.read.text(path).select(key.alias("key")).where((F.col("key") != "") & ~F.startswith("key", F.lit("#")))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO-style file.

    An image's file_name is its coco_file_name, else its file_name, else the
    last two parts of its URL. A file without one of the collections is an error.
    """
    schema = (
        "images array<struct<id:bigint,coco_file_name:string,file_name:string,coco_url:string,width:int,height:int>>, "
        "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,segmentation:array<array<double>>,iscrowd:int,area:double>>, "
        "categories array<struct<id:int,name:string,frequency:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    collections = ("images", "annotations", "categories")
    missing = doc.agg(*[F.bool_and(F.col(c).isNotNull()).alias(c) for c in collections]).first()
    if not all(missing):
        raise ValueError(f"{path} lacks {', '.join(c for c in collections if not missing[c])}")
    part = lambda c: doc.select(F.explode(c).alias("x")).select("x.*")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    from_url = F.when(F.contains("coco_url", F.lit("/")), F.substring_index("coco_url", "/", -2))
    images = part("images").withColumn("file_name", F.coalesce(given("coco_file_name"), given("file_name"), from_url)).drop("coco_file_name")
    return images, part("annotations"), part("categories").withColumn("frequency", F.coalesce("frequency", F.lit("unknown")))


def image_tree(spark: SparkSession, root: str) -> DataFrame:
    """mission, label, group_id, images of root/mission/{审核不通过,审核通过}/group/*.jpg, images in natural order."""
    from granary.functions.text import natural_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(root).select("path")
    part = lambda k: F.element_at(F.split("path", "/"), k)
    label = F.when(part(-3) == "审核通过", "pass").when(part(-3) == "审核不通过", "fail")
    group = F.coalesce(F.nullif(F.regexp_extract(part(-2), r"(QC-[A-Z]+-\d{8}-\d+)", 1), F.lit("")), part(-2))
    rows = files.select(part(-4).alias("mission"), label.alias("label"), group.alias("group_id"), "path", natural_key(F.col("path")).alias("k")).where("label is not null")
    grouped = rows.groupBy("mission", "label", "group_id").agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("p"))
    return grouped.select("mission", "label", "group_id", F.transform("p", lambda x: x["path"]).alias("images"))
