"""Image files: sizes and orientation from their heads, and annotation files with the image beside them.

Heads are parsed by built-in functions where Spark has read the file, so no
image leaves the JVM and no decoder is needed: JPEG segments are walked up to the
frame header (orientation from an EXIF segment before it), PNG gives its header
chunk. Whatever else a file is, or a head that breaks off, gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: JPEG segments before the frame header: a profile takes up to 255.
SEGMENTS = 300
ORIENTATION_TAG = 0x0112
#: Markers: start of frame but for tables and arithmetic conditioning, markers without a length, and those that end a search.
FRAMES = [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
BARE = [0x01, *range(0xD0, 0xD8)]
ENDS = [0xD8, 0xD9, 0xDA]
ANNOTATION_FAULTS = ("json", "size", "data", "image")


def _byte(content: Column, at: Column) -> Column:
    """The byte at a place (from 1), null beyond the end."""
    return F.conv(F.hex(F.substring(content, at, F.lit(1))), 16, 10).cast("int")


def _number(content: Column, at: Column, size: int, little: Column | None = None) -> Column:
    """A number of ``size`` bytes, big-endian unless ``little``."""
    parts = [_byte(content, at + k) for k in range(size)]
    big = sum((p.cast("long") * (1 << 8 * (size - 1 - k)) for k, p in enumerate(parts[1:], 1)), parts[0].cast("long") * (1 << 8 * (size - 1)))
    if little is None:
        return big
    small = sum((p.cast("long") * (1 << 8 * k) for k, p in enumerate(parts[1:], 1)), parts[0].cast("long"))
    return F.when(little, small).otherwise(big)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _orientation(content: Column, base: Column) -> Column:
    """The orientation in the first directory of a TIFF head that starts at ``base``; null if it has none from 1 to 8."""

    def of_directory(d: Column) -> Column:
        at = lambda k: d["first"] + 2 + 12 * k
        entries = F.least(_number(content, d["first"], 2, d["little"]), F.lit(4096)).cast("int")
        numbers = F.when(entries > 0, F.sequence(F.lit(0), entries - 1))
        found = F.get(F.filter(numbers, lambda k: _number(content, at(k), 2, d["little"]) == ORIENTATION_TAG), F.lit(0))
        return _let(found, lambda k: _number(content, at(k) + 8, 2, d["little"]).cast("int"))

    head = _let(base, lambda b: F.struct((F.substring(content, b, F.lit(2)) == F.lit(b"II")).alias("little"), b.alias("base")))
    directory = _let(head, lambda h: F.struct(h["little"].alias("little"), (h["base"] + _number(content, h["base"] + 4, 4, h["little"])).cast("int").alias("first")))
    value = _let(directory, of_directory)
    return _let(value, lambda v: F.when(v.between(1, 8), v))


def _jpeg(content: Column) -> Column:
    """width, height, exif (where its TIFF head starts) as a struct."""
    none = F.lit(None)

    def state(at, width, height, exif, going) -> Column:
        return F.struct(at.cast("int").alias("at"), width.cast("int").alias("width"), height.cast("int").alias("height"), exif.cast("int").alias("exif"), going.alias("going"))

    def next_of(s: Column, m: Column) -> Column:
        at, marker, size = s["at"], m["marker"], m["size"]
        exif = F.coalesce(s["exif"], F.when((marker == 0xE1) & (F.substring(content, at + 4, F.lit(6)) == F.lit(b"Exif\x00\x00")), at + 10))
        stop = state(at, none, none, s["exif"], F.lit(False))
        return (
            F.when((m["mark"] != 0xFF) | marker.isNull() | marker.isin(ENDS), stop)
            .when(marker == 0xFF, state(at + 1, none, none, s["exif"], F.lit(True)))
            .when(marker.isin(BARE), state(at + 2, none, none, s["exif"], F.lit(True)))
            .when(marker.isin(FRAMES), state(at, m["wide"], m["high"], s["exif"], F.lit(False)))
            .when(size.isNull() | (size < 2), stop)
            .otherwise(state(at + 2 + size, none, none, exif, F.lit(True)))
        )

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        read = F.struct(_byte(content, at).alias("mark"), _byte(content, at + 1).alias("marker"), _number(content, at + 2, 2).alias("size"), _number(content, at + 5, 2).alias("high"), _number(content, at + 7, 2).alias("wide"))
        return F.when(~s["going"], s).otherwise(_let(read, lambda m: next_of(s, m)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), state(F.lit(3), none, none, none, F.lit(True)), step)


def image_heads(files: DataFrame) -> DataFrame:
    """``files`` (with ``content``) without it, and kind, stored_width, stored_height, orientation (1 where none is given), width, height.

    width and height are those of the image as it is to be seen: turned where
    the orientation says so.
    """
    content = F.col("content")
    kind = F.when(F.substring(content, F.lit(1), F.lit(2)) == F.lit(b"\xff\xd8"), "jpeg").when(F.substring(content, F.lit(1), F.lit(8)) == F.lit(b"\x89PNG\r\n\x1a\n"), "png")
    read = files.withColumn("kind", kind).withColumn("head", F.when(F.col("kind") == "jpeg", _jpeg(content)))
    png = lambda at: F.when((F.col("kind") == "png") & (F.substring(content, F.lit(13), F.lit(4)) == F.lit(b"IHDR")), _number(content, F.lit(at), 4)).cast("int")
    sized = read.select(
        *[c for c in files.columns if c != "content"],
        "kind",
        F.coalesce("head.width", png(17)).alias("stored_width"),
        F.coalesce("head.height", png(21)).alias("stored_height"),
        F.when(F.col("kind").isNotNull(), F.coalesce(F.when(F.col("head.exif").isNotNull(), _orientation(content, F.col("head.exif"))), F.lit(1))).alias("orientation"),
    )
    turned = F.col("orientation") >= 5
    return sized.select("*", F.when(turned, F.col("stored_height")).otherwise(F.col("stored_width")).alias("width"), F.when(turned, F.col("stored_width")).otherwise(F.col("stored_height")).alias("height"))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of all JPEG files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpeg,jpg}").load(root).select("path", "content")


def annotation_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of all JSON files under a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def with_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Each annotation file with the image of its stem (.jpeg before .jpg), sizes of both, and what is wrong with it.

    annotations: path, text; images: rows of ``image_heads``. fault: 'json' (no
    object), 'size' (its info lacks height or width), 'data' (neither a dataList
    nor features of a markResult), 'image' (no image beside it), else null.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    first = F.min_by(F.struct(F.col("path").alias("image_path"), "orientation", F.col("width").alias("image_width"), F.col("height").alias("image_height")), F.when(F.endswith("path", F.lit(".jpeg")), 0).otherwise(1))
    by_stem = images.groupBy(stem.alias("stem")).agg(first.alias("image"))
    doc = F.try_parse_json("text")
    info = F.try_variant_get(doc, F.lit("$.info"), "map<string,variant>")
    listed = lambda path: F.try_variant_get(doc, F.lit(path), "array<variant>").isNotNull()
    keys = F.coalesce(F.map_keys(info), F.array().cast("array<string>"))
    fault = (
        F.when(F.coalesce(F.schema_of_variant(doc), F.lit("")).startswith("OBJECT"), None)
        .otherwise("json")
    )
    fault = F.coalesce(
        fault,
        F.when(~(F.array_contains(keys, "height") & F.array_contains(keys, "width")), "size"),
        F.when(~(listed("$.dataList") | listed("$.markResult.features")), "data"),
        F.when(F.col("image.image_path").isNull(), "image"),
    )
    number = lambda name: F.try_variant_get(doc, F.lit(f"$.info.{name}"), "int")
    return annotations.withColumn("stem", stem).join(by_stem, "stem", "left").select("path", number("width").alias("width"), number("height").alias("height"), "image.*", fault.alias("fault"))


def image_scan(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Annotation files of a folder with their images, by path; with ``strict`` the first faulty file is an error."""
    found = with_images(annotation_files(spark, root), image_heads(image_files(spark, root)))
    if strict:
        bad = found.where("fault IS NOT NULL").orderBy("path").first()
        if bad:
            raise ValueError(f"{bad['path']}: {bad['fault']}")
        if found.isEmpty():
            raise FileNotFoundError(f"no annotation files under {root}")
    return found.orderBy("path")
