"""Table functions for SQL: polygons of annotations, and image jobs of groups.

``register`` makes them known to a session:

    SELECT * FROM polygons(TABLE(annotations), 8)
    SELECT * FROM image_jobs(TABLE(groups) PARTITION BY (mission) ORDER BY (group_id), 'mission')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: How far coordinates may lie outside the image.
MARGIN = 10


def _needs(argument: AnalyzeArgument, *names: str) -> dict[str, T.DataType]:
    if not argument.isTable:
        raise ValueError("the first argument must be a TABLE")
    kinds = {f.name: f.dataType for f in argument.dataType.fields}
    missing = [n for n in names if n not in kinds]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return kinds


@udtf
class Polygons:
    """A row per usable part of a segmentation: annotation_id, part, kind ('poly' or 'bbox_2d'), points, n_points.

    The table has annotation_id, segmentation (lists of x, y, x, y, …), width and
    height. Parts with an odd number of values, fewer than three points, or
    points more than MARGIN outside the image are left out. Beyond ``most_points``
    a part becomes its box, clipped to the image, unless nothing is left of it.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, most_points: AnalyzeArgument | None = None) -> AnalyzeResult:
        kinds = _needs(rows, "annotation_id", "segmentation", "width", "height")
        fields = [("annotation_id", kinds["annotation_id"]), ("part", T.IntegerType()), ("kind", T.StringType()), ("points", T.ArrayType(T.DoubleType())), ("n_points", T.IntegerType())]
        return AnalyzeResult(T.StructType([T.StructField(n, k) for n, k in fields]))

    def eval(self, row, most_points=None) -> Iterator[tuple]:
        width, height = row["width"], row["height"]
        for number, part in enumerate(row["segmentation"] or []):
            if part is None or len(part) < 6 or len(part) % 2 or any(v is None for v in part):
                continue
            x, y = part[0::2], part[1::2]
            if min(x) < -MARGIN or max(x) > width + MARGIN or min(y) < -MARGIN or max(y) > height + MARGIN:
                continue
            if most_points is None or len(x) <= most_points:
                yield row["annotation_id"], number, "poly", [float(v) for v in part], len(x)
                continue
            box = [max(0.0, min(x)), max(0.0, min(y)), min(float(width), max(x)), min(float(height), max(y))]
            if box[0] < box[2] and box[1] < box[3]:
                yield row["annotation_id"], number, "bbox_2d", box, len(x)


@udtf
class ImageJobs:
    """A row per image of the groups of a partition: job (from 0), then group_id, image_index (from 1), image.

    The table has group_id and images; jobs are numbered in the order of its
    rows, so PARTITION BY and ORDER BY say what is numbered together and how.
    The partitioning columns come in the result as the call's ``keys`` lists them.
    """

    def __init__(self):
        self.job = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument | None = None) -> AnalyzeResult:
        names = [n for n in (keys.value or "").split(",") if n] if keys else []
        kinds = _needs(rows, "group_id", "images", *names)
        fields = [*((n, kinds[n]) for n in names), ("job", T.LongType()), ("group_id", kinds["group_id"]), ("image_index", T.IntegerType()), ("image", T.StringType())]
        return AnalyzeResult(T.StructType([T.StructField(n, k) for n, k in fields]))

    def eval(self, row, keys=None) -> Iterator[tuple]:
        own = [row[n] for n in (keys or "").split(",") if n]
        for index, image in enumerate(row["images"] or [], 1):
            yield (*own, self.job, row["group_id"], index, image)
            self.job += 1


def register(spark: SparkSession) -> None:
    """``polygons`` and ``image_jobs`` as functions of the session's SQL."""
    spark.udtf.register("polygons", Polygons)
    spark.udtf.register("image_jobs", ImageJobs)
