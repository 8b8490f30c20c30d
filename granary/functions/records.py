"""Small rules on records: names, prompts, orientation, cleaned polygons, rendered objects."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import geometry, jsonx
from granary.functions.text import DISTANCE, kv_pairs


# --- columns and fields ---


def with_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{prefix}{c}" for c in rows.columns})


def without_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumnsRenamed({c: c.removeprefix(prefix) for c in rows.columns if c.startswith(prefix)})


def split_by_prefix(rows: DataFrame, prefix: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without the prefixed columns, rows of only these, renamed); both keep ``keep``."""
    own = [c for c in rows.columns if c.startswith(prefix)]
    return rows.drop(*own), without_prefix(rows.select(*keep, *own), prefix)


def first_present(*columns: Column) -> Column:
    """The first column that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns])


def prompt_for(own: Column, template: Column, default: str) -> Column:
    return first_present(own, template, F.lit(default))


def assistant_prefix(domain: Column, task: Column) -> Column:
    return F.when(domain.isNotNull() & task.isNotNull(), F.format_string("<DOMAIN=%s>, <TASK=%s>\n", domain, task)).otherwise("")


def scheduled(schedule: DataFrame, pool: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a schedule with what the pool holds for them; the pool's rows are only read where scheduled."""
    return schedule.join(pool, on)


def with_policy(rows: DataFrame, policies: DataFrame, on: str) -> DataFrame:
    """Rows with their data set's policy; null where there is none."""
    return rows.join(policies, on, "left")


# --- descriptions ---


def phase_of(desc: Column, umbrella: dict[str, str]) -> Column:
    """(phase, category) of a description: 'phase/category,…' in the older form, else the category and the phase that covers it."""
    first = F.split_part(desc, F.lit(","), F.lit(1))
    old = ~F.contains(first, F.lit("=")) & F.contains(first, F.lit("/"))
    category = F.get(F.filter(kv_pairs(desc), lambda p: p["k"] == "类别"), F.lit(0))["v"]
    phase = F.lit(None).cast("string")
    for prefix, name in umbrella.items():
        phase = F.when(F.startswith(category, F.lit(prefix)), name).otherwise(phase)
    return F.struct(
        F.when(old, F.substring_index(first, "/", 1)).otherwise(F.coalesce(phase, category)).alias("phase"),
        F.when(old, F.regexp_replace(first, "^[^/]*/", "")).otherwise(category).alias("category"),
    )


def clean_summary(said: Column) -> Column:
    """One image's summary out of what was said of it.

    The word for irrelevant images alone; else the last line that is a summary
    object, or the whole text if it is one, in its stable form; else of another
    object the text of its first image, or all its texts; else the text itself.
    """
    text = F.trim(F.regexp_replace(said, r"^\s+|\s+$", ""))
    is_summary = lambda x: jsonx.is_object(x) & F.get_json_object(x, f"$.{jsonx.STATS}").isNotNull()
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), is_summary)
    summary = F.when(F.size(lines) > 0, F.element_at(lines, -1)).when(is_summary(text), text)
    values = jsonx.string_values(F.when(jsonx.is_object(text), text))
    of = lambda key: F.get(F.filter(values, lambda v: v["key"] == key), F.lit(0))["value"]
    joined = F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.trim(v["value"])), "，"))
    return F.when(F.startswith(text, F.lit(jsonx.IRRELEVANT)), jsonx.IRRELEVANT).otherwise(F.coalesce(jsonx.stable_json(summary), F.trim(of("image_1")), F.trim(of("图片_1")), joined, text))


def clean_records(records: DataFrame, key: str, column: str = "per_image") -> DataFrame:
    """Records, unique by ``key``, with every text of a map of images' summaries cleaned; null texts go."""
    said = records.select(key, F.explode(column).alias("image", "said")).where("said is not null")
    clean = said.select(key, F.struct("image", clean_summary(F.col("said"))).alias("e")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias(column))
    return records.drop(column).join(clean, key, "left").select(records.columns)


#: Kinds of tokens.
IGNORED, IN_DESC, IN_COORD, IN_FORMAT = -1, 1, 2, 3


def token_types(tokens: Column, spans: Column, labels: Column) -> Column:
    """The kind of every position of a sequence: that of most of its token's characters where it is supervised.

    tokens: (start, end) of the supervised text's tokens; spans: (start, end,
    type) of the text, apart from each other, with what lies between them as
    format; labels: -100 where not supervised. Missing tokens count as format,
    surplus ones are left out; of kinds with as many characters the least wins.
    """

    def kind(token: Column) -> Column:
        width = token["end"] - token["start"]
        inside = lambda s: F.greatest(F.least(s["end"], token["end"]) - F.greatest(s["start"], token["start"]), F.lit(0))
        part = lambda k: F.aggregate(F.filter(spans, lambda s: s["type"] == k), F.lit(0).cast("long"), lambda n, s: n + inside(s))
        desc, coord = part(IN_DESC), part(IN_COORD)
        rest = width - desc - coord
        found = F.when((desc >= coord) & (desc >= rest), IN_DESC).when(coord >= rest, IN_COORD).otherwise(IN_FORMAT)
        return F.when(width > 0, found).otherwise(IN_FORMAT)

    kinds = F.transform(tokens, kind)
    on = F.filter(F.transform(labels, lambda x, i: F.when(x != -100, i)), lambda i: i.isNotNull())
    place = F.transform(labels, lambda x, i: F.when(x != -100, F.array_position(on, i)))
    return F.transform(place, lambda p: F.when(p.isNull(), IGNORED).otherwise(F.coalesce(F.get(kinds, (p - 1).cast("int")), F.lit(IN_FORMAT))))


def without_distance(summary: Column) -> Column:
    """A text without the lines that name the station distance."""
    return F.array_join(F.filter(F.split(summary, "\n"), lambda x: ~F.contains(x, F.lit(DISTANCE))), "\n")


#: An entry in braces that names the distance as its category (one level of braces inside it), also cut off, and a keyed value of that name.
ENTRY = re.compile(rf',?\s*\{{(?:[^{{}}]|\{{[^{{}}]*\}})*"类别"\s*:\s*"{DISTANCE}"(?:[^{{}}]|\{{[^{{}}]*(?:\}}|$))*(?:\}}|$)')
KEYED = re.compile(rf',?\s*"{DISTANCE}"\s*:\s*(?:\{{(?:[^{{}}]|\{{[^{{}}]*(?:\}}|$))*(?:\}}|$)|[^,}}]*)')
HEADER = re.compile(r"<DOMAIN=.*>\s*,\s*<TASK=.*>")
FIRST_KEYS = ("统计", "备注", "分组统计")


def _without_station_distance(text: str | None) -> str | None:
    if not text:
        return text
    text = text.strip()
    if text.startswith("无关图片"):
        return "无关图片"
    text = "\n".join(x for x in text.splitlines() if x.strip() and not HEADER.fullmatch(x.strip())).strip()
    start, end = text.find("{"), text.rfind("}")
    try:
        doc = json.loads(text[start : end + 1]) if start >= 0 else None
    except ValueError:
        doc = None
    if isinstance(doc, dict) and isinstance(doc.get("统计"), list):
        doc["统计"] = [e for e in doc["统计"] if not (isinstance(e, dict) and e.get("类别") == DISTANCE)]
        if isinstance(doc.get("分组统计"), dict):
            doc["分组统计"].pop(DISTANCE, None)
        ordered = {k: doc[k] for k in FIRST_KEYS if k in doc} | doc
        return json.dumps(ordered, ensure_ascii=False, separators=(", ", ": ")).replace(DISTANCE, "")
    out = KEYED.sub("", ENTRY.sub("", text))
    return re.sub(r"([\[{])\s*,\s*", r"\1", out).replace(DISTANCE, "").strip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def strip_station_distance(texts: pd.Series) -> pd.Series:
    """Summaries without what they say about the station distance.

    Entries and keys of that name leave a JSON summary, whose usual keys come
    first; from text that is no JSON the same pieces are cut. Header lines go,
    and a text that begins as an irrelevant image's is just that.
    """
    return texts.map(lambda row: None if row is None else [_without_station_distance(t) for t in row])


@F.pandas_udf(T.StringType())
def rendered_objects(objects: pd.Series) -> pd.Series:
    """A JSON object object_1, object_2, … with points in pairs, from a JSON array of (desc, kind, points)."""

    def show(t):
        if t is None:
            return None
        names = {"bbox": "bbox_2d", "poly": "poly", "line": "line"}
        out = {}
        for i, o in enumerate(json.loads(t), 1):
            p = o["points"]
            shape = p if o["kind"] == "bbox" else [p[k : k + 2] for k in range(0, len(p), 2)]
            out[f"object_{i}"] = {"desc": o["desc"], names[o["kind"]]: shape} | ({"line_points": len(p) // 2} if o["kind"] == "line" else {})
        return json.dumps(out, ensure_ascii=False, separators=(", ", ": "))

    return objects.map(show)


SPAN = re.compile(r'"desc"\s*:\s*"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?)(?=\s*[,\]])')


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def json_spans(text: pd.Series) -> pd.Series:
    """Places of descriptions and coordinates in a rendered object; all else is format."""

    def spans(t):
        if t is None:
            return None
        return [{"kind": "desc" if m[1] is not None else "coord", "start": m.start(1 if m[1] is not None else 2), "end": m.end(1 if m[1] is not None else 2)} for m in SPAN.finditer(t)]

    return text.map(spans)


# --- orientation and polygons ---


def needs_turn(orientation: Column, raw: Column, seen: Column, turned: Column, tolerance: float = 2.0) -> Column:
    """Whether coordinates need the EXIF turn: ``seen`` is the size they were made on, (w, h) arrays all.

    No turn without orientation; none if only the turned size matches; a turn if
    only the raw one does; none if both do; else the closer size decides, and a
    missing size means a turn.
    """
    off = lambda a: F.greatest(F.abs(F.get(a, F.lit(0)) - F.get(seen, F.lit(0))), F.abs(F.get(a, F.lit(1)) - F.get(seen, F.lit(1))))
    to_raw, to_turned = off(raw), off(turned)
    decided = (
        F.when(F.coalesce(orientation, F.lit(0)).isin(0, 1), False)
        .when(seen.isNull() | raw.isNull(), True)
        .when(to_turned <= tolerance, False)
        .when(to_raw <= tolerance, True)
    )
    return F.coalesce(decided, to_raw < to_turned)


def without_collinear(points: Column, eps: float = 1e-9) -> Column:
    """A polygon without points on the line between their neighbours."""
    p = geometry.pairs(points)
    n = F.size(p)

    def bends(q: Column, i: Column) -> Column:
        a, b = F.get(p, (i + n - 1) % n), F.get(p, (i + 1) % n)
        return F.abs((q["x"] - a["x"]) * (b["y"] - a["y"]) - (q["y"] - a["y"]) * (b["x"] - a["x"])) > eps

    kept = F.filter(p, bends)
    return geometry.flat(F.when(F.size(kept) >= 3, kept).otherwise(p))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def moved_polygon(points: pd.Series, matrix: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """A polygon under an affine map, kept if inside the image (by half a pixel), else clipped; a clip without four points becomes its smallest rectangle; null if nothing is left."""

    def move(p, m, w, h):
        if p is None:
            return None
        p = np.asarray(p, float).reshape(-1, 2)
        q = p @ np.array([[m[0], m[3]], [m[1], m[4]]]) + np.array([m[2], m[5]])
        if ((q >= -0.5) & (q <= np.array([w, h]) - 0.5)).all():
            return q.ravel().tolist()
        c = geometry.clip_to_box(q, (0.0, 0.0, float(w), float(h)))
        if not len(c):
            return None
        return (c if len(c) == 4 else geometry.min_area_rectangle(c)).ravel().tolist()

    return pd.Series([move(*x) for x in zip(points, matrix, width, height)])


@F.pandas_udf(T.DoubleType())
def coverage(points: pd.Series, box: pd.Series) -> pd.Series:
    """The share of a polygon's area inside a box."""

    def size(p):
        return abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2 if len(p) > 2 else 0.0

    def share(p, b):
        if p is None:
            return None
        p = np.asarray(p, float).reshape(-1, 2)
        whole = size(p)
        return float(size(geometry.clip_to_box(p, tuple(b))) / whole) if whole else 0.0

    return pd.Series([share(p, b) for p, b in zip(points, box)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def clipped_line(points: pd.Series, box: pd.Series) -> pd.Series:
    """The first connected part of a polyline inside a box; null if none."""

    def cut(p, b):
        if p is None:
            return None
        p, out = np.asarray(p, float).reshape(-1, 2), []
        for s, t in zip(p, p[1:]):
            part = geometry.clip_segment(tuple(s), tuple(t), tuple(b))
            if part is None or (out and tuple(out[-1]) != part[0]):
                if out:
                    break
                if part is None:
                    continue
            out += [x for x in part if not out or tuple(out[-1]) != x]
        return np.array(out).ravel().tolist() if len(out) > 1 else None

    return pd.Series([cut(p, b) for p, b in zip(points, box)])
