"""Flat coordinate arrays [x0, y0, x1, y1, …]: boxes, polygons, polylines."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.numeric import half_even, ratio


def xs(points: Column) -> Column:
    return F.filter(points, lambda _, i: i % 2 == 0)


def ys(points: Column) -> Column:
    return F.filter(points, lambda _, i: i % 2 == 1)


def pairs(points: Column) -> Column:
    return F.zip_with(xs(points), ys(points), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def aabb(points: Column) -> Column:
    return F.array(F.array_min(xs(points)), F.array_min(ys(points)), F.array_max(xs(points)), F.array_max(ys(points)))


def per_axis(points: Column, fx, fy) -> Column:
    """fx of each x, fy of each y."""
    return F.transform(points, lambda v, i: F.when(i % 2 == 0, fx(v)).otherwise(fy(v)))


def scale(points: Column, sx, sy) -> Column:
    return per_axis(points, lambda v: v * sx, lambda v: v * sy)


def translate(points: Column, dx, dy) -> Column:
    return per_axis(points, lambda v: v + dx, lambda v: v + dy)


def clamp(points: Column, width, height) -> Column:
    """Into [0, width - 1] x [0, height - 1]."""
    inside = lambda n: lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(n - 1.0) if isinstance(n, (int, float)) else n - 1.0))
    return per_axis(points, inside(width), inside(height))


def to_grid(points: Column, width, height, grid: int = 1000) -> Column:
    """To whole numbers 0 … grid, halves to even."""
    cap = lambda n: lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(grid)), half_even(v / n * grid)))
    return F.transform(per_axis(points, cap(width), cap(height)), lambda v: v.cast("int"))


def from_grid(points: Column, width, height, grid: int = 1000) -> Column:
    return per_axis(points, lambda v: v * width / grid, lambda v: v * height / grid)


def whole_rectangle(points: Column) -> Column:
    """Four corners, one after the other, of an upright rectangle on whole numbers: it has the same cells as its box."""
    at = lambda i: F.get(points, F.lit(i))
    sides = lambda pairs: reduce(and_, (at(i) == at(j) for i, j in pairs))
    upright = sides(((0, 6), (2, 4), (1, 3), (5, 7))) | sides(((1, 7), (3, 5), (0, 2), (4, 6)))
    return F.coalesce((F.size(points) == 8) & upright & (at(0) == F.floor(at(0))) & (at(1) == F.floor(at(1))) & (at(4) == F.floor(at(4))) & (at(5) == F.floor(at(5))), F.lit(False))


def box_area(b: Column) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.get(b, F.lit(i + 2)) - F.get(b, F.lit(i)))
    return side(0) * side(1)


def box_intersection(a: Column, b: Column) -> Column:
    """The common area of two boxes."""

    def side(i: int) -> Column:
        low = F.greatest(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
        return F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(i + 2)), F.get(b, F.lit(i + 2))) - low)

    return side(0) * side(1)


def box_iou(a: Column, b: Column) -> Column:
    inter = box_intersection(a, b)
    return ratio(inter, box_area(a) + box_area(b) - inter)


def box_coverage(a: Column, b: Column) -> Column:
    """The share of a that lies in b."""
    return ratio(box_intersection(a, b), box_area(a))


def box_of_xywh(b: Column, width=None, height=None) -> Column:
    """Corners of [x, y, w, h], cut at the image where its size is given."""
    x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
    corners = F.array(x, y, x + w, y + h)
    if width is None:
        return corners
    return per_axis(corners, lambda v: F.greatest(F.lit(0.0), F.least(v, width)), lambda v: F.greatest(F.lit(0.0), F.least(v, height)))


def box_inside(b: Column, width, height, strict: bool = True) -> Column:
    """All of a box (or, if not strict, some of it) lies in the image."""
    x1, y1, x2, y2 = (F.get(b, F.lit(i)) for i in range(4))
    whole = (x1 >= 0) & (y1 >= 0) & (x2 <= width) & (y2 <= height)
    some = (x2 > 0) & (y2 > 0) & (x1 < width) & (y1 < height)
    return whole if strict else some


def rotate_left(items: Column, n: Column | int = 1) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.slice(items, n + 1, F.size(items)), F.slice(items, 1, n))


def signed_area(points: Column) -> Column:
    """Shoelace: positive where the points turn from x towards y."""
    p = pairs(points)
    cross = F.zip_with(p, rotate_left(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def start_top_left(points: Column) -> Column:
    """The polygon from its topmost, then leftmost point on."""
    p = pairs(points)
    keys = F.transform(p, lambda q: F.struct(q["y"].alias("y"), q["x"].alias("x")))
    at = F.array_position(keys, F.array_min(keys)).cast("int") - 1
    return flat(rotate_left(p, at))


def line_direction(points: Column) -> Column:
    """The polyline from its end that is further left, then higher."""
    p = pairs(points)
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    turn = F.struct(last["x"], last["y"]) < F.struct(first["x"], first["y"])
    return flat(F.when(turn, F.reverse(p)).otherwise(p))


def angle_order(points: Column) -> Column:
    """Points around their centre by falling atan2(-dy, dx), then from the top-left one on."""
    p = pairs(points)
    n = F.size(p)
    mean = lambda c: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[c]) / n
    centre = F.transform(F.array(F.struct(mean("x").alias("x"), mean("y").alias("y"))), lambda c: F.sort_array(F.transform(p, lambda q: F.struct((-F.atan2(c["y"] - q["y"], q["x"] - c["x"])).alias("k"), q["y"].alias("y"), q["x"].alias("x")))))
    ordered = F.get(centre, F.lit(0))
    return start_top_left(F.flatten(F.transform(ordered, lambda q: F.array(q["x"], q["y"]))))


def drop_repeats(points: Column) -> Column:
    """Without points equal to the one before, or a last one equal to the first."""
    p = pairs(points)
    kept = F.filter(p, lambda q, i: (i == 0) | (q != F.get(p, i - 1)))
    closed = (F.size(kept) > 1) & (F.element_at(kept, -1) == F.element_at(kept, 1))
    return flat(F.when(closed, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))


def affine(points: Column, m: Column) -> Column:
    """[a, b, c, d, e, f] maps (x, y) to (a x + b y + c, d x + e y + f)."""
    g = lambda i: F.get(m, F.lit(i))
    moved = F.transform(
        pairs(points),
        lambda p: F.struct((g(0) * p["x"] + g(1) * p["y"] + g(2)).alias("x"), (g(3) * p["x"] + g(4) * p["y"] + g(5)).alias("y")),
    )
    return flat(moved)


def affine_compose(m: Column, n: Column) -> Column:
    """First n, then m."""
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    p, q, r, s, t, u = (F.get(n, F.lit(i)) for i in range(6))
    return F.array(a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f)


def affine_invert(m: Column) -> Column:
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    det = a * e - b * d
    return F.when(det != 0, F.array(e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det))


def affine_kind(m: Column, eps: float = 1e-9) -> Column:
    b, d = F.abs(F.get(m, F.lit(1))), F.abs(F.get(m, F.lit(3)))
    a, e = F.abs(F.get(m, F.lit(0)) - 1), F.abs(F.get(m, F.lit(4)) - 1)
    return F.when((b > eps) | (d > eps), "general").when((a <= eps) & (e <= eps), "translation").otherwise("axis_aligned")


def exif_oriented(points: Column, orientation: Column, width, height) -> Column:
    """Points of the stored image after one of the eight EXIF turns; unknown ones change nothing."""
    forms = {2: (-1, 0, 1, 0, 1, 0), 3: (-1, 0, 1, 0, -1, 1), 4: (1, 0, 0, 0, -1, 1), 5: (0, 1, 0, 1, 0, 0), 6: (0, -1, 2, 1, 0, 0), 7: (0, -1, 2, -1, 0, 1), 8: (0, 1, 0, -1, 0, 1)}
    w, h = F.lit(width).cast("double"), F.lit(height).cast("double")
    out = None
    for k, (a, b, c, d, e, f) in forms.items():
        cx = {0: F.lit(0.0), 1: w, 2: h}[c]
        cy = {0: F.lit(0.0), 1: w if k in (7, 8) else h}[f]
        m = F.array(F.lit(float(a)), F.lit(float(b)), cx, F.lit(float(d)), F.lit(float(e)), cy)
        out = F.when(orientation == k, affine(points, m)) if out is None else out.when(orientation == k, affine(points, m))
    return out.otherwise(points)


def geometry_of(obj: str) -> Column:
    """(kind, points) of an object with exactly one of bbox_2d, poly, line; null otherwise."""
    fields = {"bbox": F.col(f"{obj}.bbox_2d"), "poly": F.col(f"{obj}.poly"), "line": F.col(f"{obj}.line")}
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("points")) for k, v in fields.items()]), lambda g: g["points"].isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def geometry_problems(kind: Column, points: Column) -> Column:
    """Names of what is wrong with a geometry's array."""
    n = F.size(points)
    least = F.when(kind == "poly", 6).when(kind == "line", 4).otherwise(4)
    checks = {
        "missing": points.isNull(),
        "odd_length": n % 2 != 0,
        "too_short": n < least,
        "bbox_length": (kind == "bbox") & (n != 4),
        "not_finite": F.exists(points, lambda v: v.isNull() | F.isnan(v)),
        "bbox_order": (kind == "bbox") & ((F.get(points, F.lit(0)) >= F.get(points, F.lit(2))) | (F.get(points, F.lit(1)) >= F.get(points, F.lit(3)))),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))


# --- shapes that need loops -------------------------------------------------


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_points(points: np.ndarray) -> np.ndarray:
    """Convex hull, in order."""
    ordered = sorted(map(tuple, points))
    distinct = [p for i, p in enumerate(ordered) if i == 0 or p != ordered[i - 1]]
    if len(distinct) < 3:
        return np.array(distinct, float)
    halves = []
    for run in (distinct, distinct[::-1]):
        half: list = []
        for p in run:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves, float)


def clip_to_box(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a polygon inside a box, one side after the other."""
    out = [tuple(p) for p in points]
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        before, out = out, []
        for p, q in zip(before, before[1:] + before[:1]):
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if dp >= 0:
                out.append(p)
            if (dp > 0 > dq) or (dp < 0 < dq):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return np.array(out, float).reshape(-1, 2)


def clip_segment(p, q, box) -> tuple | None:
    """The part of a segment inside a box, by its parameter's bounds."""
    low, high = 0.0, 1.0
    for axis in (0, 1):
        d = q[axis] - p[axis]
        for bound, sign in ((box[axis], -1), (box[axis + 2], 1)):
            room = sign * (bound - p[axis])
            if d == 0:
                if room < 0:
                    return None
            elif sign * d > 0:
                high = min(high, room / (sign * d))
            else:
                low = max(low, room / (sign * d))
    if low > high:
        return None
    at = lambda t: (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
    return at(low), at(high)


def min_area_rectangle(points: np.ndarray) -> np.ndarray:
    """The smallest rectangle with a side along a hull edge; the first one wins."""
    hull = hull_points(points)
    if len(hull) < 3:
        return np.array([hull[0], hull[-1], hull[-1], hull[0]], float)
    best, out = np.inf, None
    for p, q in zip(hull, np.roll(hull, -1, 0)):
        u = (q - p) / np.hypot(*(q - p))
        v = np.array([-u[1], u[0]])
        a, b = hull @ u, hull @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if size < best - 1e-12:
            best = size
            out = [u * x + v * y for x, y in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))]
    return np.array(out)


def raster_mask(kind: str, points: np.ndarray, box: tuple[int, int, int, int], tolerance: float = 8.0) -> np.ndarray:
    """Cells of a window whose centres lie in a box or polygon, or within a stroke's half width of a line."""
    x0, y0, x1, y1 = box
    gy, gx = np.ogrid[y0 : y1 + 1, x0 : x1 + 1]
    gx, gy = gx.astype(float), gy.astype(float)
    p = points.reshape(-1, 2)
    if kind == "bbox":
        return (gx >= p[0, 0]) & (gx <= p[1, 0]) & (gy >= p[0, 1]) & (gy <= p[1, 1])
    out = np.zeros((len(gy), gx.size), bool)

    def mark_near(a, b, reach):
        """Sets the cells within ``reach`` of a side; only those around it are looked at."""
        low, high = np.minimum(a, b) - reach, np.maximum(a, b) + reach
        rows = slice(max(0, int(np.ceil(low[1])) - y0), max(0, int(np.floor(high[1])) - y0 + 1))
        columns = slice(max(0, int(np.ceil(low[0])) - x0), max(0, int(np.floor(high[0])) - x0 + 1))
        x, y, d = gx[:, columns], gy[rows], b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(d @ d, 1e-12), 0, 1)
        out[rows, columns] |= np.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]) <= reach

    if kind == "line":
        half = max(1.0, round(2 * tolerance)) / 2
        for a, b in zip(p, p[1:]):
            mark_near(a, b, half)
        return out
    sides = list(zip(p, np.roll(p, -1, 0)))
    for a, b in sides:
        # Where a row of cells crosses a side depends on the row alone.
        cross = (a[1] > gy) != (b[1] > gy)
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= cross & (gx < (b[0] - a[0]) * (gy - a[1]) / (b[1] - a[1]) + a[0])
    for a, b in sides:
        mark_near(a, b, 1e-9)
    return out


def raster_iou(kind_a: str, a: np.ndarray, kind_b: str, b: np.ndarray, tolerance: float = 8.0, grid: int = 1000) -> float:
    """IoU of two shapes' cells on the grid; lines only meet lines."""
    if (kind_a == "line") != (kind_b == "line"):
        return 0.0
    pad = int(np.ceil(tolerance)) + 1 if kind_a == "line" else 0
    spans = [(s.reshape(-1, 2).min(0) - pad, s.reshape(-1, 2).max(0) + pad) for s in (a, b)]
    if (spans[0][0] > spans[1][1]).any() or (spans[1][0] > spans[0][1]).any():
        return 0.0
    low = np.maximum(0, np.floor(np.minimum(spans[0][0], spans[1][0]))).astype(int)
    high = np.minimum(grid - 1, np.ceil(np.maximum(spans[0][1], spans[1][1]))).astype(int)
    if (high < low).any():
        return 0.0
    box = (*low, *high)
    x, y = raster_mask(kind_a, a, box, tolerance), raster_mask(kind_b, b, box, tolerance)
    union = (x | y).sum()
    return float((x & y).sum() / union) if union else 0.0


def convex_iou(a: np.ndarray, b: np.ndarray) -> float:
    """IoU of two convex polygons by clipping one with the other's sides."""
    p, q = hull_points(a.reshape(-1, 2)), hull_points(b.reshape(-1, 2))
    size = lambda s: abs(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1))) / 2 if len(s) > 2 else 0.0
    out = [tuple(x) for x in p]
    for u, v in zip(q, np.roll(q, -1, 0)):
        before, out = out, []
        for s, t in zip(before, before[1:] + before[:1]):
            ds, dt = _turn(u, v, s), _turn(u, v, t)
            if ds >= 0:
                out.append(s)
            if (ds > 0 > dt) or (ds < 0 < dt):
                k = ds / (ds - dt)
                out.append((s[0] + k * (t[0] - s[0]), s[1] + k * (t[1] - s[1])))
    inter = size(np.array(out, float).reshape(-1, 2))
    union = size(p) + size(q) - inter
    return float(inter / union) if union > 0 else 0.0


def line_iou(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, step: float = 2.0) -> float:
    """Harmonic mean of the shares of each line's sampled points near the other."""

    def samples(line):
        p = line.reshape(-1, 2)
        out = [p[:1]]
        for s, t in zip(p, p[1:]):
            n = max(1, int(np.ceil(np.hypot(*(t - s)) / step)))
            out.append(s + (t - s) * (np.arange(1, n + 1) / n)[:, None])
        return np.concatenate(out)

    def covered(points, line):
        p = line.reshape(-1, 2)
        best = np.full(len(points), np.inf)
        for s, t in zip(p, p[1:]):
            d = t - s
            k = np.clip(((points - s) @ d) / max(d @ d, 1e-12), 0, 1)
            best = np.minimum(best, np.hypot(*(points - s - k[:, None] * d).T))
        return float((best <= tolerance).mean())

    x, y = covered(samples(a), b), covered(samples(b), a)
    return 2 * x * y / (x + y) if x + y else 0.0


@F.pandas_udf(T.DoubleType())
def _shape_iou(kind_a: pd.Series, a: pd.Series, kind_b: pd.Series, b: pd.Series, tolerance: pd.Series) -> pd.Series:
    rows = zip(kind_a, a, kind_b, b, tolerance)
    return pd.Series([0.0 if x is None or y is None else raster_iou(k, np.asarray(x, float), m, np.asarray(y, float), d) for k, x, m, y, d in rows])


#: Spark copies a function into filters on its result, and so draws twice; it does not copy one that may give other results.
_drawn_once = _shape_iou.asNondeterministic()


def shape_iou(kind_a: Column, a: Column, kind_b: Column, b: Column, tolerance: Column | None = None) -> Column:
    """Raster IoU per row, in Arrow batches, lines as tubes of the tolerance (8); 0 where an array is missing."""
    return _drawn_once(kind_a, a, kind_b, b, F.lit(8.0) if tolerance is None else tolerance)


def _clip_area(p: np.ndarray, q: np.ndarray) -> float:
    """The area of p within convex q, whichever way round q runs."""
    turn = np.sign(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))
    left = p
    for u, v in zip(q, np.roll(q, -1, 0)):
        if not len(left):
            return 0.0
        side = turn * ((v[0] - u[0]) * (left[:, 1] - u[1]) - (v[1] - u[1]) * (left[:, 0] - u[0]))
        kept = []
        for i, s in enumerate(side):
            t, j = side[(i + 1) % len(side)], (i + 1) % len(side)
            if s >= 0:
                kept.append(left[i])
            if (s >= 0) != (t >= 0):
                kept.append(left[i] + (left[j] - left[i]) * (s / (s - t)))
        left = np.array(kept, float).reshape(-1, 2)
    return abs(np.dot(left[:, 0], np.roll(left[:, 1], -1)) - np.dot(left[:, 1], np.roll(left[:, 0], -1))) / 2 if len(left) > 2 else 0.0


def exact_iou(kind_a: str, a: np.ndarray, kind_b: str, b: np.ndarray) -> float:
    """IoU without a grid: areas of boxes, polygons with points as given, a box and a polygon by its points in order of angle, lines by nearness.

    Shapes with too few points are compared by the boxes around them; families
    do not meet.
    """
    if (kind_a == "line") != (kind_b == "line") or not len(a) or not len(b):
        return 0.0
    least = {"bbox": 4, "poly": 6, "line": 4}
    short = len(a) < least[kind_a] or len(b) < least[kind_b]
    if kind_a == "line" and not short:
        return line_iou(a, b)
    around = lambda s: (s.reshape(-1, 2).min(0), s.reshape(-1, 2).max(0))
    (alow, ahigh), (blow, bhigh) = around(a), around(b)
    if kind_a == kind_b == "bbox" or (short and kind_a == kind_b):
        inter = np.prod(np.maximum(np.minimum(ahigh, bhigh) - np.maximum(alow, blow), 0))
        union = np.prod(ahigh - alow) + np.prod(bhigh - blow) - inter
        return float(inter / union) if union > 0 else 0.0
    if short:
        return 0.0
    p, q = a.reshape(-1, 2), b.reshape(-1, 2)
    if kind_a != kind_b:
        if not (np.minimum(ahigh, bhigh) > np.maximum(alow, blow)).all():
            return 0.0

        def turned(kind, low, high, points):
            if kind == "bbox":
                return np.array([low, (high[0], low[1]), high, (low[0], high[1])], float)
            d = points - points.mean(0)
            return points[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]

        p, q = turned(kind_a, alow, ahigh, p), turned(kind_b, blow, bhigh, q)
    size = lambda s: abs(np.dot(s[:, 0], np.roll(s[:, 1], -1)) - np.dot(s[:, 1], np.roll(s[:, 0], -1))) / 2
    if min(size(p), size(q)) <= 0:
        return 0.0
    inter = _clip_area(p, q)
    union = size(p) + size(q) - inter
    return float(inter / union) if union > 0 else 0.0


@F.pandas_udf(T.DoubleType())
def continuous_iou(kind_a: pd.Series, a: pd.Series, kind_b: pd.Series, b: pd.Series) -> pd.Series:
    """``exact_iou`` per row, in Arrow batches; 0 where an array is missing."""
    rows = zip(kind_a, a, kind_b, b)
    return pd.Series([0.0 if x is None or y is None else exact_iou(k, np.asarray(x, float), m, np.asarray(y, float)) for k, x, m, y in rows])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def clipped(points: pd.Series, box: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else clip_to_box(np.asarray(p, float).reshape(-1, 2), tuple(b)).ravel().tolist() for p, b in zip(points, box)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rectangle_around(points: pd.Series) -> pd.Series:
    return points.map(lambda p: None if p is None or not len(p) else min_area_rectangle(np.asarray(p, float).reshape(-1, 2)).ravel().tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hull(points: pd.Series) -> pd.Series:
    return points.map(lambda p: None if p is None else hull_points(np.asarray(p, float).reshape(-1, 2)).ravel().tolist())
