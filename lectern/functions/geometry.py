"""Boxes, affine maps and polygons. A box is a struct of x, y, width and height."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from .text import bind

BOX = "struct<x:double,y:double,width:double,height:double>"
EPSILON = 0.05


def box(x, y, width, height) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_col(v).cast("double").alias(n) for n, v in (("x", x), ("y", y), ("width", width), ("height", height))])


def corners(b: Column) -> Column:
    return F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["width"]).alias("x1"), (b["y"] + b["height"]).alias("y1"))


def intersection_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(zero, F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    return w * h


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def union_of(x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> list[Column]:
    """Aggregates of the smallest box around a group's boxes."""
    c = F.col
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(c(x) + c(width)) - F.min(x)).alias("width"), (F.max(c(y) + c(height)) - F.min(y)).alias("height")]


def to_pixels(b: Column, page_height: Column, zoom: Column) -> Column:
    """From points of a page, y upwards from its foot, to pixels, y downwards from its head."""
    return box(b["x"] * zoom, (page_height - b["y"] - b["height"]) * zoom, b["width"] * zoom, b["height"] * zoom)


def polygon_of(b: Column) -> Column:
    p = lambda x, y: F.array(x, y)
    x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def apply_affine(polygon: Column, m: list[Column]) -> Column:
    """m is a, b, c, d, e, f of x' = a x + b y + c and y' = d x + e y + f."""
    return F.transform(polygon, lambda p: bind(p, lambda q: F.array(m[0] * q[0] + m[1] * q[1] + m[2], m[3] * q[0] + m[4] * q[1] + m[5])))


def envelope(polygon: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Smallest box around a polygon, within a canvas if one is given."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    clip = lambda v, hi: v if hi is None else F.greatest(F.lit(0.0), F.least(v, hi))
    x0, x1, y0, y1 = clip(F.array_min(xs), width), clip(F.array_max(xs), width), clip(F.array_min(ys), height), clip(F.array_max(ys), height)
    return box(x0, y0, x1 - x0, y1 - y0)


def compose(matrices: Column) -> Column:
    """Product of an array of maps [a, b, c, d, e, f], the first applied first."""
    one = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))
    times = lambda n, m: F.array(n[0] * m[0] + n[1] * m[3], n[0] * m[1] + n[1] * m[4], n[0] * m[2] + n[1] * m[5] + n[2], n[3] * m[0] + n[4] * m[3], n[3] * m[1] + n[4] * m[4], n[3] * m[2] + n[4] * m[5] + n[5])
    return F.aggregate(matrices, one, times)


def rotation_shear(degrees: Column, shear: Column, cx: Column, cy: Column) -> Column:
    """Rotation about (cx, cy), in pixels with y downwards, with a shear added to how x follows y, as [a, b, c, d, e, f]."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.array(c, s + shear, (1 - c) * cx - s * cy, -s, c, s * cx + (1 - c) * cy)


def box_visibility(b: Column, width: Column, height: Column, epsilon: float = EPSILON) -> Column:
    """inside, partial or outside of the canvas, for boxes."""
    x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]
    inside = (x0 >= -epsilon) & (y0 >= -epsilon) & (x1 <= width + epsilon) & (y1 <= height + epsilon)
    outside = (x1 <= 0) | (y1 <= 0) | (x0 >= width) | (y0 >= height)
    return F.when(inside, "inside").when(outside, "outside").otherwise("partial")


def visible_fraction(b: Column, width: Column, height: Column) -> Column:
    whole = area(b)
    return F.when(whole > 0, intersection_area(b, box(0.0, 0.0, width, height)) / whole).otherwise(0.0)


# polygons: arrays of points, in Arrow kernels


def shoelace(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def clip_to_canvas(points: np.ndarray, width: float, height: float) -> np.ndarray:
    """Sutherland-Hodgman against the canvas's four sides, for convex polygons."""
    for axis, limit, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        out = []
        for p, q in zip(points, np.roll(points, -1, axis=0), strict=True):
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if dp >= 0:
                out.append(p)
            if (dp >= 0) != (dq >= 0):
                out.append(p + (q - p) * dp / (dp - dq))
        points = np.array(out).reshape(-1, 2)
        if not len(points):
            break
    return points


def is_simple(points: np.ndarray) -> bool:
    """Whether a polygon has at least three finite points, an area, and no sides that cross or touch except neighbours."""
    n = len(points)
    if n < 3 or not np.isfinite(points).all() or shoelace(points) <= 0:
        return False
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i in range(n):
        a, b = points[i], points[(i + 1) % n]
        for j in range(i + 1, n):
            if j == i + 1 or (j + 1) % n == i:
                continue
            c, d = points[j], points[(j + 1) % n]
            t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
            if t1 * t2 < 0 and t3 * t4 < 0 or t1 == 0 and on(a, b, c) or t2 == 0 and on(a, b, d) or t3 == 0 and on(c, d, a) or t4 == 0 and on(c, d, b):
                return False
    return True


def _points(value) -> np.ndarray:
    return np.array([list(p) for p in value], float).reshape(-1, 2) if value is not None else np.zeros((0, 2))


def _alike(polygons: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Polygons by their number of points, as (rows, array of rows x points x 2), and the rows of others."""
    n = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)
    points = polygons.flatten()
    values = points.flatten()
    if points.null_count or values.null_count or not pc.all(pc.equal(pc.list_value_length(points), 2)).as_py():
        return [], list(range(len(polygons)))
    xy, starts = values.to_numpy(zero_copy_only=False).reshape(-1, 2), np.concatenate(([0], np.cumsum(n)[:-1]))
    groups = [(np.flatnonzero(n == k), k) for k in np.unique(n) if 3 <= k <= 16]
    return [(rows, xy[starts[rows][:, None] + np.arange(k)]) for rows, k in groups], np.flatnonzero((n < 3) | (n > 16)).tolist()


def _areas(points: np.ndarray, n: np.ndarray) -> np.ndarray:
    """shoelace() of many polygons, of which the first n points count."""
    at = np.arange(points.shape[1])
    follows = np.where(at + 1 == n[:, None], 0, (at + 1) % points.shape[1])
    after = np.take_along_axis(points, follows[:, :, None], 1)
    there = at < n[:, None]
    return np.abs(np.where(there, points[:, :, 0] * after[:, :, 1], 0).sum(1) - np.where(there, points[:, :, 1] * after[:, :, 0], 0).sum(1)) / 2


def _clip_all(points: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """clip_to_canvas() of many polygons with as many points: (points, how many of them count)."""
    n = np.full(len(points), points.shape[1])
    for axis, limit, sign in ((0, np.zeros(len(points)), 1), (0, width, -1), (1, np.zeros(len(points)), 1), (1, height, -1)):
        at = np.arange(points.shape[1])
        after = np.take_along_axis(points, np.where(at + 1 == n[:, None], 0, (at + 1) % points.shape[1])[:, :, None], 1)
        dp, dq = sign * (points[:, :, axis] - limit[:, None]), sign * (after[:, :, axis] - limit[:, None])
        there = at < n[:, None]
        keep, cross = there & (dp >= 0), there & ((dp >= 0) != (dq >= 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            met = points + (after - points) * dp[:, :, None] / (dp - dq)[:, :, None]
        both = np.stack((points, met), 2).reshape(len(points), -1, 2)
        mask = np.stack((keep, cross), 2).reshape(len(points), -1)
        n = mask.sum(1)
        out = np.zeros((len(points), max(1, int(n.max(initial=0))), 2))
        row, slot = np.nonzero(mask)
        out[row, (np.cumsum(mask, 1) - 1)[row, slot]] = both[row, slot]
        points = out
    return points, n


@F.arrow_udf(DoubleType())
def polygon_visible_fraction(polygon: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Share of a convex polygon's area within the canvas, between 0 and 1."""
    w, h = (pc.fill_null(v, np.nan).to_numpy(zero_copy_only=False) for v in (width, height))
    out = np.zeros(len(polygon))
    groups, others = _alike(polygon)
    for rows, points in groups:
        whole = _areas(points, np.full(len(rows), points.shape[1]))
        cut, n = _clip_all(points, w[rows], h[rows])
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.minimum(1.0, np.maximum(0.0, _areas(cut, n) / whole))
        out[rows] = np.where((whole > 0) & (n > 2), share, 0.0)
    for i in others:
        p = _points(polygon[i].as_py())
        whole = shoelace(p) if len(p) > 2 else 0.0
        cut = clip_to_canvas(p, w[i], h[i]) if whole > 0 else p
        out[i] = min(1.0, max(0.0, shoelace(cut) / whole)) if whole > 0 and len(cut) > 2 else 0.0
    return pa.array(out)


@F.arrow_udf(BooleanType())
def polygon_valid(polygon: pa.Array) -> pa.Array:
    out = np.zeros(len(polygon), bool)
    groups, others = _alike(polygon)
    for rows, points in groups:
        out[rows] = _all_simple(points)
    for i in others:
        out[i] = is_simple(_points(polygon[i].as_py()))
    return pa.array(out)


def _all_simple(points: np.ndarray) -> np.ndarray:
    """is_simple() of many polygons with as many points."""
    n = points.shape[1]
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.isfinite(points).all((1, 2)) & (_areas(points, np.full(len(points), n)) > 0)
        turn = lambda a, b, c: (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
        on = lambda a, b, c: ((np.minimum(a, b) <= c) & (c <= np.maximum(a, b))).all(1)
        for i in range(n):
            a, b = points[:, i], points[:, (i + 1) % n]
            for j in range(i + 2, n):
                if (j + 1) % n == i:
                    continue
                c, d = points[:, j], points[:, (j + 1) % n]
                t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
                crossed = ((t1 * t2 < 0) & (t3 * t4 < 0)) | ((t1 == 0) & on(a, b, c)) | ((t2 == 0) & on(a, b, d)) | ((t3 == 0) & on(c, d, a)) | ((t4 == 0) & on(c, d, b))
                good &= ~crossed
    return good


def _bands(polygons: list[np.ndarray]):
    """Horizontal bands without corners or crossings inside: (lower, upper, for each polygon the crossings' lines in order)."""
    sides = [(k, p[i], p[(i + 1) % len(p)]) for k, p in enumerate(polygons) for i in range(len(p)) if p[i][1] != p[(i + 1) % len(p)][1]]
    ys = {float(y) for p in polygons for y in p[:, 1]}
    for i, (_, a, b) in enumerate(sides):
        for _, c, d in sides[:i]:
            u, v = b - a, d - c
            det = u[0] * v[1] - u[1] * v[0]
            if det:
                s = ((c[0] - a[0]) * v[1] - (c[1] - a[1]) * v[0]) / det
                t = ((c[0] - a[0]) * u[1] - (c[1] - a[1]) * u[0]) / det
                if 0 <= s <= 1 and 0 <= t <= 1:
                    ys.add(float(a[1] + s * u[1]))
    levels = sorted(ys)
    for lo, hi in zip(levels, levels[1:], strict=False):
        mid = (lo + hi) / 2
        cuts: list[list[float]] = [[] for _ in polygons]
        for k, a, b in sides:
            if min(a[1], b[1]) < mid < max(a[1], b[1]):
                cuts[k].append(float(a[0] + (mid - a[1]) / (b[1] - a[1]) * (b[0] - a[0])))
        yield hi - lo, [sorted(c) for c in cuts]


def _spans(cuts: list[list[float]]) -> list[tuple[float, float]]:
    """Union of the even-odd intervals of several polygons."""
    parts = sorted((a, b) for c in cuts for a, b in zip(c[::2], c[1::2], strict=False))
    out: list[list[float]] = []
    for a, b in parts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def overlap_areas(subject: list[np.ndarray], other: list[np.ndarray]) -> tuple[float, float]:
    """Area of the union of subject, and of what of it the union of other covers. Bands are exact: sides are straight within them."""
    whole = shared = 0.0
    n = len(subject)
    for height, cuts in _bands([*subject, *other]):
        mine, theirs = _spans(cuts[:n]), _spans(cuts[n:])
        whole += height * sum(b - a for a, b in mine)
        shared += height * sum(max(0.0, min(b, d) - max(a, c)) for a, b in mine for c, d in theirs)
    return whole, shared
