"""Boxes, distances and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1, y1, x2, y2) -> Column:
    return (x2 - x1) * (y2 - y1)


def overlap_area(a, b) -> Column:
    """Common area of two boxes, structs with x1, y1, x2, y2."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def box_area(a) -> Column:
    return area(a["x1"], a["y1"], a["x2"], a["y2"])


def iou(a, b) -> Column:
    """Intersection over union; 0 for boxes without area."""
    common = overlap_area(a, b)
    union = box_area(a) + box_area(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def overlap_of_smaller(a, b) -> Column:
    least = F.least(box_area(a), box_area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def angle_degrees(ax, ay, bx, by) -> Column:
    return F.degrees(F.atan2(by - ay, bx - ax))


def folded_angle(angle) -> Column:
    """Angle to the nearest axis, 0 to 45."""
    a = F.abs(angle) % 90
    return F.when(a > 45, 90 - a).otherwise(a)


def parallel_difference(a, b) -> Column:
    """Angle between two lines, 0 to 90."""
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


def polygon_box(points: Column) -> Column:
    """Struct x1, y1, x2, y2 around an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def polygon_center(points: Column) -> Column:
    n = F.size(points)
    total = lambda i: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[i])
    return F.struct((total(0) / n).alias("cx"), (total(1) / n).alias("cy"))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of [x, y]."""
    n = F.size(points)
    at = F.sequence(F.lit(0), n - 1)
    term = lambda i: points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1]
    return F.abs(F.aggregate(at, F.lit(0.0), lambda a, i: a + term(i))) / 2


def circularity(area_: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area_ / (perimeter * perimeter)).otherwise(0.0)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(long2, F.lit(0))))
    t = F.coalesce(t, F.lit(0.0))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def segment_crossing(a, b) -> Column:
    """Struct x, y (whole numbers, toward zero) where two segments meet; null for parallel or apart ones."""
    d = (a["x1"] - a["x2"]) * (b["y1"] - b["y2"]) - (a["y1"] - a["y2"]) * (b["x1"] - b["x2"])
    d = F.nullif(d.cast("double"), F.lit(0.0))
    t = ((a["x1"] - b["x1"]) * (b["y1"] - b["y2"]) - (a["y1"] - b["y1"]) * (b["x1"] - b["x2"])) / d
    u = -((a["x1"] - a["x2"]) * (a["y1"] - b["y1"]) - (a["y1"] - a["y2"]) * (a["x1"] - b["x1"])) / d
    meet = t.between(0, 1) & u.between(0, 1)
    return F.when(meet, F.struct((a["x1"] + t * (a["x2"] - a["x1"])).cast("int").alias("x"), (a["y1"] + t * (a["y2"] - a["y1"])).cast("int").alias("y")))


def in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Whether a point lies in a polygon or on its border."""
    n = F.size(points)
    at = F.sequence(F.lit(0), n - 1)

    def ends(i):
        return points[i][0], points[i][1], points[(i + 1) % n][0], points[(i + 1) % n][1]

    def border(i):
        x1, y1, x2, y2 = ends(i)
        return ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))

    def crosses(i):
        x1, y1, x2, y2 = ends(i)
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif((y2 - y1).cast("double"), F.lit(0.0)) + x1)

    return F.exists(at, border) | (F.aggregate(at, F.lit(0), lambda a, i: a + F.coalesce(crosses(i), F.lit(False)).cast("int")) % 2 == 1)


def vertical_overlap(a_y1, a_y2, b_y1, b_y2) -> Column:
    """Common height over the larger height."""
    most = F.greatest(a_y2 - a_y1, b_y2 - b_y1)
    return F.when(most > 0, F.greatest(F.lit(0), F.least(a_y2, b_y2) - F.greatest(a_y1, b_y1)) / most).otherwise(0.0)


def scaled_back(points: Column, scale: Column) -> Column:
    return F.transform(points, lambda p: F.transform(p, lambda v: v / scale))


def rotated_back(x: Column, y: Column, angle: Column, w: Column, h: Column) -> Column:
    """A point of a page turned clockwise by 0, 90, 180 or 270 degrees, on the page of size w, h before the turn."""
    return F.struct(
        F.when(angle == 90, y).when(angle == 180, w - x).when(angle == 270, w - y).otherwise(x).alias("x"),
        F.when(angle == 90, h - x).when(angle == 180, h - y).when(angle == 270, x).otherwise(y).alias("y"),
    )


def normalized_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct((x / page_w).alias("nx"), (y / page_h).alias("ny"), (w / page_w).alias("nw"), (h / page_h).alias("nh"), ((x + w / 2) / page_w).alias("ncx"), ((y + h / 2) / page_h).alias("ncy"))


def context_window(x1, y1, x2, y2, page_w, page_h, expand: float = 2.0, least: int = 200) -> Column:
    """The box grown about its centre to expand times its size, at least ``least`` wide and high, clipped to the page."""
    cx, cy = F.floor((x1 + x2) / 2), F.floor((y1 + y2) / 2)
    w, h = F.greatest(F.lit(least), ((x2 - x1) * expand).cast("int")), F.greatest(F.lit(least), ((y2 - y1) * expand).cast("int"))
    low = lambda c, s: F.greatest(F.lit(0), c - F.floor(s / 2))
    return F.struct(low(cx, w).alias("x1"), low(cy, h).alias("y1"), F.least(page_w, cx + F.floor(w / 2)).alias("x2"), F.least(page_h, cy + F.floor(h / 2)).alias("y2"))


def padded(x1, y1, x2, y2, page_w, page_h, by) -> Column:
    return F.struct(F.greatest(F.lit(0), x1 - by).alias("x1"), F.greatest(F.lit(0), y1 - by).alias("y1"), F.least(page_w, x2 + by).alias("x2"), F.least(page_h, y2 + by).alias("y2"))


def header_height(page_h: Column) -> Column:
    return (page_h * 0.15).cast("int")


def tiles(w: Column, h: Column, size: int, stride: int, least_share: float = 0.0) -> Column:
    """Array of structs x, y, w, h: windows by stride, cut at the page's edge; those under least_share of the size are left out."""
    steps = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(stride))
    cells = F.flatten(F.transform(steps(h), lambda y: F.transform(steps(w), lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(size), w - x).alias("w"), F.least(F.lit(size), h - y).alias("h")))))
    return F.filter(cells, lambda c: (c["w"] >= size * least_share) & (c["h"] >= size * least_share))


def exact_tiles(w: Column, h: Column, size: int, stride: int) -> Column:
    """Array of structs x, y: only windows that fit whole."""
    steps = lambda n: F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(steps(h), lambda y: F.transform(steps(w), lambda x: F.struct(x.alias("x"), y.alias("y")))))
