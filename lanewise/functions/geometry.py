"""Geometry as Column expressions.

A polygon or polyline travels as ``edges``: an array of structs
(ax, ay, bx, by). Image coordinates, y grows downwards.
"""
from pyspark.sql import Column, functions as F

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def ring(points: Column, closed: bool = True) -> Column:
    """Edges of an array of (x, y) structs."""
    n = F.size(points)
    last = n if closed else n - 1
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
        F.element_at(points, i)["x"].alias("ax"), F.element_at(points, i)["y"].alias("ay"),
        F.element_at(points, i % n + 1)["x"].alias("bx"), F.element_at(points, i % n + 1)["y"].alias("by")))


def _segment_dist2(e, x, y):
    """Squared distance to a segment; exactly 0 on an edge along an axis, so that a border belongs to its zone."""
    dx, dy, fx, fy = e["bx"] - e["ax"], e["by"] - e["ay"], x - e["ax"], y - e["ay"]
    dot, length2 = fx * dx + fy * dy, dx * dx + dy * dy
    gx, gy, across = x - e["bx"], y - e["by"], dx * fy - dy * fx
    return (F.when(dot <= 0, fx * fx + fy * fy).when(dot >= length2, gx * gx + gy * gy)
            .otherwise(F.try_divide(across * across, length2)))


def _crosses(e, x, y):
    return ((e["ay"] > y) != (e["by"] > y)) & (
        x < e["ax"] + F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]))


def polygon_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance to the outline in px, positive inside, 0 on it, negative outside."""
    start = F.struct(F.lit(float("inf")).alias("d2"), F.lit(False).alias("odd"))
    return F.aggregate(
        edges, start,
        lambda acc, e: F.struct(F.least(acc["d2"], _segment_dist2(e, x, y)).alias("d2"),
                                (acc["odd"] != F.coalesce(_crosses(e, x, y), F.lit(False))).alias("odd")),
        lambda acc: F.when(acc["odd"], F.sqrt(acc["d2"])).otherwise(-F.sqrt(acc["d2"])))


def in_zone(zone, x: Column, y: Column, margin=0.0) -> Column:
    """Point within ``margin`` px of the zone; the bounding box rules most points out first."""
    m = F.lit(margin) if not isinstance(margin, Column) else margin
    near = ((x >= zone["minx"] - m) & (x <= zone["maxx"] + m)
            & (y >= zone["miny"] - m) & (y <= zone["maxy"] + m))
    return F.when(near, polygon_distance(zone["edges"], x, y) >= -m).otherwise(F.lit(False))


def first_zone(zones: Column, x: Column, y: Column, margin=0.0) -> Column:
    """First zone (array order) containing the point, or NULL."""
    return F.get(F.filter(zones, lambda z: in_zone(z, x, y, margin)), F.lit(0))


def zone_of(islands, roads, crosswalks, x, y) -> Column:
    """Islands win (NULL), then roads in layout order, then ``crosswalk_<name>``."""
    return F.when(F.exists(islands, lambda z: in_zone(z, x, y)), F.lit(None)).otherwise(
        F.coalesce(first_zone(roads, x, y)["name"],
                   F.concat(F.lit("crosswalk_"), first_zone(crosswalks, x, y)["name"])))


def road_depth(islands, roads, crosswalks, x, y) -> Column:
    """Px inside the carriageway; negative off it or on an island."""
    island = first_zone(islands, x, y)
    return F.when(island.isNotNull(), -polygon_distance(island["edges"], x, y)).otherwise(
        F.array_max(F.transform(F.concat(roads, crosswalks),
                                lambda z: polygon_distance(z["edges"], x, y))))


def side_of_line(x0, y0, x1, y1, x, y) -> Column:
    """Signed distance from the infinite line p0 -> p1."""
    dx, dy = x1 - x0, y1 - y0
    return (dx * (y - y0) - dy * (x - x0)) / (F.hypot(dx, dy) + F.lit(1e-9))


def polyline_offset(edges: Column, x: Column, y: Column) -> Column:
    """struct(dist, sign) to the nearest segment whose span holds the point; NULLs beyond the ends."""
    def step(acc, e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        u = ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / (dx * dx + dy * dy + F.lit(1e-9))
        qx, qy = x - e["ax"] - u * dx, y - e["ay"] - u * dy
        d = F.sqrt(qx * qx + qy * qy)
        nearer = (u >= 0.0) & (u <= 1.0) & (acc["dist"].isNull() | (d < acc["dist"]))
        side = F.signum(dx * (y - e["ay"]) - dy * (x - e["ax"]))
        return F.when(nearer, F.struct(d.alias("dist"), side.alias("sign"))).otherwise(acc)
    none = F.struct(F.lit(None).cast("double").alias("dist"), F.lit(None).cast("double").alias("sign"))
    return F.aggregate(edges, none, step)


def line_progress(a, x, y) -> Column:
    """Px past the stop line of approach ``a``, positive downstream."""
    nx, ny = -(a["ly1"] - a["ly0"]), a["lx1"] - a["lx0"]
    norm = F.hypot(nx, ny) + F.lit(1e-9)
    flip = F.when(nx * a["dir_x"] + ny * a["dir_y"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return flip * ((x - a["lx0"]) * nx + (y - a["ly0"]) * ny) / norm


def within_line_span(a, x, y, pad: float = 0.1) -> Column:
    dx, dy = a["lx1"] - a["lx0"], a["ly1"] - a["ly0"]
    u = ((x - a["lx0"]) * dx + (y - a["ly0"]) * dy) / (dx * dx + dy * dy + F.lit(1e-9))
    return (u >= -pad) & (u <= 1 + pad)


def front_point(a, x, y, size) -> tuple[Column, Column]:
    """Front bumper: moved ahead when traffic leaves the camera (the box bottom is then its rear)."""
    away = a["dir_y"] < 0
    return (F.when(away, x + a["dir_x"] * (0.7 * size)).otherwise(x),
            F.when(away, y + a["dir_y"] * (0.7 * size)).otherwise(y))


def box_iou(a: str, b: str) -> Column:
    """IoU of two boxes given column prefixes (``a`` -> a + x1, a + y1, ...)."""
    c = lambda p, k: F.col(p + k)
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    area = lambda p: (c(p, "x2") - c(p, "x1")) * (c(p, "y2") - c(p, "y1"))
    return inter / (area(a) + area(b) - inter + F.lit(1e-9))


def box_overlap(a: str, b: str) -> Column:
    """Share of box ``a`` covered by box ``b``."""
    c = lambda p, k: F.col(p + k)
    w = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    return w * h / F.greatest(F.lit(1e-6), (c(a, "x2") - c(a, "x1")) * (c(a, "y2") - c(a, "y1")))


def edge_flag(width: Column, height: Column, bottom: bool = True, frac: float = 0.01) -> Column:
    """Box touches the frame border (optionally ignoring the bottom one)."""
    m = frac * width
    flag = (F.col("x1") <= m) | (F.col("y1") <= m) | (F.col("x2") >= width - m)
    return flag | (F.col("y2") >= height - m) if bottom else flag
