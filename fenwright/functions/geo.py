"""Planar and spherical geometry as column expressions. Rings are arrays of struct(x, y)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def closed(ring: Column) -> Column:
    """A ring that ends where it begins."""
    return F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def segments(ring: Column) -> Column:
    """array<struct(ax, ay, bx, by)> of a ring, without points."""
    r = closed(ring)
    pairs = F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    return F.filter(pairs, lambda s: (s.ax != s.bx) | (s.ay != s.by))


def signed_area(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0.0), lambda a, s: a + (s.ax * s.by - s.bx * s.ay)) / 2


def centroid(segs: Column) -> Column:
    """struct(x, y): of the area, or of the corners where there is none."""
    area = signed_area(segs)
    moment = lambda k: F.aggregate(segs, F.lit(0.0), lambda a, s: a + (s[f"a{k}"] + s[f"b{k}"]) * (s.ax * s.by - s.bx * s.ay)) / (6 * area)
    mean = lambda k: F.aggregate(segs, F.lit(0.0), lambda a, s: a + s[f"a{k}"]) / F.size(segs)
    return F.struct(*[F.when(F.abs(area) > 1e-9, moment(k)).otherwise(mean(k)).alias(k) for k in "xy"])


def on_segment(x: Column, y: Column, s: Column, tolerance: float = 1e-9) -> Column:
    cross = (s.bx - s.ax) * (y - s.ay) - (s.by - s.ay) * (x - s.ax)
    return (F.abs(cross) <= tolerance) & x.between(F.least(s.ax, s.bx) - tolerance, F.greatest(s.ax, s.bx) + tolerance) & y.between(F.least(s.ay, s.by) - tolerance, F.greatest(s.ay, s.by) + tolerance)


def inside(x: Column, y: Column, segs: Column) -> Column:
    """Whether a point is in a polygon (all its rings' segments; holes by the even-odd rule), borders included."""
    crossings = F.size(F.filter(segs, lambda s: ((s.ay > y) != (s.by > y)) & (x < (s.bx - s.ax) * (y - s.ay) / F.when(s.by != s.ay, s.by - s.ay) + s.ax)))
    return F.exists(segs, lambda s: on_segment(x, y, s)) | (crossings % 2 == 1)


def to_segment(x: Column, y: Column, s: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = s.bx - s.ax, s.by - s.ay
    long = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - s.ax) * dx + (y - s.ay) * dy, long), F.lit(0.0))))
    return F.hypot(x - (s.ax + t * dx), y - (s.ay + t * dy))


def to_polygon(x: Column, y: Column, segs: Column) -> Column:
    return F.when(inside(x, y, segs), F.lit(0.0)).otherwise(F.array_min(F.transform(segs, lambda s: to_segment(x, y, s))))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(F.abs(v) <= 1e-9, 0).otherwise(F.signum(v))


def cross(s: Column, o: Column) -> Column:
    """Whether two segments share a point."""
    a, b = _turn(s.ax, s.ay, s.bx, s.by, o.ax, o.ay), _turn(s.ax, s.ay, s.bx, s.by, o.bx, o.by)
    c, d = _turn(o.ax, o.ay, o.bx, o.by, s.ax, s.ay), _turn(o.ax, o.ay, o.bx, o.by, s.bx, s.by)
    return ((a != b) & (c != d)) | on_segment(o.ax, o.ay, s) | on_segment(o.bx, o.by, s) | on_segment(s.ax, s.ay, o) | on_segment(s.bx, s.by, o)


def crossed(s: np.ndarray, o: np.ndarray) -> np.ndarray:
    """`cross` of two arrays of segments (ax, ay, bx, by), row by row; the same sums in the same order."""
    (sax, say, sbx, sby), (oax, oay, obx, oby) = s.T, o.T

    def side(ax, ay, bx, by, x, y):  # noqa: ANN001, ANN202
        v = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on = np.abs(v) <= 1e-9
        inside = on & (x >= np.minimum(ax, bx) - 1e-9) & (x <= np.maximum(ax, bx) + 1e-9) & (y >= np.minimum(ay, by) - 1e-9) & (y <= np.maximum(ay, by) + 1e-9)
        return np.where(on, 0.0, np.sign(v)), inside

    (a, on_a), (b, on_b) = side(sax, say, sbx, sby, oax, oay), side(sax, say, sbx, sby, obx, oby)
    (c, on_c), (d, on_d) = side(oax, oay, obx, oby, sax, say), side(oax, oay, obx, oby, sbx, sby)
    return ((a != b) & (c != d)) | on_a | on_b | on_c | on_d



def between_segments(s: Column, o: Column) -> Column:
    return F.when(cross(s, o), F.lit(0.0)).otherwise(F.least(to_segment(s.ax, s.ay, o), to_segment(s.bx, s.by, o), to_segment(o.ax, o.ay, s), to_segment(o.bx, o.by, s)))


def between_polygons(a: Column, b: Column) -> Column:
    """Least distance of two polygons' borders, 0 where they meet."""
    return F.array_min(F.transform(a, lambda s: F.array_min(F.transform(b, lambda o: between_segments(s, o)))))


def shared_border(a: Column, b: Column, parallel: float = 0.985, apart: float = 3.0) -> Column:
    """Length along which borders run beside each other: nearly parallel, at most `apart` off, overlapping on their axis."""

    def overlap(s: Column, o: Column) -> Column:
        sl, ol = F.hypot(s.bx - s.ax, s.by - s.ay), F.hypot(o.bx - o.ax, o.by - o.ay)
        ux, uy = (s.bx - s.ax) / sl, (s.by - s.ay) / sl
        along = lambda x, y: (x - s.ax) * ux + (y - s.ay) * uy
        off = lambda x, y: F.abs((x - s.ax) * uy - (y - s.ay) * ux)
        p, q = along(o.ax, o.ay), along(o.bx, o.by)
        run = F.least(sl, F.greatest(p, q)) - F.greatest(F.lit(0.0), F.least(p, q))
        beside = (F.abs(ux * (o.bx - o.ax) + uy * (o.by - o.ay)) >= parallel * ol) & (F.least(off(o.ax, o.ay), off(o.bx, o.by)) <= apart)
        return F.when(beside & (run > 0), run).otherwise(F.lit(0.0))

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, v: t + v)
    return total(F.transform(a, lambda s: total(F.transform(b, lambda o: overlap(s, o)))))


# The plane grid (GRS80 ellipsoid, origin 38 N 127 E, false origin 200 km and 600 km, scale 1).
GRS80_A, GRS80_F, ORIGIN_LAT, ORIGIN_LON, FALSE_X, FALSE_Y = 6_378_137.0, 1 / 298.257222101, 38.0, 127.0, 200_000.0, 600_000.0


def to_plane(lat: Column, lon: Column) -> Column:
    """struct(x, y): transverse Mercator by the usual series in the difference of longitude; under a millimetre off within 3 degrees."""
    e2 = GRS80_F * (2 - GRS80_F)
    ep2 = e2 / (1 - e2)
    p, o = F.radians(lat), F.radians(F.lit(ORIGIN_LAT))
    arc = lambda f: GRS80_A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * f - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * f) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * f) - (35 * e2**3 / 3072) * F.sin(6 * f))
    n = GRS80_A / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t, c, a = F.pow(F.tan(p), 2), ep2 * F.pow(F.cos(p), 2), F.radians(lon - ORIGIN_LON) * F.cos(p)
    x = n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    y = arc(p) - arc(o) + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720)
    return F.struct((x + FALSE_X).alias("x"), (y + FALSE_Y).alias("y"))
