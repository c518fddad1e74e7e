"""Grid cells, polygons and segments on latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = 0.0001
METRES = 111_000.0


def cell(x: Column, size: float = CELL) -> Column:
    """The number of a coordinate's cell; halves go to the even cell."""
    return F.rint(x / size).cast("long")


def cell_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", lat, lon)


def parse_cell_key(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of `lat,lon`; null where it is malformed."""
    parts = F.split(key, ",")
    ok = F.size(parts) == 2
    return tuple(F.when(ok, F.get(parts, F.lit(i)).try_cast("double")) for i in (0, 1))


def crosses(lat: Column, lon: Column, lat_i: Column, lon_i: Column, lat_j: Column, lon_j: Column) -> Column:
    """Whether a ray from the point crosses the edge: half-open in latitude, so that a shared end counts once."""
    at = F.try_divide((lon_j - lon_i) * (lat - lat_i), lat_j - lat_i) + lon_i
    return ((lat_i > lat) != (lat_j > lat)) & F.coalesce(lon < at, F.lit(False))


def boxes_overlap(a: str, b: str) -> Column:
    """Closed boxes in columns `{a}min_lat` and so on."""
    c = F.col
    return (c(f"{a}min_lat") <= c(f"{b}max_lat")) & (c(f"{b}min_lat") <= c(f"{a}max_lat")) & (c(f"{a}min_lon") <= c(f"{b}max_lon")) & (c(f"{b}min_lon") <= c(f"{a}max_lon"))


def segments_cross(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column], s: tuple[Column, Column]) -> Column:
    """Whether p-q and r-s share a point; parallel ones never do."""
    (px, py), (qx, qy), (rx, ry), (sx, sy) = p, q, r, s
    d = (qx - px) * (sy - ry) - (qy - py) * (sx - rx)
    t = F.try_divide((rx - px) * (sy - ry) - (ry - py) * (sx - rx), d)
    u = F.try_divide((rx - px) * (qy - py) - (ry - py) * (qx - px), d)
    return F.coalesce((F.abs(d) >= 1e-12) & t.between(0, 1) & u.between(0, 1), F.lit(False))


def nearest_on_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a-b that is nearest to (x, y)."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return ax + t * dx, ay + t * dy


def to_metres(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """North and east in metres on a plane at lat0."""
    return lat * METRES, lon * METRES * F.cos(F.radians(lat0))


def clean_ring(ring: Column, least: float = 1e-9) -> Column:
    """A ring of [lat, lon] without its closing point (if over three) and without points that repeat the one before."""
    same = lambda a, b: (F.abs(a[0] - b[0]) < least) & (F.abs(a[1] - b[1]) < least)
    n = F.size(ring)
    opened = F.when((n > 3) & same(F.element_at(ring, 1), F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(n - 1, F.lit(0)))).otherwise(ring)
    return F.filter(opened, lambda p, i: (i == 0) | ~same(p, F.get(opened, i - 1)))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
