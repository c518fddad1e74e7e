"""Positions on a grid, bounding boxes, polygons and hulls.

A polygon is a table of edges (poly_id, lat_i, lon_i, lat_j, lon_j) with its box; cells meet polygons by tiles of TILE
degrees, an equi-join, before the exact test. Hulls are drawn for each bag from the ends of its rows of cells, of which
there are at most two for each row, and not from all positions.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

#: Degrees, and the most tiles that span a polygon.
TILE, TILES = 0.01, 64
Ring = list[tuple[float, float]]


def valid_positions(p: DataFrame) -> DataFrame:
    """Without positions that have a zero coordinate: receivers send them before the first fix."""
    return p.where((F.col("lat") != 0) & (F.col("lon") != 0))


def grid(p: DataFrame, size: float = geo.CELL) -> DataFrame:
    """(bag, mcap_id, lat_idx, lon_idx, cnt): positions by cell; a null segment is 'unknown'."""
    return p.groupBy("bag", F.coalesce("mcap_id", F.lit("unknown")).alias("mcap_id"), geo.cell(F.col("lat"), size).alias("lat_idx"), geo.cell(F.col("lon"), size).alias("lon_idx")).agg(F.count("*").alias("cnt"))


def with_degrees(cells: DataFrame, size: float = geo.CELL) -> DataFrame:
    return cells.withColumns({"lat": F.col("lat_idx") * size, "lon": F.col("lon_idx") * size})


def grid_totals(cells: DataFrame) -> DataFrame:
    """Counts by (bag, cell, segment), (bag, cell), (bag, segment) and (cell) in one pass."""
    cell, sets = ["lat_idx", "lon_idx"], [["bag", "lat_idx", "lon_idx", "mcap_id"], ["bag", "lat_idx", "lon_idx"], ["bag", "mcap_id"], ["lat_idx", "lon_idx"]]
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], "bag", *cell, "mcap_id").agg(F.sum("cnt").alias("cnt"), F.grouping_id().cast("int").alias("level"))


def nested_grid(cells: DataFrame) -> DataFrame:
    """(bag, key, total, mcaps): of every cell its total and a map of its counts by segment. A bag's document is its rows; no
    group holds more than the segments of one cell."""
    keyed = with_degrees(cells).withColumn("key", geo.cell_key(F.col("lat"), F.col("lon")))
    return keyed.groupBy("bag", "key").agg(F.sum("cnt").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mcap_id", "cnt")))).alias("mcaps"))


def exploded_grid(nested: DataFrame) -> DataFrame:
    """The way back: (bag, lat, lon, count); malformed keys are skipped."""
    lat, lon = geo.parse_cell_key(F.col("key"))
    return nested.select("bag", lat.alias("lat"), lon.alias("lon"), F.col("total").alias("count")).where("lat is not null and lon is not null")


def segment_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("bag", "mcap_id").agg(F.sum("cnt").alias("cnt")).orderBy("bag", F.col("mcap_id").try_cast("int").asc_nulls_last(), "mcap_id")


def heat_points(cells: DataFrame, by: tuple[str, ...] = ("bag",)) -> DataFrame:
    """Counts by cell, of each bag or (by=()) of all."""
    return cells.groupBy(*by, "lat_idx", "lon_idx").agg(F.sum("cnt").alias("cnt"))


def intensity(points: DataFrame, by: tuple[str, ...] = ("bag",)) -> DataFrame:
    """max(cnt / largest, 0.05) within each group, joined to its maximum."""
    most = points.groupBy(*by).agg(F.max("cnt").alias("_m")) if by else points.agg(F.max("cnt").alias("_m"))
    joined = points.join(most, list(by)) if by else points.withColumn("_m", most.scalar())
    return joined.withColumn("intensity", F.when(F.col("_m") > 0, F.greatest(F.col("cnt") / F.col("_m"), F.lit(0.05))).otherwise(0.1)).drop("_m")


def boxes(p: DataFrame, by: tuple[str, ...] = ("bag",)) -> DataFrame:
    return p.groupBy(*by).agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def centroids(p: DataFrame, by: tuple[str, ...] = ("bag", "mcap_id")) -> DataFrame:
    return p.groupBy(*by).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def nearest_point(p: DataFrame, lat: float, lon: float, within: float = 1e-4) -> DataFrame:
    """The position that is nearest in degrees, if it is nearer than `within`."""
    d = F.sqrt((F.col("lat") - lat) * (F.col("lat") - lat) + (F.col("lon") - lon) * (F.col("lon") - lon))
    return p.withColumn("distance", d).where(F.col("distance") < within).orderBy("distance", *p.columns).limit(1)


def polygon_edges(spark: SparkSession, polygons: dict[str, Ring]) -> DataFrame:
    """The edges and boxes of rings of (lat, lon), of which those of under three points have none."""
    rows = []
    for name, ring in polygons.items():
        if len(ring) < 3:
            continue
        lats, lons = [p[0] for p in ring], [p[1] for p in ring]
        for i, (a, b) in enumerate(ring):
            c, d = ring[i - 1]
            rows.append((name, i, float(a), float(b), float(c), float(d), float(min(lats)), float(max(lats)), float(min(lons)), float(max(lons))))
    return spark.createDataFrame(rows, "poly_id string, seq int, lat_i double, lon_i double, lat_j double, lon_j double, min_lat double, max_lat double, min_lon double, max_lon double")


def geojson_rings(text: str) -> dict[str, Ring]:
    """The outer rings of a FeatureCollection's polygons as open rings of (lat, lon)."""
    data = json.loads(text)
    if data.get("type") != "FeatureCollection":
        raise ValueError("not a FeatureCollection")
    out = {}
    for i, f in enumerate(data.get("features", [])):
        g = f.get("geometry") or {}
        if g.get("type") == "Polygon" and g.get("coordinates"):
            ring = [(float(p[1]), float(p[0])) for p in g["coordinates"][0]]
            out[str((f.get("properties") or {}).get("name", i))] = ring[:-1] if len(ring) > 3 and ring[0] == ring[-1] else ring
    return out


def points_in_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points with poly_id, a row for each polygon that holds it: even-odd rule, half-open on borders.

    Points and boxes are cut into tiles and joined on them, so that a point meets only the polygons near it. The tiles of a
    polygon are TILE wide, doubled until at most TILES of them span its box; a point has one tile of each width in use."""
    tile = lambda x, level: F.floor(x / (TILE * F.pow(F.lit(2.0), level))).cast("long")
    span = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span, F.lit(TILE)) / (TILE * TILES)))).cast("int")
    boxed = edges.select("poly_id", "min_lat", "max_lat", "min_lon", "max_lon").distinct().withColumn("_l", level)
    every = lambda a, b: F.explode(F.sequence(tile(F.col(a), F.col("_l")), tile(F.col(b), F.col("_l"))))
    tiles = boxed.select("poly_id", "_l", every("min_lat", "max_lat").alias("_ty"), "min_lon", "max_lon").select("poly_id", "_l", "_ty", every("min_lon", "max_lon").alias("_tx"))
    levels = [r["_l"] for r in boxed.select("_l").distinct().collect()] or [0]  # at most a few: a degree has seven
    places = points.select("lat", "lon").distinct().withColumn("_l", F.explode(F.array(*map(F.lit, levels))))
    places = places.withColumns({"_ty": tile(F.col("lat"), F.col("_l")), "_tx": tile(F.col("lon"), F.col("_l"))})
    near = places.join(tiles, ["_l", "_ty", "_tx"]).join(edges, "poly_id")
    c = F.col
    hit = geo.crosses(c("lat"), c("lon"), c("lat_i"), c("lon_i"), c("lat_j"), c("lon_j"))
    inside = near.groupBy("lat", "lon", "poly_id").agg((F.count_if(hit) % 2 == 1).alias("inside")).where("inside").drop("inside")
    return points.join(inside, ["lat", "lon"])


def bags_in_polygons(cells: DataFrame, edges: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """(bag) with any cell in any polygon; with boundaries (bag and box), bags whose box meets no polygon's are not tried."""
    if boundaries is not None:
        p = edges.select("poly_id", *(F.col(c).alias(f"p_{c}") for c in ("min_lat", "max_lat", "min_lon", "max_lon"))).distinct()
        cells = cells.join(boundaries.join(p, geo.boxes_overlap("", "p_"), "left_semi").select("bag"), "bag", "left_semi")
    return points_in_polygons(with_degrees(cells), edges).select("bag").distinct()


def segments_in_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    return points_in_polygons(with_degrees(cells), edges).select("bag", "mcap_id").distinct()


def islands(ids: DataFrame, by: list[str], idx: str) -> DataFrame:
    """(by, lo, hi, n): runs of consecutive whole numbers."""
    one = ids.where(F.col(idx).isNotNull()).select(*by, idx).distinct()
    numbered = one.withColumn("_g", F.col(idx) - F.row_number().over(W.partitionBy(*by).orderBy(idx)))
    return numbered.groupBy(*by, "_g").agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"), F.count("*").alias("n")).drop("_g")


def area_text(runs: DataFrame) -> DataFrame:
    """(bag, text): `bag: 0 - 4, 7, 9 - 11`."""
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws(" - ", F.col("lo").cast("string"), F.col("hi").cast("string")))
    per = runs.groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("lo", one.alias("t")))).alias("r"))
    return per.select("bag", F.concat(F.col("bag"), F.lit(": "), F.array_join(F.transform("r", lambda x: x["t"]), ", ")).alias("text"))


def cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: Ring) -> Ring:
    """Counter-clockwise in the order of coordinates, without points on edges; under three points, those."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq: Ring) -> Ring:
        out: Ring = []
        for p in seq:
            while len(out) > 1 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def simplified(ring: Ring, tolerance: float) -> Ring:
    """A closed ring thinned by distance from chords; a stack in place of recursion."""
    if len(ring) < 4:
        return ring
    keep, far = {0}, max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))
    keep.add(far)
    stack = [(0, far), (far, len(ring))]
    while stack:
        a, b = stack.pop()
        p, q = ring[a], ring[b % len(ring)]
        best, at = tolerance, None
        for i in range(a + 1, b):
            dx, dy = q[0] - p[0], q[1] - p[1]
            n = dx * dx + dy * dy
            s = max(0.0, min(1.0, ((ring[i][0] - p[0]) * dx + (ring[i][1] - p[1]) * dy) / n)) if n else 0.0
            d = math.dist(ring[i], (p[0] + s * dx, p[1] + s * dy))
            if d > best:
                best, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [ring[i] for i in sorted(keep)]


def traced(edges: list[tuple[tuple[int, int], tuple[int, int]]], most: int = 80) -> list[Ring]:
    """Closed rings of directed border edges, the ones of most corners first, holes among them. Long ones are simplified at
    1 % of their box's diagonal."""
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p, q in edges:
        follow.setdefault(p, []).append(q)
    rings = []
    for start in sorted(p for p, qs in follow.items() for _ in qs):
        if start not in follow:
            continue
        ring, at = [start], start
        while True:
            nexts = follow[at]
            to = nexts.pop()
            if not nexts:
                del follow[at]
            if to == start:
                break
            ring.append(to)
            at = to
        lats, lons = [p[0] for p in ring], [p[1] for p in ring]
        points = [(float(p[0]), float(p[1])) for p in ring]
        rings.append((len(ring), simplified(points, 0.01 * math.dist((min(lats), min(lons)), (max(lats), max(lons)))) if len(ring) > most else points))
    return [r for _, r in sorted(rings, key=lambda x: -x[0])]


#: Of a filled cell (a, b): the neighbour across a side, and the side's ends, so that the cell is on its left.
SIDES = [((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0))]


def border(cells: DataFrame) -> DataFrame:
    """(bag, p0, p1, q0, q1): directed sides between filled and empty cells. A position's cell fills the four squares around
    it, which bridges cells within two of each other, as an alpha shape with edges of up to 2.5 cells would."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    filled = cells.select("bag", "lat_idx", "lon_idx").distinct().withColumn("c", corner)
    filled = filled.select("bag", (F.col("lat_idx") + F.col("c.i")).alias("a"), (F.col("lon_idx") + F.col("c.j")).alias("b")).distinct()
    names = ("x", "y", "p0", "p1", "q0", "q1")
    side = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (*out, *p, *q), strict=True))) for out, p, q in SIDES)))
    sides = filled.withColumn("s", side).select("bag", *((F.col("a" if n in ("x", "p0", "q0") else "b") + F.col(f"s.{n}")).alias(n) for n in names))
    empty = sides.join(filled.select("bag", F.col("a").alias("x"), F.col("b").alias("y")), ["bag", "x", "y"], "left_anti")
    return empty.select("bag", "p0", "p1", "q0", "q1")


HULL = "bag string, rings array<array<array<double>>>"


def concave_hulls(cells: DataFrame, size: float = geo.CELL) -> DataFrame:
    """(bag, rings): outlines around each bag's cells, holes among them. Filling and finding the border are joins; only the
    sides of one bag's border, not its cells, come to one task."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (zip(pdf[f"{k}0"].astype(int), pdf[f"{k}1"].astype(int), strict=True) for k in "pq")
        rings = traced(list(zip(p, q, strict=True)))
        return pd.DataFrame({"bag": [pdf["bag"].iloc[0]], "rings": [[[[(a - 0.5) * size, (b - 0.5) * size] for a, b in r] for r in rings]]})

    return border(cells).groupBy("bag").applyInPandas(hull, HULL)


def convex_hulls(cells: DataFrame, size: float = geo.CELL) -> DataFrame:
    """(bag, rings): one ring for each bag, from the first and last cell of each of its rows, which hold all its corners."""
    ends = cells.groupBy("bag", "lat_idx").agg(F.min("lon_idx").alias("a"), F.max("lon_idx").alias("b"))

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = [(int(x), int(y)) for c in ("a", "b") for x, y in zip(pdf["lat_idx"], pdf[c], strict=True)]
        return pd.DataFrame({"bag": [pdf["bag"].iloc[0]], "rings": [[[[x * size, y * size] for x, y in convex_hull(pts)]]]})

    return ends.groupBy("bag").applyInPandas(hull, HULL)


def inside(p: tuple[float, float], ring: Ring) -> bool:
    out = False
    for (a, b), (c, d) in zip(ring, ring[-1:] + ring[:-1], strict=True):
        if (a > p[0]) != (c > p[0]) and p[1] < (d - b) * (p[0] - a) / (c - a) + b:
            out = not out
    return out and len(ring) >= 3


def rings_overlap(a: Ring, b: Ring) -> bool:
    """Whether a corner of one lies in the other or two edges cross."""
    if any(inside(p, b) for p in a) or any(inside(p, a) for p in b):
        return True
    for p, q in zip(a, a[1:] + a[:1], strict=True):
        for r, s in zip(b, b[1:] + b[:1], strict=True):
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if abs(d) >= 1e-12:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                u = ((r[0] - p[0]) * (q[1] - p[1]) - (r[1] - p[1]) * (q[0] - p[0])) / d
                if 0 <= t <= 1 and 0 <= u <= 1:
                    return True
    return False


def hulls_overlapping(hulls: DataFrame, polygons: dict[str, Ring]) -> DataFrame:
    """(bag) of hulls that overlap a polygon; no polygons: all, no hull: none."""
    if not polygons:
        return hulls.select("bag")

    def test(rings: pd.Series) -> pd.Series:
        return pd.Series([any(rings_overlap([tuple(p) for p in r], ring) for r in (rs if rs is not None else []) for ring in polygons.values()) for rs in rings])

    return hulls.where(F.pandas_udf(test, "boolean")(F.col("rings"))).select("bag")


#: Places nearer than this, in metres, are one; a side of an edge is looked at this far off it.
SNAP, ASIDE = 1e-6, 1e-4


def raw_offset(xy: np.ndarray, by: float, miter: float) -> np.ndarray:
    """The path of a counter-clockwise ring's edges moved by `by` to their right; it may cross itself. Corners that open are mitred,
    and squared beyond `miter` times the distance; at others the path goes through the corner itself."""
    edges = np.roll(xy, -1, axis=0) - xy
    ways = edges / np.hypot(*edges.T)[:, None]
    out = []
    for k, q in enumerate(xy):
        e0, e1 = ways[k - 1], ways[k]
        n0, n1 = np.array([e0[1], -e0[0]]), np.array([e1[1], -e1[0]])
        turn, same = e0[0] * e1[1] - e0[1] * e1[0], float(n0 @ n1)
        if turn * by < 0 and same < 1 - 1e-12:
            out += [q + n0 * by, q, q + n1 * by]
        elif 1 + same >= 2 / miter**2:
            out.append(q + (n0 + n1) * by / (1 + same))
        else:
            side = abs(by) * math.tan(math.acos(max(-1.0, min(1.0, same))) / 4)
            out += [q + n0 * by + e0 * side, q + n1 * by - e1 * side]
    return np.array(out)


def winding(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often the closed path of edges a-b goes around each point."""
    x, y = points[:, 0, None], points[:, 1, None]
    side = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (x - a[:, 0]) * (b[:, 1] - a[:, 1])
    up, down = (a[:, 1] <= y) & (b[:, 1] > y) & (side > 0), (a[:, 1] > y) & (b[:, 1] <= y) & (side < 0)
    return up.sum(axis=1) - down.sum(axis=1)


def cut_at_crossings(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a closed path between all places where they meet."""
    a, b = path, np.roll(path, -1, axis=0)
    starts, ends = [], []
    for p, q in zip(a, b, strict=True):
        d = q - p
        length = float(d @ d)
        if length < SNAP**2:
            continue
        e = b - a
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((a[:, 0] - p[0]) * e[:, 1] - (a[:, 1] - p[1]) * e[:, 0]) / cross
            u = ((a[:, 0] - p[0]) * d[1] - (a[:, 1] - p[1]) * d[0]) / cross
        hit = (np.abs(cross) > 1e-12) & (t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)
        on = (a - p) @ d / length  # corners that lie on this edge, as those of edges along it
        near = np.abs(d[0] * (a[:, 1] - p[1]) - d[1] * (a[:, 0] - p[0])) <= SNAP * math.sqrt(length)
        cuts = np.unique(np.concatenate([[0.0, 1.0], t[hit], on[near & (on > 0) & (on < 1)]]))
        places = p + cuts[:, None] * d
        starts.append(places[:-1])
        ends.append(places[1:])
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros((0, 2)), np.zeros((0, 2)))


def positive_rings(path: np.ndarray) -> list[np.ndarray]:
    """The borders of what a closed path goes around counter-clockwise more often than the other way, inside on the left."""
    a, b = cut_at_crossings(path)
    way = b - a
    length = np.hypot(*way.T)
    a, b, way = (x[length > SNAP] for x in (a, b, way))
    if not len(a):
        return []
    aside = np.stack([-way[:, 1], way[:, 0]], axis=1) / np.hypot(*way.T)[:, None] * np.minimum(ASIDE, np.hypot(*way.T) / 4)[:, None]
    middle, whole = (a + b) / 2, (path, np.roll(path, -1, axis=0))
    border = (winding(middle + aside, *whole) > 0) & (winding(middle - aside, *whole) <= 0)
    key = lambda p: (round(p[0] / SNAP / 4), round(p[1] / SNAP / 4))
    leaving: dict[tuple, dict[tuple, np.ndarray]] = {}
    for p, q in zip(a[border], b[border], strict=True):
        if key(p) != key(q):
            leaving.setdefault(key(p), {})[key(q)] = q
    rings = []
    while leaving:
        first = at = next(iter(leaving))
        ring, came = [], None
        while at in leaving:
            here = np.array(at) * SNAP * 4
            angle = lambda k, here=here, came=came: 0.0 if came is None else (math.atan2(*(np.array(k) * SNAP * 4 - here)[::-1]) - came) % (2 * math.pi)
            to = max(leaving[at], key=angle)  # the sharpest turn to the left keeps pieces that touch apart
            place = leaving[at].pop(to)
            if not leaving[at]:
                del leaving[at]
            ring.append(place)
            came = math.atan2(*(here - place)[::-1])
            at = to
            if at == first:
                break
        if len(ring) >= 3:
            rings.append(np.array(ring))
    return rings


def straightened(ring: np.ndarray) -> np.ndarray:
    """Without corners on a straight line."""
    before, after = np.roll(ring, 1, axis=0) - ring, np.roll(ring, -1, axis=0) - ring
    bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 10 * SNAP * np.maximum(np.hypot(*before.T), np.hypot(*after.T))
    return ring[bent]


def offset_rings(ring: Ring, metres: float, miter: float = 10.0) -> list[Ring]:
    """A ring grown by metres (shrunk if negative), corners mitred: every ring of the result, as a concave one may fall into
    pieces when it shrinks, or close around holes when it grows. Nothing left gives the ring itself."""
    xy = np.array([(p[1], p[0]) for p in ring], dtype=float).reshape(-1, 2)
    if len(xy) > 3 and (xy[0] == xy[-1]).all():
        xy = xy[:-1]
    if len(xy) < 3 or not metres:
        return [ring]
    middle = xy.mean(axis=0)
    scale = np.array([geo.METRES * math.cos(math.radians(middle[1])), geo.METRES])
    xy = (xy - middle) * scale
    xy = xy[np.hypot(*(xy - np.roll(xy, 1, axis=0)).T) > SNAP]
    x, y = xy.T
    area = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())
    if len(xy) < 3 or not area:
        return [ring]
    found = [straightened(r) for r in positive_rings(raw_offset(xy if area > 0 else xy[::-1], metres, miter))]
    return [[(float(q[1]), float(q[0])) for q in r / scale + middle] for r in found if len(r) >= 3] or [ring]


def boundaries(p: DataFrame, size: float = geo.CELL) -> DataFrame:
    """(bag, hull, box): the concave hull, or the convex one where it has no ring."""
    cells = grid(valid_positions(p), size)
    hulls = concave_hulls(cells, size).withColumnRenamed("rings", "hull")
    other = convex_hulls(cells, size).withColumnRenamed("rings", "convex")
    hull = F.when(F.size("hull") > 0, F.col("hull")).otherwise(F.col("convex"))
    return boxes(valid_positions(p)).join(hulls, "bag").join(other, "bag").select("bag", hull.alias("hull"), "min_lat", "min_lon", "max_lat", "max_lon")


def highlight(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """segments (bag, mcap_id) with whether they are among the chosen ones."""
    return segments.join(chosen.select("bag", "mcap_id").distinct().withColumn("_h", F.lit(True)), ["bag", "mcap_id"], "left").withColumn("highlighted", F.coalesce("_h", F.lit(False))).drop("_h")

