"""Points, the grid's projection, and polygon lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.scalars import ratio
from ..storage import Scratch
from .clean import first_stop
from .joins import null_safe_join
from .summaries import route_location


def points(df: DataFrame, lon: str = S.LON, lat: str = S.LAT, srid: int = 4326) -> DataFrame:
    """Rows with coordinates, as ``lon``, ``lat``, ``srid``. Fails on a latitude that can only be a longitude."""
    located = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    checked = F.when(F.abs(F.col(lat)) <= 90, F.col(lat)).otherwise(
        F.raise_error("latitude beyond 90 degrees: longitude and latitude are probably swapped")
    )
    out = located.withColumns({"__lon": F.col(lon).cast("double"), "__lat": checked.cast("double")})
    return out.drop(lon, lat).withColumnsRenamed({"__lon": "lon", "__lat": "lat"}).withColumn("srid", F.lit(srid))


@dataclass(frozen=True)
class DoubleStereographic:
    """Parameters of an oblique stereographic projection on an ellipsoid; angles in degrees.

    The defaults are the fixed values of EPSG 2953.
    """

    a: float = 6378137.0
    inverse_flattening: float = 298.257222101
    lat0: float = 46.5
    lon0: float = -66.5
    k0: float = 0.999912
    false_easting: float = 2_500_000.0
    false_northing: float = 7_500_000.0


def project_points(df: DataFrame, lon: str = "lon", lat: str = "lat",
                   params: DoubleStereographic = DoubleStereographic()) -> DataFrame:
    """Adds ``easting`` and ``northing``: ellipsoid to conformal sphere to plane (EPSG guidance note 7-2)."""
    f = 1 / params.inverse_flattening
    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    phi0, lam0 = math.radians(params.lat0), math.radians(params.lon0)
    s0 = math.sin(phi0)
    rho0 = params.a * (1 - e2) / (1 - e2 * s0**2) ** 1.5
    nu0 = params.a / math.sqrt(1 - e2 * s0**2)
    radius = math.sqrt(rho0 * nu0)
    n = math.sqrt(1 + e2 * math.cos(phi0) ** 4 / (1 - e2))
    w1 = ((1 + s0) / (1 - s0) * ((1 - e * s0) / (1 + e * s0)) ** e) ** n
    sin_chi0 = (w1 - 1) / (w1 + 1)
    c = (n + s0) * (1 - sin_chi0) / ((n - s0) * (1 + sin_chi0))
    chi0 = math.asin((c * w1 - 1) / (c * w1 + 1))

    s = F.sin(F.radians(F.col(lat)))
    w = F.lit(c) * F.pow(ratio(1 + s, 1 - s) * F.pow((1 - e * s) / (1 + e * s), F.lit(e)), F.lit(n))
    chi = F.asin((w - 1) / (w + 1))
    shift = F.lit(n) * (F.radians(F.col(lon)) - F.lit(lam0))
    b = 1 + F.sin(chi) * math.sin(chi0) + F.cos(chi) * math.cos(chi0) * F.cos(shift)
    scale = 2 * radius * params.k0
    east = params.false_easting + scale * F.cos(chi) * F.sin(shift) / b
    north = params.false_northing + scale * (
        F.sin(chi) * math.cos(chi0) - F.cos(chi) * math.sin(chi0) * F.cos(shift)
    ) / b
    return df.withColumns({"easting": east, "northing": north})


def grid_cell(lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    """Key of the cell of 15 minutes of latitude by 30 minutes of longitude."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    row, column = F.floor(lat * 4), F.floor(lon * 2)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws("_", row.cast("string"), column.cast("string")))


def grid_polygons(spark: SparkSession, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Closed rings of the whole grid cells in a box, keyed like :func:`grid_cell`."""
    r0, r1 = math.ceil(lat[0] * 4), math.floor(lat[1] * 4)
    c0, c1 = math.ceil(lon[0] * 2), math.floor(lon[1] * 2)
    width = c1 - c0
    cells = spark.range((r1 - r0) * width).select(
        (F.floor(F.col("id") / width) + r0).alias("r"), (F.col("id") % width + c0).alias("c")
    )

    def corner(dr: int, dc: int) -> Column:
        x = (F.col("c") + dc).cast("double") / F.lit(2.0)
        y = (F.col("r") + dr).cast("double") / F.lit(4.0)
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    key = F.concat_ws("_", F.col("r").cast("string"), F.col("c").cast("string"))
    return cells.select(key.alias("cell"), ring.alias("ring"))


def _edges(ring: str | Column) -> Column:
    """The edges of a closed ring of corners ``x, y``."""
    return F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def _holds(edges: str, px: Column, py: Column) -> Column:
    """Whether an odd number of edges lies to the right of the point."""
    def crossed(count: Column, edge: Column) -> Column:
        spans = (edge["y1"] > py) != (edge["y2"] > py)
        at = ratio((edge["x2"] - edge["x1"]) * (py - edge["y1"]), edge["y2"] - edge["y1"]) + edge["x1"]
        return count + F.when(spans, F.when(px < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(edges, F.lit(0), crossed) % 2 == 1


def point_in_polygon(pts: DataFrame, rings: DataFrame, x: str = "lon", y: str = "lat",
                     tile: tuple[float, float] = (0.5, 0.25)) -> DataFrame:
    """Points with the ``cell`` of each polygon that holds them; points in no polygon are left out.

    Polygons are listed under every tile their bounding box touches, points under their own tile, and the two
    meet on the tile. Only the candidates of one tile are tested, edge by edge, inside the joined row. ``tile``
    should be about the size of a polygon. A point on an edge shared by two rings falls into one of them.
    """
    tx, ty = (F.lit(float(t)) for t in tile)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])

    def tiles(values: Column, size: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.array_min(values) / size), F.floor(F.array_max(values) / size)))

    candidates = (
        rings.select("cell", _edges("ring").alias("__edges"), tiles(xs, tx).alias("__tx"), ys.alias("__ys"))
        .withColumn("__ty", tiles(F.col("__ys"), ty))
        .drop("__ys")
    )
    px, py = F.col(x), F.col(y)
    tiled = pts.withColumns({"__tx": F.floor(px / tx), "__ty": F.floor(py / ty)})
    return tiled.join(candidates, ["__tx", "__ty"]).where(_holds("__edges", px, py)).drop("__tx", "__ty", "__edges")


@dataclass(frozen=True)
class Tiling:
    """First tiles of ``size`` degrees, of which those with much work are quartered, at most ``depth`` times.

    The work of a tile is its number of points times the number of edges that matter in it. A tile is split if that exceeds both
    ``least`` and the ``share``-th part of all work; so fewer than ``share`` tiles are split on each level, whatever the data.
    """

    size: tuple[float, float] = (0.5, 0.25)
    depth: int = 8
    share: int = 1024
    least: int = 4096


def _code(tx: Column, ty: Column) -> Column:
    return F.shiftleft(tx, 32) + ty


def _at_level(value: Column, size: float, level: int | Column) -> Column:
    scale = F.lit(float(1 << level)) if isinstance(level, int) else F.pow(F.lit(2.0), level)
    return F.floor(value / F.lit(float(size)) * scale)


def _relevant(candidates: DataFrame, size: tuple[float, float]) -> DataFrame:
    """Candidates with the edges that a ray from inside their tile to the right can meet; those without one go."""
    scale = F.pow(F.lit(2.0), F.col("__l"))
    # a thousandth of a tile more on each side, so that no rounding can lose an edge
    left = (F.col("__tx") - 0.001) / scale * F.lit(float(size[0]))
    low, high = ((F.col("__ty") + d) / scale * F.lit(float(size[1])) for d in (-0.001, 1.001))
    near = F.filter("__edges", lambda e: (F.greatest(e["x1"], e["x2"]) >= left) & (F.greatest(e["y1"], e["y2"]) >= low) & (
        F.least(e["y1"], e["y2"]) <= high))
    return candidates.withColumn("__edges", near).where(F.size("__edges") > 0)


def _first_tiles(shapes: DataFrame, size: tuple[float, float]) -> DataFrame:
    listed = shapes.select("cell", F.flatten(F.transform("rings", _edges)).alias("__edges"))

    def tiles(axis: str, size: float) -> Column:
        # every corner begins an edge, since the rings are closed
        values = F.transform("__edges", lambda e: e[f"{axis}1"])
        return F.explode(F.sequence(F.floor(F.array_min(values) / size), F.floor(F.array_max(values) / size)))

    placed = listed.withColumn("__tx", tiles("x", size[0])).withColumn("__ty", tiles("y", size[1]))
    return _relevant(placed.withColumn("__l", F.lit(0)), size)


def _quartered(candidates: DataFrame, level: int, codes: Sequence[int], size: tuple[float, float]) -> DataFrame:
    """The candidates of the listed tiles of one level move to the four tiles below; the others stay."""
    def child(dx: int, dy: int) -> Column:
        return F.struct(F.lit(level + 1).alias("__l"), (F.col("__tx") * 2 + dx).alias("__tx"), (F.col("__ty") * 2 + dy).alias("__ty"))

    split = (F.col("__l") == level) & _code(F.col("__tx"), F.col("__ty")).isin(*codes)
    own = F.array(F.struct("__l", "__tx", "__ty"))
    below = F.array(*[child(dx, dy) for dx in (0, 1) for dy in (0, 1)])
    moved = candidates.select("cell", "__edges", F.explode(F.when(split, below).otherwise(own)).alias("__t"))
    return _relevant(moved.select("cell", "__edges", "__t.*"), size)


def split_tiles(pts: DataFrame, shapes: DataFrame, x: str = "lon", y: str = "lat", tiling: Tiling = Tiling()) -> list[list[int]]:
    """Which tiles of each level are split, from measured numbers of points and edges.

    The points are counted once, on the finest tiles; the levels are summed from there, one small job each.
    """
    (sx, sy), depth = tiling.size, tiling.depth
    finest = pts.groupBy(_at_level(F.col(x), sx, depth).alias("fx"), _at_level(F.col(y), sy, depth).alias("fy")).agg(
        F.count(F.lit(1)).alias("n"))
    splits: list[list[int]] = []
    with Scratch(pts.sparkSession) as scratch:
        counted = scratch.keep(finest.where(F.col("fx").isNotNull() & F.col("fy").isNotNull()), "points")
        candidates, budget = _first_tiles(shapes, tiling.size), None
        for level in range(depth):
            points_here = counted.groupBy(F.shiftright("fx", depth - level).alias("__tx"), F.shiftright("fy", depth - level).alias("__ty")).agg(
                F.sum("n").alias("n"))
            edges_here = candidates.where(F.col("__l") == level).groupBy("__tx", "__ty").agg(F.sum(F.size("__edges")).alias("e"))
            work = points_here.join(edges_here, ["__tx", "__ty"]).select(
                _code(F.col("__tx"), F.col("__ty")).alias("code"), (F.col("n").cast("double") * F.col("e")).alias("w"))
            if budget is None:
                budget = max(float(tiling.least), (work.agg(F.sum("w")).first()[0] or 0.0) / tiling.share)
            codes = sorted(r["code"] for r in work.where(F.col("w") > budget).select("code").collect())
            if not codes:
                break
            splits.append(codes)
            candidates = _quartered(candidates, level, codes, tiling.size)
    return splits


def point_in_shape(pts: DataFrame, shapes: DataFrame, x: str = "lon", y: str = "lat", tiling: Tiling = Tiling()) -> DataFrame:
    """Points with the ``cell`` of each shape that holds them, on tiles that adapt to points and edges.

    ``shapes`` has ``cell`` and ``rings``, the closed rings of all parts and holes in any order and direction: a point is
    inside if an odd number of rings goes around it. A shape is listed under the tiles that it touches, there with the
    edges that matter, so a point never meets the whole outline. Points without coordinates, and in no shape, are left out; repeated
    points stay, a null or empty list of rings holds nothing. A point on a shared edge falls into one of the shapes.
    """
    splits = split_tiles(pts, shapes, x, y, tiling)
    (sx, sy), px, py = tiling.size, F.col(x), F.col(y)
    candidates, level = _first_tiles(shapes, tiling.size), F.lit(len(splits))
    for k, codes in enumerate(splits):
        candidates = _quartered(candidates, k, codes, tiling.size)
    for k, codes in reversed(list(enumerate(splits))):
        level = F.when(~_code(_at_level(px, sx, k), _at_level(py, sy, k)).isin(*codes), k).otherwise(level)
    placed = pts.withColumn("__l", level).withColumns({
        "__tx": _at_level(px, sx, F.col("__l")), "__ty": _at_level(py, sy, F.col("__l"))})
    found = placed.join(candidates, ["__l", "__tx", "__ty"]).where(_holds("__edges", px, py))
    return found.drop("__l", "__tx", "__ty", "__edges")


def route_cells(df: DataFrame, rings: DataFrame | None = None, event: str = S.EVENT, route: str = S.ROUTE,
                lat: str = S.LAT, lon: str = S.LON) -> DataFrame:
    """Location of each route's first stop and the cell that holds it.

    With ``rings`` the cell comes from the polygons (null outside them), otherwise from grid arithmetic.
    """
    places = route_location(first_stop(df, event), route, lat, lon)
    if rings is None:
        return places.withColumn("cell", grid_cell(lat, lon))
    found = point_in_polygon(places, rings, lon, lat).select(route, "cell").distinct()
    return null_safe_join(places, found, [route])
