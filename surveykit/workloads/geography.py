"""Points, projection and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spatial as K
from .registry import query, rounded
from .views import observations, on_obs, table

_SITES = (
    "sites AS (SELECT c_custkey AS site, CAST(44 AS DOUBLE) + CAST(c_custkey % 430 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat,"
    " CAST(-69 AS DOUBLE) + CAST(c_custkey * 7 % 700 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM customer)"
)
_GRID = {"lon": (-69.5, -62.5), "lat": (44.0, 48.25)}
_CELL = (
    "concat(CAST(CAST(floor(lat * 4) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lon * 2) AS BIGINT) AS VARCHAR))"
)
_INSIDE = "lat >= 44.0 AND lat < 48.25 AND lon >= -69.5 AND lon < -62.5"


def sites(spark, sf):
    key = F.col("c_custkey")
    lat = F.lit(44.0) + (key % 430).cast("double") / F.lit(100.0)
    lon = F.lit(-69.0) + (key * 7 % 700).cast("double") / F.lit(100.0)
    return table(spark, sf, "customer").select(key.alias("site"), lat.alias("lat"), lon.alias("lon"))


@query("points", on_obs("SELECT DISTINCT RouteIdentifier, longitude AS lon, latitude AS lat, CAST(4326 AS INT) AS srid FROM obs"))
def points(spark, sf):
    obs = observations(spark, sf, "RouteIdentifier", "longitude", "latitude").distinct()
    return K.points(obs).select("RouteIdentifier", "lon", "lat", "srid")


def _projection_sql() -> str:
    """The projection written out in SQL, with every constant derived from the parameters."""
    p = K.DoubleStereographic()
    f = 1 / p.inverse_flattening
    ee = f * (2 - f)
    ecc = ee**0.5
    lat0, lon0 = math.radians(p.lat0), math.radians(p.lon0)
    big_r = p.a * math.sqrt(1 - ee) / (1 - ee * math.sin(lat0) ** 2)
    n = math.sqrt(1 + ee * math.cos(lat0) ** 4 / (1 - ee))

    def w_of(sin_lat: float) -> float:
        return ((1 + sin_lat) / (1 - sin_lat) * ((1 - ecc * sin_lat) / (1 + ecc * sin_lat)) ** ecc) ** n

    w1 = w_of(math.sin(lat0))
    s1 = (w1 - 1) / (w1 + 1)
    c = (n + math.sin(lat0)) * (1 - s1) / ((n - math.sin(lat0)) * (1 + s1))
    chi0 = math.asin((c * w1 - 1) / (c * w1 + 1))
    w = f"{c!r} * pow((1 + sin(la)) / (1 - sin(la)) * pow((1 - {ecc!r} * sin(la)) / (1 + {ecc!r} * sin(la)), {ecc!r}), {n!r})"
    return (
        f"WITH {_SITES}, a AS (SELECT site, radians(lat) AS la, {n!r} * (radians(lon) - ({lon0!r})) AS dl FROM sites),"
        f" b AS (SELECT site, dl, asin(({w} - 1) / ({w} + 1)) AS chi FROM a),"
        f" d AS (SELECT *, 1 + sin(chi) * {math.sin(chi0)!r} + cos(chi) * {math.cos(chi0)!r} * cos(dl) AS bb FROM b)"
        f" SELECT site, round({p.false_easting!r} + {2 * big_r * p.k0!r} * cos(chi) * sin(dl) / bb, 3) AS easting,"
        f" round({p.false_northing!r} + {2 * big_r * p.k0!r} * (sin(chi) * {math.cos(chi0)!r} - cos(chi) *"
        f" {math.sin(chi0)!r} * cos(dl)) / bb, 3) AS northing FROM d"
    )


@query("project_points", _projection_sql())
def project_points(spark, sf):
    return rounded(K.project_points(sites(spark, sf)), "easting", "northing", digits=3).drop("lat", "lon")


@query("point_in_polygon", f"WITH {_SITES} SELECT site, {_CELL} AS cell FROM sites WHERE {_INSIDE}")
def point_in_polygon(spark, sf):
    rings = K.grid_polygons(spark, **_GRID)
    return K.point_in_polygon(sites(spark, sf), rings).select("site", "cell")


#: Shares of a box's sides: the outline, the hole in it, and an island in the hole.
_FRAMES = ((0.0, 1.0), (0.25, 0.75), (0.4, 0.6))


def _framed(k: int) -> str:
    lo, hi = (repr(v) + "::DOUBLE" for v in _FRAMES[k])
    return " AND ".join(f"{v} >= {v}1 + ({v}2 - {v}1) * {lo} AND {v} < {v}1 + ({v}2 - {v}1) * {hi}" for v in ("lon", "lat"))


@query("point_in_shape", (
    f"WITH {_SITES}, boxes AS (SELECT c_nationkey AS cell, min(lon) AS lon1, max(lon) AS lon2, min(lat) AS lat1, max(lat) AS lat2"
    " FROM sites JOIN customer ON site = c_custkey GROUP BY ALL) SELECT site, CAST(cell AS INT) AS cell FROM sites JOIN boxes ON "
    f"{_framed(0)} WHERE NOT ({_framed(1)}) OR ({_framed(2)})"
))
def point_in_shape(spark, sf):
    """Which nations' frames hold a site: the box around a nation's own sites, with a hole and an island in it."""
    homes = table(spark, sf, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").cast("int").alias("cell"))
    boxes = sites(spark, sf).join(homes, "site").groupBy("cell").agg(
        F.min("lon").alias("x1"), F.max("lon").alias("x2"), F.min("lat").alias("y1"), F.max("lat").alias("y2"))

    def ring(lo: float, hi: float):
        def at(axis: str, share: float):
            return F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) * F.lit(share)

        corners = ((lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo))
        return F.array(*[F.struct(at("x", a).alias("x"), at("y", b).alias("y")) for a, b in corners])

    shapes = boxes.select("cell", F.array(*[ring(*frame) for frame in _FRAMES]).alias("rings"))
    return K.point_in_shape(sites(spark, sf), shapes).select("site", "cell")


@query("grid_cell", f"WITH {_SITES} SELECT site, {_CELL} AS cell FROM sites")
def grid_cell(spark, sf):
    return sites(spark, sf).select("site", K.grid_cell("lat", "lon").alias("cell"))


_PLACES = (
    "first_stops AS (SELECT RouteIdentifier, latitude, longitude FROM obs WHERE string_split(SamplingEventIdentifier, '-')[3]"
    " = '1')",
    "places AS (SELECT RouteIdentifier, latitude, max(longitude) AS longitude FROM first_stops JOIN (SELECT RouteIdentifier,"
    " max(latitude) AS latitude FROM first_stops GROUP BY ALL) USING (RouteIdentifier, latitude) GROUP BY ALL)",
)
_PLACE_COLS = ("SamplingEventIdentifier", "RouteIdentifier", "latitude", "longitude")
_PLACE_CELL = _CELL.replace("lat *", "latitude *").replace("lon *", "longitude *")


@query("route_cells", on_obs(f"SELECT *, {_PLACE_CELL} AS cell FROM places", *_PLACES))
def route_cells(spark, sf):
    return K.route_cells(observations(spark, sf, *_PLACE_COLS))


@query("route_cells_polygons", on_obs(
    f"SELECT *, CASE WHEN {_INSIDE.replace('lat ', 'latitude ').replace('lon ', 'longitude ')} THEN {_PLACE_CELL} END AS cell"
    " FROM places",
    *_PLACES,
))
def route_cells_polygons(spark, sf):
    return K.route_cells(observations(spark, sf, *_PLACE_COLS), K.grid_polygons(spark, **_GRID))
