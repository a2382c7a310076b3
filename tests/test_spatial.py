from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import spatial as K


def test_published_example(spark):
    rd = K.DoubleStereographic(6377397.155, 299.1528128, 52 + 9 / 60 + 22.178 / 3600, 5 + 23 / 60 + 15.5 / 3600, 0.9999079,
                               155000.0, 463000.0)
    r = K.project_points(spark.createDataFrame([(6.0, 53.0)], "lon double, lat double"), params=rd).collect()[0]
    assert (r.easting, r.northing) == (pytest.approx(196105.283, abs=0.01), pytest.approx(557057.739, abs=0.01))


def test_default_projection(spark):
    df = spark.createDataFrame([(-66.5, 46.5), (-65.0, 46.0)], "lon double, lat double")
    out = [(r.easting, r.northing) for r in K.project_points(df).collect()]
    assert out[0] == (pytest.approx(2_500_000, abs=1e-3), pytest.approx(7_500_000, abs=1e-3))
    assert out[1] == (pytest.approx(2616183.186, abs=1e-2), pytest.approx(7445525.108, abs=1e-2))


def test_swapped_coordinates_fail(spark):
    df = spark.createDataFrame([(46.0, -166.0), (None, 1.0)], "longitude double, latitude double")
    with pytest.raises(Exception, match="swapped"):
        K.points(df).collect()
    ok = spark.createDataFrame([(-66.0, 46.0), (None, 1.0)], "longitude double, latitude double")
    assert [tuple(r) for r in K.points(ok).collect()] == [(-66.0, 46.0, 4326)]


def inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_irregular_polygons(spark):
    shapes = {
        "concave": [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)],
        "triangle": [(5, 0), (9, 3), (5, 6), (5, 0)],
        "overlap": [(3, -1), (6, -1), (6, 2), (3, 2), (3, -1)],
    }
    rings = spark.createDataFrame(
        [(k, [(float(x), float(y)) for x, y in v]) for k, v in shapes.items()], "cell string, ring array<struct<x:double,y:double>>"
    )
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-2, -2], [10, 7], (400, 2)))]
    out = K.point_in_polygon(spark.createDataFrame(pts, "id int, lon double, lat double"), rings, tile=(0.7, 1.3))
    want = sorted((i, k) for i, x, y in pts for k, ring in shapes.items() if inside(x, y, ring))
    assert sorted((r.id, r.cell) for r in out.collect()) == want


def test_grid_polygons_agree_with_arithmetic(spark):
    df = spark.range(5000).select(
        (F.lit(-69.4) + (F.col("id") * 7919 % 5000) * 0.0013).alias("lon"), (F.lit(44.1) + F.col("id") * 0.0008).alias("lat"))
    rings = K.grid_polygons(spark, (-69.5, -62.5), (44.0, 48.25))
    out = K.point_in_polygon(df, rings)
    assert out.count() == df.where("lon < -62.5 and lat < 48.25").count()
    assert out.where(F.col("cell") != K.grid_cell("lat", "lon")).count() == 0


def test_routes_outside_the_grid_have_no_cell(spark):
    df = spark.createDataFrame([("a-b-1", "in", 46.1, -66.2), ("a-b-1", "out", 46.1, -10.0), ("a-b-2", "in", 47.9, -66.2)],
                               "SamplingEventIdentifier string, RouteIdentifier string, latitude double, longitude double")
    rings = K.grid_polygons(spark, (-69.5, -62.5), (44.0, 48.25))
    out = {r.RouteIdentifier: (r.latitude, r.cell) for r in K.route_cells(df, rings).collect()}
    assert out == {"in": (46.1, "184_-133"), "out": (46.1, None)}


def star(rng, x, y, size, corners):
    """A closed ring around a point, not convex."""
    angles = np.sort(rng.uniform(0, 2 * np.pi, corners))
    far = size * rng.uniform(0.3, 1.0, corners)
    ring = [(float(x + f * np.cos(a)), float(y + f * np.sin(a))) for a, f in zip(angles, far)]
    return [*ring, ring[0]]


def test_shapes_with_holes_and_parts(spark):
    rng = np.random.default_rng(5)
    shapes = {k: [star(rng, *rng.uniform(-3, 3, 2), rng.uniform(0.2, 3), 40) for _ in range(rng.integers(1, 4))] for k in range(12)}
    shapes[50] = [[(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0), (-2.0, -2.0)], [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)]]
    spread = rng.uniform(-4, 4, (1500, 2))
    dense = rng.uniform(0.01, 0.02, (4000, 2))  # all in one tile, and there in one corner of it
    points = [(i, float(a), float(b), "kept") for i, (a, b) in enumerate(np.vstack([spread, dense]))] + [(-1, None, 1.0, "x"), (7, 0.0, 1.5, "again")]
    pts = spark.createDataFrame(points, "id int, lon double, lat double, cell_name string")
    kinds = "cell int, rings array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([*shapes.items(), (60, None), (61, []), (62, [[]])], kinds)
    want = sorted((i, k) for i, x, y, _ in points if x is not None for k, rings in shapes.items()
                  if sum(inside(x, y, ring) for ring in rings) % 2)
    for tiling in (K.Tiling(), K.Tiling(share=32, least=100), K.Tiling(depth=1, least=10)):
        assert sorted((r.id, r.cell) for r in K.point_in_shape(pts, df, tiling=tiling).collect()) == want
    assert set(K.point_in_shape(pts, df).columns) == {"id", "lon", "lat", "cell_name", "cell"}
    deep, flat = K.split_tiles(pts, df, tiling=K.Tiling(share=32, least=100)), K.split_tiles(pts.where("id < 1500"), df, tiling=K.Tiling(least=10**9))
    assert flat == [] and len(deep) >= 4 and 0 in deep[0] and all(len(codes) < 32 for codes in deep)
    assert K.point_in_shape(pts.limit(0), df).count() == 0 and K.point_in_shape(pts, df.limit(0)).count() == 0
