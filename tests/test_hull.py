"""The hull as a reduction, and nodes inside of it, against half-planes of all pairs of points."""

import numpy as np
import pytest

from skysonde.operators import surface
from skysonde.operators.hull import _outermost, convex_hull, corners, with_inside
from pyspark.sql import functions as F


def plain(points):
    """Points on an edge that has all others on one side, but for those between two others of a line."""
    points = np.unique(points, axis=0)
    found = set()
    for p in points:
        for q in points:
            if (p == q).all():
                continue
            side = (q[0] - p[0]) * (points[:, 1] - p[1]) - (q[1] - p[1]) * (points[:, 0] - p[0])
            line = points[side == 0] - p
            if (side >= 0).all() and ((line @ (q - p)) >= 0).all() and (line @ (q - p)).max() <= (q - p) @ (q - p):
                found |= {tuple(p), tuple(q)}
    return found


@pytest.mark.parametrize("seed, n, top", [(0, 3, 9), (1, 40, 5), (2, 60, 1000), (3, 12, 2)])
def test_corners_equal_those_of_half_planes(seed, n, top):
    points = np.random.default_rng(seed).integers(0, top, (n, 2)).astype(float)
    assert {tuple(p) for p in corners(points)} == plain(points)


def test_corners_are_never_among_the_points_left_out():
    rng = np.random.default_rng(4)
    for points in (rng.normal(size=(30_000, 2)), rng.random((30_000, 2)) ** 3, np.column_stack((np.zeros(9000), rng.random(9000)))):
        kept = _outermost(points)
        assert len(kept) < len(points) / 2
        assert {tuple(p) for p in corners(kept)} == {tuple(p) for p in corners(points)}


def test_hulls_of_partitions_merge_and_hold_their_points(spark):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(3000, 2)), 3)
    frame = spark.createDataFrame([*map(tuple, points.tolist()), (None, 1.0), (float("nan"), 9e9)], "x double, y double").repartition(7)
    hull = convex_hull(frame)
    got = np.array([(r.x, r.y) for r in hull.collect()])
    assert {tuple(p) for p in got} == {tuple(p) for p in corners(points)}
    ring = corners(points)
    nodes = rng.normal(size=(400, 2)) * 2
    nodes[:20] = ring[:20][: len(nodes[:20])] if len(ring) >= 20 else np.resize(ring, (20, 2))
    steps = np.roll(ring, -1, axis=0) - ring
    expected = [bool(all(s[0] * (p[1] - c[1]) - s[1] * (p[0] - c[0]) >= 0 for c, s in zip(ring, steps))) for p in nodes]
    mesh = spark.createDataFrame([(i, *p) for i, p in enumerate(nodes.tolist())], "i int, a double, b double")
    inside = with_inside(mesh, hull, F.col("a"), F.col("b"))
    assert [r.inside for r in inside.orderBy("i").collect()] == expected and True in expected and False in expected


@pytest.mark.parametrize("rows", [[], [(0.0, 0.0)], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]])
def test_without_three_corners_nothing_is_inside(spark, rows):
    hull = convex_hull(spark.createDataFrame(rows, "x double, y double"))
    mesh = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    assert [r.inside for r in with_inside(mesh, hull, F.col("a"), F.col("b")).collect()] == [False]


def test_a_surface_ends_at_the_hull(spark):
    rows = [(i, float(a), 20 - 0.0065 * a) for i in range(0, 86_400, 600) for a in range(1000, 9001 - i // 12, 500)]
    frame = spark.createDataFrame(rows, "s long, altitude double, temperature double").select(
        (F.timestamp_seconds("s")).cast("timestamp_ntz").alias("time"), "altitude", "temperature"
    )
    got = surface.surface_in_hull(frame, surface.mesh_extent(frame), nodes=20).collect()
    for r in got:
        upper = 9000 - (r.i / 19) * 85_800 / 12
        assert r.inside == (1000 <= r.mesh_altitude <= upper + 1e-6) or abs(r.mesh_altitude - upper) < 500
        assert r.inside or r.value is None
    assert sum(r.value is not None for r in got) > 60
