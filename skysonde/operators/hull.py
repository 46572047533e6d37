"""Convex hull of any number of points, as a reduction: the hull of hulls is the hull of all."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde.functions.staging import computed_once

#: Tasks that merge the hulls of all partitions before the last one does.
MERGERS = 16


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of points (x, y), counterclockwise from the leftmost lowest, without straight ones.

    Points of one line have two corners, equal points one.
    """
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order: Iterator[np.ndarray]) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in order:
            while len(kept) > 1 and _turn(kept[-2], kept[-1], p) <= 0:
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(iter(points)), chain(iter(points[::-1]))
    return np.array(lower[:-1] + upper[:-1])


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corners of all points of a partition; a batch and the corners before it are held."""
    held = np.zeros((0, 2))
    for frame in frames:
        held = corners(np.concatenate((held, _outermost(frame[["x", "y"]].to_numpy(float)))))
    yield pd.DataFrame({"x": held[:, 0], "y": held[:, 1]})


def _outermost(points: np.ndarray, columns: int = 1024) -> np.ndarray:
    """Points that are lowest or highest in their stretch of x: corners are among them, inner points mostly not.

    At the ends of a stretch a corner may be neither, so its leftmost and rightmost points stay too.
    """
    if len(points) <= 4 * columns:
        return points
    low, high = points[:, 0].min(), points[:, 0].max()
    if low == high:
        return points[[points[:, 1].argmin(), points[:, 1].argmax()]]
    # a point strictly inside the box between the lowest and the highest of its neighbours on
    # both sides is no corner; what remains unclear stays
    stretch = np.minimum(((points[:, 0] - low) / (high - low) * columns).astype(int), columns - 1)
    floor, ceiling = np.full(columns, np.inf), np.full(columns, -np.inf)
    np.minimum.at(floor, stretch, points[:, 1])
    np.maximum.at(ceiling, stretch, points[:, 1])
    inner = np.zeros(len(points), bool)
    middle = (stretch > 0) & (stretch < columns - 1)
    at = stretch[middle]
    under = np.maximum(floor[at - 1], floor[at + 1])
    over = np.minimum(ceiling[at - 1], ceiling[at + 1])
    inner[middle] = (points[middle, 1] > under) & (points[middle, 1] < over)
    return points[~inner]


def convex_hull(points: DataFrame) -> DataFrame:
    """(x, y) of the corners of all points (x, y); rows with a NULL or NaN are left out.

    Each task reduces what it reads, a few merge those hulls, one merges theirs: only
    corners travel.
    """
    finite = points.where(~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = finite.select(F.col("x").cast("double"), F.col("y").cast("double"))
    schema = "x double, y double"
    return rows.mapInPandas(_merged, schema).repartition(MERGERS).mapInPandas(_merged, schema).repartition(1).mapInPandas(_merged, schema)


def with_inside(nodes: DataFrame, hull: DataFrame, x: Column, y: Column, name: str = "inside") -> DataFrame:
    """Nodes with whether they lie in a hull or on its edge; without three corners none does."""
    middle = hull.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(F.struct("x", "y")).scalar()
    angle = F.atan2(F.col("y") - F.col("_m.y"), F.col("x") - F.col("_m.x"))
    around = computed_once(hull, _m=middle).select(F.struct(angle.alias("angle"), "x", "y").alias("corner"))
    ring = around.agg(F.sort_array(F.collect_list("corner")).alias("ring")).scalar()
    n = F.size("_ring")
    following = F.concat(F.slice("_ring", 2, F.greatest(n - 1, F.lit(0))), F.slice("_ring", 1, 1))
    left = F.zip_with(
        "_ring", following, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0
    )
    inside = (n >= 3) & F.forall(left, lambda side: side)
    return computed_once(nodes, _ring=ring).withColumn(name, F.coalesce(inside, F.lit(False))).drop("_ring")
