"""Isotherms as lines: the segments of mesh cells, chained from cell to cell."""

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde.operators.surface import isotherms
from skysonde.sources.storage import materialized

_CHAINED = "level int, line long, position int, closed boolean, node long"


def _node(i: Column, j: Column, edge: str) -> Column:
    """Number of a mesh edge; the mesh has far fewer than a million rows."""
    return (i.cast("long") * 1_000_000 + j) * 2 + (1 if edge == "altitude" else 0)


def _cells(surface: DataFrame) -> DataFrame:
    """Cells whose four corners have values: the first corner's, and their mean."""
    along_time, along_altitude = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")
    right = surface.select("i", "j", "value", F.lead("value").over(along_time).alias("_right"))
    corners = right.select(
        "i", "j", "value", "_right",
        F.lead("value").over(along_altitude).alias("_above"), F.lead("_right").over(along_altitude).alias("_across"),
    )
    mean = (F.col("value") + F.col("_right") + F.col("_above") + F.col("_across")) / 4
    return corners.select("i", "j", F.col("value").alias("corner"), mean.alias("mean")).where("mean IS NOT NULL AND corner IS NOT NULL")


def segments(surface: DataFrame, limited: bool = False, step: int | None = None) -> DataFrame:
    """(level, p, q): each piece of an isotherm in one cell, by the numbers of the edges it joins.

    A cell has two crossed edges or, where opposite corners are alike, four: then the mean
    of its corners tells which two belong together.  Cells with a corner of no value have none.
    """
    i, j = F.col("i"), F.col("j")

    def side(di: int, dj: int, name: str) -> Column:
        return F.struct((i - di).alias("i"), (j - dj).alias("j"), F.lit(name).alias("side"))

    place = F.when(F.col("edge") == "time", F.array(side(0, 0, "bottom"), side(0, 1, "top")))
    place = place.otherwise(F.array(side(0, 0, "left"), side(1, 0, "right")))
    met = isotherms(surface, limited, step).select("level", F.inline(place)).groupBy("level", "i", "j").agg(F.collect_set("side").alias("sides"))
    crossed = met.join(_cells(surface), ["i", "j"])
    at = {"bottom": _node(i, j, "time"), "top": _node(i, j + 1, "time"), "left": _node(i, j, "altitude"), "right": _node(i + 1, j, "altitude")}

    def pair(a: str, b: str) -> Column:
        return F.struct(F.least(at[a], at[b]).alias("p"), F.greatest(at[a], at[b]).alias("q"))

    alike = (F.col("mean") > F.col("level")) == (F.col("corner") > F.col("level"))
    saddle = F.when(alike, F.array(pair("bottom", "right"), pair("left", "top"))).otherwise(F.array(pair("bottom", "left"), pair("top", "right")))
    ends = [F.when(F.array_contains("sides", name), node) for name, node in at.items()]
    low, high = F.array_min(F.array(*ends)), F.array_max(F.array(*ends))
    plain = F.array(F.struct(low.alias("p"), high.alias("q")))
    return crossed.select("level", F.inline(F.when(F.size("sides") == 4, saddle).otherwise(plain)))


def chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lines of one level: an open one from its end of the lower number, a closed one from its
    lowest number towards the lower neighbour."""
    beside = defaultdict(list)
    for p, q in zip(pdf["p"].tolist(), pdf["q"].tolist()):
        beside[p].append(q)
        beside[q].append(p)
    out, seen = [], set()
    ends = sorted(n for n, near in beside.items() if len(near) == 1)
    for start in ends + sorted(beside):
        if start in seen:
            continue
        closed, line, before, at = len(beside[start]) == 2, [start], start, min(beside[start])
        while at != start:
            line.append(at)
            following = [n for n in beside[at] if n != before]
            if not following:
                break
            before, at = at, following[0]
        seen.update(line)
        out += [(int(pdf["level"].iat[0]), start, k, closed, node) for k, node in enumerate(line)]
    return pd.DataFrame(out, columns=["level", "line", "position", "closed", "node"])


def contour_lines(surface: DataFrame, limited: bool = False, step: int | None = None) -> DataFrame:
    """Points of every isotherm in order: level, line, position, closed, cross_day, cross_altitude.

    Segments of a level are chained in one group: the mesh bounds their number, however many
    observations the surface was made of.
    """
    surface = materialized(surface, "surface")  # read for crossings, cells and points
    lines = segments(surface, limited, step).groupBy("level").applyInPandas(chained, _CHAINED)
    i, j = F.col("i"), F.col("j")
    node = F.when(F.col("edge") == "time", _node(i, j, "time")).otherwise(_node(i, j, "altitude"))
    points = isotherms(surface, limited, step).select("level", node.alias("node"), "cross_day", "cross_altitude")
    return lines.join(points, ["level", "node"]).select("level", "line", "position", "closed", "cross_day", "cross_altitude")
