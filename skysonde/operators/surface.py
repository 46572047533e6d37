"""Regular meshes over time and altitude, a temperature surface, and isotherms.

The surface is a local plane fit.  It reproduces a field that is linear in time
and altitude exactly, as linear interpolation on triangles does, and it needs
nothing but sums, so any number of observations is reduced before the shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.staging import computed_once
from skysonde.functions.timebins import micros
from skysonde.operators.hull import convex_hull, with_inside
from skysonde.sources.storage import materialized

# Nodes within this many mesh steps share their observations with a node.
REACH = 2
# Points that (nearly) lie on a line, in mesh steps, have no plane.
SINGULAR = 1e-2
# A node this far from its points, in squared deviations, lies outside their support.
SUPPORT = 8.0


def altitude_nodes(nodes: int, limited: bool) -> int:
    if limited:
        return int(S.ALTITUDE_LIMITED_M / S.MESH_ALTITUDE_STEP_LIMITED_M) + 1
    return nodes


def mesh_extent(
    rows: DataFrame, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """One row: first and last instant of the mesh in microseconds.

    A requested period is cut to the data it holds.
    """
    t = micros(F.col("time"))
    first, last = F.min(t), F.max(t)
    return rows.agg(
        (first if start is None else F.greatest(first, micros(start))).alias("first"),
        (last if end is None else F.least(last, micros(end))).alias("last"),
    )


def _bounds(extent: DataFrame) -> Column:
    """The extent as one value.  Equal subqueries of a plan run once, so cells and mesh
    share it."""
    return extent.select(F.struct("first", "last")).scalar()


def regular_mesh(extent: DataFrame, nodes: int = S.MESH_NODES, limited: bool = False) -> DataFrame:
    """All mesh nodes: i over time, j over altitude."""
    count = altitude_nodes(nodes, limited)
    top = S.ALTITUDE_LIMITED_M if limited else S.ALTITUDE_MAX_M
    one = computed_once(extent.sparkSession.range(1), _e=_bounds(extent))
    return (
        one.select("_e.*", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j"))
        .select(
            "i",
            "j",
            (
                (F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / F.lit(nodes - 1))
                / F.lit(86_400e6)
            ).alias("mesh_day"),
            (F.col("j") * F.lit(top / (count - 1))).alias("mesh_altitude"),
        )
    )


def _cell_sums(
    rows: DataFrame, extent: DataFrame, value: str, nodes: int, limited: bool
) -> DataFrame:
    """Sums of the observations nearest to each node, about that node."""
    count = altitude_nodes(nodes, limited)
    top = S.ALTITUDE_LIMITED_M if limited else S.ALTITUDE_MAX_M
    t = micros(F.col("time"))
    placed = (
        computed_once(rows, _e=_bounds(extent))
        .where((t >= F.col("_e.first")) & (t <= F.col("_e.last")))
        .where(F.col("altitude").between(0.0, top) & F.col(value).isNotNull())
        .select(
            (
                (t - F.col("_e.first"))
                * F.lit(float(nodes - 1))
                / F.nullif(F.col("_e.last") - F.col("_e.first"), F.lit(0))
            ).alias("_u"),
            (F.col("altitude") / F.lit(top / (count - 1))).alias("_v"),
            F.col(value).alias("_z"),
        )
        .where(F.col("_u").isNotNull())
        .withColumns({"_i": F.floor(F.col("_u") + 0.5), "_j": F.floor(F.col("_v") + 0.5)})
    )
    du, dv, z = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j"), F.col("_z")
    return placed.groupBy("_i", "_j").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(du).alias("u"),
        F.sum(dv).alias("v"),
        F.sum(z).alias("z"),
        F.sum(du * du).alias("uu"),
        F.sum(dv * dv).alias("vv"),
        F.sum(du * dv).alias("uv"),
        F.sum(du * z).alias("uz"),
        F.sum(dv * z).alias("vz"),
    )


def temperature_surface(
    rows: DataFrame,
    extent: DataFrame,
    value: str = "temperature",
    nodes: int = S.MESH_NODES,
    limited: bool = False,
    reach: int = REACH,
) -> DataFrame:
    """Mesh nodes with the value of the plane fitted around them, NULL where none fits.

    Observations are summed per node cell once; the few thousand cells, not the
    observations, are then shared with the nodes in reach, their sums moved to
    each node's own origin.
    """
    count = altitude_nodes(nodes, limited)
    cells = _cell_sums(rows, extent, value, nodes, limited)
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    shared = (
        cells.withColumn("_p", F.explode(offsets))
        .withColumn("_q", F.explode(offsets))
        .withColumns(
            {
                "i": (F.col("_i") - F.col("_p")).cast("int"),
                "j": (F.col("_j") - F.col("_q")).cast("int"),
            }
        )
        .where(F.col("i").between(0, nodes - 1) & F.col("j").between(0, count - 1))
    )
    p, q = F.col("_p"), F.col("_q")
    n, u, v, z = (F.col(c) for c in ("n", "u", "v", "z"))
    moved = shared.select(
        "i",
        "j",
        n,
        (u + n * p).alias("u"),
        (v + n * q).alias("v"),
        z,
        (F.col("uu") + 2 * p * u + n * p * p).alias("uu"),
        (F.col("vv") + 2 * q * v + n * q * q).alias("vv"),
        (F.col("uv") + p * v + q * u + n * p * q).alias("uv"),
        (F.col("uz") + p * z).alias("uz"),
        (F.col("vz") + q * z).alias("vz"),
    )
    names = ("n", "u", "v", "z", "uu", "vv", "uv", "uz", "vz")
    sums = moved.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    # Means and central moments, then the plane's slopes and its value at the node.
    mu, mv, mz = F.col("u") / F.col("n"), F.col("v") / F.col("n"), F.col("z") / F.col("n")
    cuu = F.col("uu") / F.col("n") - mu * mu
    cvv = F.col("vv") / F.col("n") - mv * mv
    cuv = F.col("uv") / F.col("n") - mu * mv
    cuz = F.col("uz") / F.col("n") - mu * mz
    cvz = F.col("vz") / F.col("n") - mv * mz
    det = cuu * cvv - cuv * cuv
    slope_u = (cuz * cvv - cvz * cuv) / det
    slope_v = (cvz * cuu - cuz * cuv) / det
    distance = (mu * mu * cvv - 2 * mu * mv * cuv + mv * mv * cuu) / det
    solid = (F.col("n") >= 3) & (det > F.lit(SINGULAR))
    fitted = sums.select(
        "i",
        "j",
        F.when(
            solid & F.when(solid, distance <= SUPPORT), mz - slope_u * mu - slope_v * mv
        ).alias("value"),
    )
    return regular_mesh(extent, nodes, limited).join(fitted, ["i", "j"], "left")


def surface_in_hull(
    rows: DataFrame,
    extent: DataFrame,
    value: str = "temperature",
    nodes: int = S.MESH_NODES,
    limited: bool = False,
) -> DataFrame:
    """As `temperature_surface`, but NULL outside the convex hull of the observations, and everywhere
    when fewer than three of them, or only such on a line, have a hull."""
    top = S.ALTITUDE_LIMITED_M if limited else S.ALTITUDE_MAX_M
    t = micros(F.col("time"))
    within = computed_once(rows, _e=_bounds(extent)).where((t >= F.col("_e.first")) & (t <= F.col("_e.last")))
    points = within.where(F.col("altitude").between(0.0, top) & F.col(value).isNotNull()).select(
        (t / F.lit(86_400e6)).alias("x"), F.col("altitude").alias("y")
    )
    surface = temperature_surface(rows, extent, value, nodes, limited)
    hull = materialized(convex_hull(points), "hull")  # a few corners, read twice
    held = with_inside(surface, hull, F.col("mesh_day"), F.col("mesh_altitude"))
    return held.withColumn("value", F.when(F.col("inside"), F.col("value")))


def isotherms(surface: DataFrame, limited: bool = False, step: int | None = None) -> DataFrame:
    """Where each temperature level crosses a mesh edge, by linear interpolation.

    An edge is followed from its lower to its higher end, and a level equal to the
    lower end counts, one equal to the higher end does not.
    """
    low, high, default = S.ISOTHERM_RANGE_LIMITED if limited else S.ISOTHERM_RANGE
    by = default if step is None else step
    along_time = Window.partitionBy("j").orderBy("i")
    along_altitude = Window.partitionBy("i").orderBy("j")

    # Both directions come from one reading of the surface.
    here = F.struct("mesh_day", "mesh_altitude", "value")
    ends = surface.select(
        "i",
        "j",
        here.alias("a"),
        F.lead(here).over(along_time).alias("_later"),
        F.lead(here).over(along_altitude).alias("_higher"),
    )
    both = ends.select(
        "i",
        "j",
        "a",
        F.inline(
            F.array(
                F.struct(F.lit("time").alias("edge"), F.col("_later").alias("b")),
                F.struct(F.lit("altitude").alias("edge"), F.col("_higher").alias("b")),
            )
        ),
    )
    va, vb = F.col("a.value"), F.col("b.value")
    bottom, top = F.least(va, vb), F.greatest(va, vb)
    first = F.greatest(F.ceil(bottom / by), F.lit(low // by).cast("long"))
    last = F.least(F.ceil(top / by) - 1, F.lit(high // by).cast("long"))
    crossed = (
        both.where(va.isNotNull() & vb.isNotNull() & (va != vb))
        .withColumns({"_first": first, "_last": last})
        .where(F.col("_first") <= F.col("_last"))
        .withColumn("level", F.explode(F.sequence(F.col("_first") * by, F.col("_last") * by, F.lit(by).cast("long"))))
    )
    share = (F.col("level") - va) / (vb - va)

    def between(field: str) -> Column:
        return F.col(f"a.{field}") + share * (F.col(f"b.{field}") - F.col(f"a.{field}"))

    return crossed.select(
        "i",
        "j",
        "edge",
        F.col("level").cast("int").alias("level"),
        between("mesh_day").alias("cross_day"),
        between("mesh_altitude").alias("cross_altitude"),
    )
