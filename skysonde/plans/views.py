"""The ten named views, as data.

Times are on the local wall clock.  A view of fewer than ten rows has none.

Each view is a function of a `Request` that returns the DataFrame a chart of that
name is drawn from.  `VIEWS` maps names to functions and is the place to add one.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.timebins import epoch_days, wall_clock
from skysonde.operators import profile, series, surface, winds
from skysonde.operators.fetch import detail_level, fetch_measures, grid_or_raw
from skysonde.operators.filters import (
    band_rows,
    enough_rows,
    finite_rows,
    tail_rows,
    windy_rows,
)


@dataclass(frozen=True)
class Request:
    """Period and tables of a view; `grids` maps grid names to their tables."""

    observations: DataFrame
    start: datetime
    end: datetime
    grids: dict[str, DataFrame] = field(default_factory=dict)
    limited: bool = False
    distance_km: float = S.DISTANCE_LIMIT_KM
    row_limit: int | None = None

    @property
    def period(self) -> timedelta:
        return self.end - self.start

    @property
    def max_altitude(self) -> float | None:
        return S.ALTITUDE_LIMITED_M if self.limited else None


def _instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _local(value: datetime) -> Column:
    return wall_clock(_instant(value))


def measures(request: Request, wind: bool = False, extend: float = 0.0) -> DataFrame:
    """Rows of the requested period, on the local clock, from the table that suits its length.

    The level of detail follows the requested period; `extend` widens the read on
    both sides afterwards by that share of the period.
    """
    margin = request.period * extend
    start, end = _instant(request.start - margin), _instant(request.end + margin)
    level = detail_level(request.period)
    if level == "raw":
        rows = fetch_measures(
            request.observations,
            start,
            end,
            request.distance_km,
            request.max_altitude,
            wind,
            request.row_limit,
        )
    else:
        rows = grid_or_raw(
            request.grids.get(level), request.observations, start, end, request.max_altitude, wind
        )
    return enough_rows(finite_rows(rows)).withColumn("time", wall_clock(F.col("time")))


def scatter_2d(request: Request) -> DataFrame:
    return measures(request)


def scatter_3d(request: Request) -> DataFrame:
    return measures(request).select(
        epoch_days(F.col("time")).alias("day_number"), "altitude", "temperature"
    )


def density(request: Request) -> DataFrame:
    return measures(request).select("altitude", "temperature")


def _surface(request: Request, nodes: int, extend: float) -> DataFrame:
    rows = measures(request, extend=extend)
    period = (_local(request.start), _local(request.end)) if extend else (None, None)
    extent = surface.mesh_extent(rows, *period)
    return surface.temperature_surface(rows, extent, nodes=nodes, limited=request.limited)


def heatmap(request: Request) -> DataFrame:
    return _surface(request, S.MESH_NODES, S.RANGE_EXTENSION)


def contour_2d(request: Request) -> DataFrame:
    return surface.isotherms(heatmap(request), request.limited)


def contour_3d(request: Request) -> DataFrame:
    mesh = _surface(request, S.MESH_NODES_3D, 0.0)
    return surface.isotherms(mesh, request.limited, step=S.ISOTHERM_RANGE[2])


def temperature(request: Request) -> DataFrame:
    return series.anchored_bins(
        band_rows(measures(request), request.limited), "band", "temperature"
    )


def wind_direction(request: Request) -> DataFrame:
    rows = windy_rows(measures(request, wind=True), request.limited)
    return winds.unit_arrows(winds.wind_field(rows, request.limited))


def _tail(request: Request, wind: bool = False) -> DataFrame:
    """The last hours of the request, read as a short period of their own."""
    hours = timedelta(hours=S.PROFILE_WINDOW_H)
    short = Request(
        request.observations,
        max(request.start, request.end - hours),
        request.end,
        request.grids,
        request.limited,
        request.distance_km,
        request.row_limit,
    )
    return tail_rows(measures(short, wind), _local(short.start), _local(short.end))


def temperature_profile(request: Request) -> DataFrame:
    """Median temperatures per altitude bin, and the standard atmosphere through the lowest."""
    medians = profile.temperature_profile(_tail(request))
    standard = profile.standard_atmosphere(medians, request.limited)
    return medians.select(
        F.lit("median").alias("line"),
        F.col("altitude_centre").alias("altitude"),
        F.col("median_temperature").alias("temperature"),
    ).unionByName(standard.select(F.lit("standard").alias("line"), "altitude", "temperature"))


def hodograph(request: Request) -> DataFrame:
    rows = enough_rows(windy_rows(_tail(request, wind=True), request.limited))
    return profile.hodograph_segments(profile.hodograph(rows))


VIEWS: dict[str, Callable[[Request], DataFrame]] = {
    "scatter_2d": scatter_2d,
    "scatter_3d": scatter_3d,
    "contour_2d": contour_2d,
    "contour_3d": contour_3d,
    "density": density,
    "heatmap": heatmap,
    "temperature": temperature,
    "wind_direction": wind_direction,
    "temperature_profile": temperature_profile,
    "hodograph": hodograph,
}


def view(name: str, request: Request) -> DataFrame:
    """The data of a named view."""
    return VIEWS[name](request)
