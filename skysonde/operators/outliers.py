"""Outliers against the altitude-temperature relation of a history."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.operators.filters import drop_absurd_temperature
from skysonde.operators.ranges import numbered, with_latest
from skysonde.operators.topn import time_limited
from skysonde.sources.storage import materialized

# Runs are taken over slices of this many times k rows.
SLICE_FACTOR = 10


def usable_history(observations: DataFrame, distance_km: float | None = None) -> DataFrame:
    """Rows with altitude and a sane temperature: what a history is made of."""
    rows = observations.where(
        F.col("altitude").isNotNull() & (F.col("temperature") > S.TEMPERATURE_FLOOR_C)
    )
    return rows if distance_km is None else rows.where(F.col("distance") <= distance_km)


def latest_history(
    observations: DataFrame, size: int, distance_km: float | None = None
) -> DataFrame:
    """The latest `size` usable rows, for callers that want a history of so many."""
    return time_limited(usable_history(observations, distance_km), size, latest=True)


def regression(history: DataFrame, least: int = S.HISTORY_MIN) -> DataFrame:
    """One row: straight line of temperature over altitude, NULL below `least` rows."""
    enough = F.count(F.lit(1)) >= least
    return history.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.regr_slope("temperature", "altitude")).alias("slope"),
        F.when(enough, F.regr_intercept("temperature", "altitude")).alias("intercept"),
    )


def neighbour_spans(history: DataFrame, k: int = S.NEIGHBOURS) -> DataFrame:
    """Mean and deviation of the k nearest history rows, for every altitude.

    In altitude order the k nearest rows of any altitude are a run of k rows, and
    the run moves up by one where the altitude passes half-way between the row it
    drops and the row it takes up.  So a history of n rows has n-k+1 runs, each
    valid for a span of altitudes (`above`, `upto`].  On a tie the lower row stays.
    Rows are numbered in altitude order and cut into slices; a slice also gets the
    row before it and the k rows behind it, so that it knows all its runs.
    """
    rows = numbered(history.select("altitude", "obs_id", "temperature"), "altitude", "obs_id")
    width = k * SLICE_FACTOR
    home, place = F.floor((F.col("_at") - 1) / width), (F.col("_at") - 1) % width
    slices = F.array(
        home, F.when(place < k, home - 1), F.when(place == width - 1, home + 1)
    )
    shared = rows.select(
        "*", home.alias("_home"), F.explode(F.filter(slices, lambda s: s.isNotNull())).alias("_slice")
    )
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    runs = _with_runs(shared, k).where(
        (F.col("_slice") == F.col("_home")) & (F.col("_at") <= F.greatest(total - k + 1, F.lit(1)))
    )
    return runs.select(
        F.coalesce("above", F.lit(float("-inf"))).alias("above"),
        F.coalesce("upto", F.lit(float("inf"))).alias("upto"),
        "mean_temperature",
        "std_temperature",
        "neighbours",
    ).where(F.col("above") < F.col("upto"))


def _with_runs(rows: DataFrame, k: int) -> DataFrame:
    """Rows of slices with the statistics of the k rows from each one on, and the span that is theirs.

    Sums over a run are differences of running sums, so that their cost doesn't depend on k.
    They are taken of deviations from the slice's mean; a run without any change has no
    deviation, whatever rounding leaves.
    """
    whole = Window.partitionBy("_slice")
    order = whole.orderBy("_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    to_end = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = F.col("temperature") - F.col("_middle")
    change = F.when(F.col("temperature") != F.lag("temperature").over(order), F.col("_at"))
    centred = rows.withColumns({"_middle": F.avg("temperature").over(whole), "_change": change})
    sums = centred.withColumns(
        {
            "_sum": F.sum(off).over(upto),
            "_squares": F.sum(off * off).over(upto),
            "_changed": F.max("_change").over(upto),
            "_last": F.max("_at").over(whole),
        }
    )

    def over_run(running: str) -> Column:
        end = F.coalesce(F.lead(running, k - 1).over(order), F.last(running).over(to_end))
        return end - F.coalesce(F.lag(running).over(order), F.lit(0.0))

    n = F.least(F.lit(k), F.col("_last") - F.col("_at") + 1)
    ended = F.coalesce(F.lead("_changed", k - 1).over(order), F.last("_changed").over(to_end))
    both = sums.withColumns(
        {
            "_run_sum": over_run("_sum"),
            "_run_squares": over_run("_squares"),
            "_level": F.coalesce(ended <= F.col("_at"), F.lit(True)),
            "neighbours": n.cast("long"),
            "above": (F.lag("altitude").over(order) + F.lead("altitude", k - 1).over(order)) / 2,
            "upto": (F.col("altitude") + F.lead("altitude", k).over(order)) / 2,
        }
    )
    mean = F.col("_run_sum") / F.col("neighbours")
    variance = F.greatest(F.col("_run_squares") / F.col("neighbours") - mean * mean, F.lit(0.0))
    return both.withColumns(
        {
            "mean_temperature": F.col("_middle") + mean,
            "std_temperature": F.when(F.col("_level"), F.lit(0.0)).otherwise(F.sqrt(variance)),
        }
    )


def _with_neighbours(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates with the values of the span that holds their altitude.

    Spans follow each other without gaps, so it is the last one that begins below
    the altitude: both are put into one order, a candidate before a span that
    begins at its own altitude.
    """
    values = ("mean_temperature", "std_temperature", "neighbours")
    left = candidates.select(
        F.struct(*candidates.columns).alias("_row"),
        F.col("altitude").alias("_altitude"),
        F.lit(0).alias("_kind"),
        F.xxhash64(*candidates.columns).alias("_tie"),
    )
    # ranges are drawn from a sample first: the spans are computed once, not for that as well
    right = materialized(spans.select("above", *values), "spans").select(
        F.col("above").alias("_altitude"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tie"),
        F.struct(*values).alias("_span"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    placed = with_latest(both, "_span", "_altitude", "_kind", "_tie").where(F.col("_kind") == 0)
    return placed.select("_row.*", *[F.col(f"_span.{v}").alias(v) for v in values])


def neighbour_statistics(
    candidates: DataFrame, history: DataFrame, k: int = S.NEIGHBOURS
) -> DataFrame:
    """Mean and population deviation of temperature among the k nearest altitudes."""
    return _with_neighbours(candidates, neighbour_spans(history, k))


def outlier_flags(
    batch: DataFrame,
    history: DataFrame,
    k: int = S.NEIGHBOURS,
    deviation_limit: float = S.DEVIATION_LIMIT_C,
    sigma_limit: float = S.SIGMA_LIMIT,
    tolerance: float = S.RESIDUAL_TOLERANCE_C,
    least: int = S.HISTORY_MIN,
) -> DataFrame:
    """Batch with `is_outlier`, judged against a frozen history.

    First stage: close to the regression line is normal.  Second stage: far from
    the mean of the altitude neighbours, in degrees or in deviations, is not; only rows
    that come to it have mean_temperature and std_temperature.
    With too little history everything is normal.  The history does not grow
    while a batch is judged, so verdicts near the limits can differ from judging
    row by row; feed the accepted rows back and repeat to follow the data.
    """
    line = regression(history, least).select(F.struct("slope", "intercept")).scalar()
    judged = drop_absurd_temperature(batch.where(F.col("altitude").isNotNull()))
    judged = judged.withColumn("_line", line).withColumn(
        "residual",
        F.abs(
            F.col("temperature")
            - (F.col("_line.slope") * F.col("altitude") + F.col("_line.intercept"))
        ),
    )
    near_line = F.coalesce(F.col("residual") <= tolerance, F.lit(True))
    # only rows off the line need neighbours; the others aren't put into any order
    suspects = _with_neighbours(judged.where(~near_line), neighbour_spans(history, k))
    scored = suspects.unionByName(judged.where(near_line), allowMissingColumns=True)
    deviation = F.abs(F.col("temperature") - F.col("mean_temperature"))
    z = F.when(F.col("std_temperature") > 0, deviation / F.col("std_temperature")).otherwise(
        F.lit(0.0)
    )
    far = (deviation > deviation_limit) | (z > sigma_limit)
    return scored.withColumn("is_outlier", F.coalesce(far, F.lit(False))).drop("_line", "neighbours")


def without_outliers(
    batch: DataFrame, history: DataFrame, rounds: int = 1, **limits
) -> DataFrame:
    """Accepted rows of a batch; more rounds refit on what the last one accepted."""
    columns = batch.columns
    accepted = batch
    for turn in range(rounds):
        basis = history if turn == 0 else usable_history(accepted)
        accepted = outlier_flags(batch, basis, **limits).where(~F.col("is_outlier")).select(columns)
    return accepted
