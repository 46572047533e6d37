"""Time series averaged in bins that re-anchor at gaps.

A bin starts at the first time not covered by the bin before and covers everything
up to and including `width` later, so where a bin starts depends on all earlier
bins.  The chain of starts is found from distinct times alone, slice by slice:

1. each (key, slice) works out, for every time at which the chain can enter it,
   where the chain leaves it again: a step function, which shrinks as entries
   meet on the same bin;
2. the step functions of FAN consecutive slices are composed into one, those of FAN
   such stretches again, until one stretch spans a key: no task sees more than FAN
   of them at a time;
3. from the top down each stretch tells its parts what is covered when they begin;
4. each (key, slice) lists its starts, now that the entry is known.

The input is summed per key and instant once; all steps and the averages, an ordinary
join on time cells, read those sums.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysonde import settings as S
from skysonde.functions.timebins import micros
from skysonde.sources.storage import materialized

CELLS_PER_SLICE = 6
#: Slices, or stretches of them, that are composed at a time.
FAN = 32
_NOTHING = np.iinfo(np.int64).min
_ANY = np.iinfo(np.int64).max


def _followers(times: np.ndarray, width: int) -> np.ndarray:
    """Index of the first time more than `width` after each time."""
    return np.searchsorted(times, times + width, side="right")


def _slice_steps(times: np.ndarray, start: int, width: int) -> pd.DataFrame:
    """Step function of a slice: entering at or before `upto`, the chain leaves at `leave`.

    `leave` is the last instant covered by the last bin begun in the slice.
    """
    entries = int(np.searchsorted(times, start + width, side="right"))
    at = np.arange(min(entries + 1, len(times)))
    follower = _followers(times, width)
    leave = np.zeros(len(at), dtype=np.int64)
    inside = at < len(times)
    while inside.any():
        leave[inside] = times[at[inside]] + width
        at[inside] = follower[at[inside]]
        inside = at < len(times)
    upto = times[: len(leave)]
    keep = np.append(leave[1:] != leave[:-1], True)
    return pd.DataFrame({"upto": upto[keep], "leave": leave[keep]})


def _composed(steps: pd.DataFrame) -> pd.DataFrame:
    """Step function of consecutive slices (or stretches) taken together.

    The chain enters by the first of them.  What covers all its times is carried to the
    second, which begins too late to be touched by it.
    """
    upto, leave = None, None
    for _number, part in steps.groupby("slice", sort=True):
        part = part.sort_values("upto")
        own_upto, own_leave = part["upto"].to_numpy(), part["leave"].to_numpy()
        if upto is None:
            upto, leave, passing = own_upto, own_leave, True
            continue
        at = np.searchsorted(own_upto, leave, side="right")
        inside = at < len(own_upto)
        leave = np.where(inside, own_leave[np.minimum(at, len(own_upto) - 1)], leave)
        if passing and upto[-1] != _ANY:
            upto, leave = np.append(upto, _ANY), np.append(leave, own_leave[0])
        passing = False
    keep = np.append(leave[1:] != leave[:-1], True)
    return pd.DataFrame({"upto": upto[keep], "leave": leave[keep]})


def _chain(steps: pd.DataFrame) -> pd.DataFrame:
    """What is covered already when each slice of a stretch begins."""
    covered = int(steps["covered"].iloc[0])
    slices, entering = [], []
    for number, part in steps.groupby("slice", sort=True):
        slices.append(number)
        entering.append(covered)
        part = part.sort_values("upto")
        i = int(np.searchsorted(part["upto"].to_numpy(), covered, side="right"))
        if i < len(part):
            covered = int(part["leave"].iloc[i])
    return pd.DataFrame({"slice": slices, "covered": entering})


def _starts(times: np.ndarray, covered: int, width: int) -> np.ndarray:
    follower = _followers(times, width)
    found = []
    i = int(np.searchsorted(times, covered, side="right"))
    while i < len(times):
        found.append(times[i])
        i = int(follower[i])
    return np.array(found, dtype=np.int64)


def _whole_groups(
    batches: Iterator[pd.DataFrame],
) -> Iterator[list[tuple[str, int, pd.DataFrame]]]:
    """Groups of a partition sorted by (key, slice), as many per step as a batch completes."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        changes = (rows["key"].ne(rows["key"].shift()) | rows["slice"].ne(rows["slice"].shift()))
        edges = np.flatnonzero(changes.to_numpy())
        yield [
            (rows["key"].iloc[i], int(rows["slice"].iloc[i]), rows.iloc[i:j])
            for i, j in zip(edges[:-1], edges[1:])
        ]
        held = rows.iloc[edges[-1] :]
    if held is not None and len(held):
        yield [(held["key"].iloc[0], int(held["slice"].iloc[0]), held)]


def _entering(stepped: DataFrame) -> DataFrame:
    """(key, slice, covered) for each slice of a table of step functions."""
    span = stepped.agg(F.min("slice").alias("first"), F.max("slice").alias("last")).first()
    levels = [stepped.withColumn("slice", F.col("slice") - F.lit(span.first or 0))]
    width = (span.last - span.first + 1) if span.first is not None else 1
    parent = F.floor(F.col("slice") / F.lit(FAN))
    while width > 1:
        upper = levels[-1].withColumn("parent", parent).groupBy("key", "parent").applyInPandas(
            lambda pdf: _composed(pdf).assign(key=pdf["key"].iloc[0], slice=pdf["parent"].iloc[0])[
                ["key", "slice", "upto", "leave"]
            ],
            "key string, slice long, upto long, leave long",
        )
        levels.append(upper)
        width = -(-width // FAN)
    entering = levels.pop().select("key", "slice").distinct().withColumn("covered", F.lit(_NOTHING))
    for level in reversed(levels):
        above = entering.select("key", F.col("slice").alias("parent"), "covered")
        entering = (
            level.withColumn("parent", parent)
            .join(above, ["key", "parent"])
            .groupBy("key", "parent")
            .applyInPandas(
                lambda pdf: _chain(pdf).assign(key=pdf["key"].iloc[0])[["key", "slice", "covered"]],
                "key string, slice long, covered long",
            )
        )
    return entering.withColumn("slice", F.col("slice") + F.lit(span.first or 0))


def bin_starts(df: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Bin starts per key, from a whole-number time column without repeats or NULLs.

    A task holds the times of one (key, slice), or the step functions of FAN stretches.
    """
    length = width * CELLS_PER_SLICE
    times = df.select(
        F.col(key).cast("string").alias("key"),
        F.floor(F.col(at) / F.lit(length)).alias("slice"),
        F.col(at).alias("at"),
    ).repartition("key", "slice")

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _whole_groups(batches):
            parts = [
                _slice_steps(rows["at"].to_numpy(), number * length, width).assign(
                    key=name, slice=number
                )
                for name, number, rows in groups
            ]
            if parts:
                yield pd.concat(parts)[["key", "slice", "upto", "leave"]]

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in _whole_groups(batches):
            parts = [
                pd.DataFrame(
                    {
                        "key": name,
                        "start": _starts(
                            rows["at"].to_numpy(), int(rows["covered"].iloc[0]), width
                        ),
                    }
                )
                for name, _number, rows in groups
            ]
            if parts:
                yield pd.concat(parts)

    order = ("key", "slice", "at")
    stepped = times.sortWithinPartitions(*order).mapInPandas(
        steps, "key string, slice long, upto long, leave long"
    )
    entering = _entering(materialized(stepped, "steps"))
    return (
        times.join(entering, ["key", "slice"])
        .repartition("key", "slice")
        .sortWithinPartitions(*order)
        .mapInPandas(starts, "key string, start long")
    )


def anchored_bins(
    df: DataFrame,
    key: str,
    value: str,
    time: str = "time",
    width: int = S.SERIES_BIN_MICROS,
    least_rows: int = 2,
) -> DataFrame:
    """Mean of `value` per re-anchored bin; keys with fewer than `least_rows` rows give none.

    A bin is at most `width` long and starts are further apart than that, so a
    row's bin starts in the row's own time cell or in the one before it: the rows
    meet their starts in an equality join on (key, cell).
    """
    instants = materialized(
        df.where(F.col(time).isNotNull())
        .groupBy(key, micros(F.col(time)).alias("_at"))
        .agg(
            F.sum(value).alias("_sum"),
            F.count(value).alias("_values"),
            F.count(F.lit(1)).alias("_rows"),
        ),
        "instants",
    )
    starts = bin_starts(instants, key, "_at", width)
    cell = F.floor(F.col("start") / F.lit(width))
    key_type = dict(df.dtypes)[key]
    shown = (
        starts.withColumn("_in", F.explode(F.array(cell, cell + 1)))
        .groupBy(F.col("key").cast(key_type).alias(key), F.col("_in").alias("_cell"))
        .agg(
            F.max(F.when(cell == F.col("_in"), F.col("start"))).alias("_own"),
            F.max(F.when(cell < F.col("_in"), F.col("start"))).alias("_prior"),
        )
    )
    start = F.when(F.col("_own") <= F.col("_at"), F.col("_own")).otherwise(F.col("_prior"))
    binned = (
        instants.withColumn("_cell", F.floor(F.col("_at") / F.lit(width)))
        .join(shown, [key, "_cell"])
        .groupBy(key, start.alias("bin_start"))
        .agg(
            (F.sum("_sum") / F.nullif(F.sum("_values"), F.lit(0))).alias(f"mean_{value}"),
            F.sum("_rows").alias("n"),
        )
    )
    enough = instants.groupBy(key).agg(F.sum("_rows").alias("_rows")).where(F.col("_rows") >= least_rows)
    return (
        binned.join(enough.select(key), key, "left_semi")
        .withColumn(
            "bin_centre",
            F.timestamp_micros(F.col("bin_start") + F.lit(width // 2)).cast("timestamp_ntz"),
        )
        .withColumn("bin_start", F.timestamp_micros("bin_start").cast("timestamp_ntz"))
    )


def gap_islands(
    df: DataFrame, key: str, time: str = "time", width: int = S.SERIES_BIN_MICROS
) -> DataFrame:
    """Stretches of a series without a gap longer than `width`.

    Times are first reduced to their first and last per cell of `width`; two
    occupied neighbour cells may still be parted by a gap, which the cell bounds
    tell exactly, so the ordered window only sees one row per cell.
    """
    cells = (
        df.withColumn("_at", micros(F.col(time)))
        .groupBy(key, F.floor(F.col("_at") / F.lit(width)).alias("_cell"))
        .agg(
            F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n")
        )
    )
    order = Window.partitionBy(key).orderBy("_cell")
    opens = F.coalesce(
        (F.col("_first") - F.lag("_last").over(order)) > width, F.lit(True)
    ).cast("int")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.withColumn("_opens", opens)
        .withColumn("island", F.sum("_opens").over(upto))
        .groupBy(key, "island")
        .agg(
            F.timestamp_micros(F.min("_first")).cast("timestamp_ntz").alias("first_time"),
            F.timestamp_micros(F.max("_last")).cast("timestamp_ntz").alias("last_time"),
            F.sum("_n").alias("n"),
        )
    )
