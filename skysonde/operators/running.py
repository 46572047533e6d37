"""Running values per key, computed in slices so that a hot key stays parallel.

A plain window over one aircraft puts all its rows into one task.  Here the order
column is cut into slices of fixed width: a small table of what each slice leaves
behind is carried forward per key, and the full rows are only windowed inside
(key, slice).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_WIDTH = 1_000_000


def with_slice(df: DataFrame, order: str, width: int = SLICE_WIDTH) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / F.lit(width)))


def carry_forward(
    df: DataFrame,
    key: str,
    order: str,
    columns: Sequence[str],
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """Last known value of each column, up to and including the row itself.

    Adds `last_<column>`; keeps `_slice`, and leaves the rows partitioned by
    (key, _slice).  `order` must be unique within a key, so a slice never holds
    more than `width` rows of one key.
    """
    sliced = with_slice(df, order, width)
    left_behind = sliced.groupBy(key, "_slice").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
            for c in columns
        ]
    )
    earlier = (
        Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = left_behind.select(
        key,
        "_slice",
        (F.col("_slice") * F.lit(width) - 1).alias(order),
        *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in columns],
        F.lit(True).alias("_carried"),
    )
    within = (
        Window.partitionBy(key, "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.withColumn("_carried", F.lit(False))
        .unionByName(carried, allowMissingColumns=True)
        .withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(within) for c in columns})
        .where(~F.col("_carried"))
        .drop("_carried")
    )
