"""A total order over rows of any number, without one task that sees them all."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde.sources.storage import materialized


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows with `_block`: blocks are consecutive ranges of the order, one per partition.

    The result is written, as the limits of the ranges come from a sample and could
    differ when they are drawn again.
    """
    ranged = df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id())
    return materialized(ranged, "ranges")


def _before_block(blocks: DataFrame, value: Column) -> DataFrame:
    """A value over all earlier blocks.  One row per block comes in, so the window is small."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_block", value.over(earlier).alias("_before"))


def numbered(df: DataFrame, *order: str, number: str = "_at") -> DataFrame:
    """Rows numbered from 1 in the given order (a total one)."""
    ranged = in_ranges(df, *order)
    before = _before_block(ranged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), F.sum("_n"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return (
        ranged.withColumn(number, own)
        .join(before, "_block")
        .withColumn(number, F.col(number) + F.coalesce("_before", F.lit(0)))
        .drop("_block", "_before")
    )


def with_latest(df: DataFrame, value: str, *order: str) -> DataFrame:
    """`value` of every row, or of the last row before it in the order that has one."""
    ranged = in_ranges(df, *order)
    own = Window.partitionBy("_block").orderBy(*order)
    last = ranged.groupBy("_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last")
    )
    before = _before_block(last, F.last("_last", ignorenulls=True))
    return (
        ranged.withColumn(value, F.last(value, ignorenulls=True).over(own))
        .join(before, "_block")
        .withColumn(value, F.coalesce(value, "_before"))
        .drop("_block", "_before")
    )
