"""Exact medians of groups that may be of any size."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(
    df: DataFrame, key: str, value: str, cell: float, alias: str | None = None
) -> DataFrame:
    """Median of `value` per `key` without gathering any group.

    Counts per cell of width `cell` say which one or two cells hold the middle
    ranks; only the distinct values of those cells are then ranked.  All counting
    is combined before it is shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        key, F.col(value).alias("_v"), F.floor(F.col(value) / F.lit(cell)).alias("_cell")
    )
    in_order = Window.partitionBy(key).orderBy("_cell")
    whole = Window.partitionBy(key)
    cells = (
        rows.groupBy(key, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(in_order), "_total": F.sum("_n").over(whole)})
        .withColumns(
            {
                "_low": F.floor((F.col("_total") + 1) / 2),
                "_high": F.floor((F.col("_total") + 2) / 2),
                "_before": F.col("_upto") - F.col("_n"),
            }
        )
        .where((F.col("_upto") >= F.col("_low")) & (F.col("_before") < F.col("_high")))
        .select(key, "_cell", "_before", "_low", "_high")
    )
    in_cell = Window.partitionBy(key, "_cell").orderBy("_v")
    ranked = (
        rows.join(cells, [key, "_cell"])
        .groupBy(key, "_cell", "_before", "_low", "_high", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_cell))
        .withColumn("_from", F.col("_upto") - F.col("_n") + 1)
    )

    def at(rank: str):
        hit = (F.col("_from") <= F.col(rank)) & (F.col(rank) <= F.col("_upto"))
        return F.max(F.when(hit, F.col("_v")))

    return ranked.groupBy(key).agg(((at("_low") + at("_high")) / 2).alias(alias or value))


def exact_medians(
    df: DataFrame, key: str, values: Sequence[str], cell: float, aliases: Sequence[str]
) -> DataFrame:
    """Medians of several columns per key, joined on the key (one row per key each)."""
    result = None
    for value, alias in zip(values, aliases):
        one = exact_median(df, key, value, cell, alias)
        result = one if result is None else result.join(one, key)
    return result
