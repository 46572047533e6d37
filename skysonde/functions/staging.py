"""Costly columns that are computed once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of re-evaluating.

    The optimizer moves filters below projections and repeats the projected
    expressions inside them, which is wrong for parsing JSON or running regular
    expressions.  It does not look into the output of a generator, so the columns
    are made by one that yields exactly one row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))
