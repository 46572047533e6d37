"""Connected components by alternating large-star and small-star."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())


def component_labels(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b) of longs; component is the least node.

    The result is a table of `scratch` if there is one, else left for the caller to read.

    Each round's edges are a table in the shared folder, so lineage stays short and a lost
    executor costs one round.  Stars are joins on the node: a centre with very many
    neighbours is aggregated before it is shuffled, and its rows are split as a skewed join.
    Loops, repeated and reversed edges don't matter; edges with nulls are left out; no edges
    give no rows.
    """
    with Scratch(edges.sparkSession) as rounds:
        now = rounds.table(edges.where("a <> b").select("a", "b").distinct(), "edges")
        before, state = None, _state(now)
        while state != before:
            now = rounds.table(_small_star(_large_star(now)), "stars")
            before, state = state, _state(now)
            rounds.drop_before(1)
        return (scratch.table if scratch else rounds.result)(_labels(now), "components")


def _labels(stars: DataFrame) -> DataFrame:
    down = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return down.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
