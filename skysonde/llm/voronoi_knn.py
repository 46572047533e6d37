"""Exact top-k by inner product as a Voronoi kNN join."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch

#: Pivots are so many vectors with the least hashes of their ids: a bounded sample that
#: only decides how well cells separate, not which rows are found.
PIVOTS = 16
#: Rows of a cell, and queries of a cell, that one task holds at a time.
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
SCALE = 256
#: Distances are floating point; bounds are widened by this share to stay on the safe side.
SLACK = 1e-9
CELLS = "vec_id long, is_query boolean, cell int, distance double, vector binary"


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as floor(256 * x)."""
    kept, rows = [], []
    for i, v in enumerate(column.to_numpy(zero_copy_only=False)):
        if v is not None:
            x = np.asarray(v, dtype=object if getattr(v, "dtype", None) == object else np.float64)
            if x.dtype == object:
                if any(y is None for y in x):
                    continue
                x = x.astype(np.float64)
            if np.isfinite(x).all():
                kept.append(i)
                rows.append(np.floor(SCALE * x).astype(np.int64))
    return np.array(kept, int), rows


def quantised(vectors: DataFrame, every: int) -> DataFrame:
    """(vec_id, is_query, n, norm2, peak, vector): integer components as little-endian 64-bit bytes.

    Rows without vec_id, null vectors and such with null or non-finite components take no part.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = _integers(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(ids % every == 0, pa.bool_()),
                    pa.array([len(x) for x in rows], pa.int32()),
                    pa.array([int((x * x).sum()) for x in rows], pa.int64()),
                    pa.array([int(np.abs(x).max(initial=0)) for x in rows], pa.int64()),
                    pa.array([x.astype("<i8").tobytes() for x in rows], pa.binary()),
                ],
                names=["vec_id", "is_query", "n", "norm2", "peak", "vector"],
            )

    schema = "vec_id long, is_query boolean, n int, norm2 long, peak long, vector binary"
    return vectors.select("vec_id", "embedding").where("vec_id IS NOT NULL").mapInArrow(convert, schema)


def _lifted(vectors: np.ndarray, largest: int, is_query: np.ndarray | bool) -> np.ndarray:
    """One more component, so that the nearest vector is the one of the largest product:
    sqrt(largest - |x|^2) for candidates, 0 for queries."""
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))
    return np.column_stack((x, np.where(is_query, 0.0, rest)))


def _matrix(binaries, n: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(binaries), kind).reshape(-1, n).astype(np.int64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0))


class Cells:
    """Pivots of one vector length, and the bounds their cells give."""

    def __init__(self, pivots: np.ndarray, largest: int) -> None:
        self.n, self.largest = pivots.shape[1], largest
        self.pivots = _lifted(pivots, largest, False)

    def place(self, vectors: np.ndarray, is_query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _distances(_lifted(vectors, self.largest, is_query), self.pivots)
        cell = far.argmin(axis=1)
        return cell, far[np.arange(len(cell)), cell]

    def thresholds(self, reach: dict[int, float], nearest: dict[int, list[float]], k: int) -> dict[int, float]:
        """For each cell with queries, a distance within which each of them has k candidates.

        A candidate of cell c is at most (query to its pivot) + (pivot to pivot) + (pivot c
        to candidate) away; k + 1 are counted, as the query itself may be among them.
        """
        between = _distances(self.pivots, self.pivots)
        out = {}
        for cell, radius in reach.items():
            upper = sorted(radius + between[cell, c] + d for c, ds in nearest.items() for d in ds)
            out[cell] = upper[k] * (1 + SLACK) + SLACK if len(upper) > k else np.inf
        return out

    def wanted_by(
        self, vectors: np.ndarray, reach: dict[int, float], threshold: dict[int, float]
    ) -> Iterator[tuple[int, np.ndarray]]:
        """For each cell with queries, the candidates that can be among their k best.

        The distance to any query of a cell is at least that to its pivot less its radius.
        """
        far = _distances(_lifted(vectors, self.largest, False), self.pivots)
        for to, radius in reach.items():
            limit = threshold[to]
            near = far[:, to] - radius <= limit * (1 + SLACK) + SLACK
            yield to, np.flatnonzero(near)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Per query (rows whose vec_id is divisible by `every`) its k best other rows.

    vectors needs vec_id and embedding; other columns are not read.  Score is the inner
    product of floor(256 * x); ties go to the smaller vec_id; a query with fewer than k
    candidates gets all.  Vectors of different length don't compare; each length is solved
    on its own.  Rows that repeat a vec_id are candidates each, but none for that vec_id.
    An empty table gives no rows.

    Rows fall in the Voronoi cells of pivots.  Summaries of cells (radius, least k + 1
    distances) give each query cell a distance bound; a candidate is sent only to the cells
    whose bound it can meet.  Cells are cut into blocks of bounded size, solved one block of
    candidates against one block of queries, and the best k of all blocks are kept.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    with Scratch(spark) as scratch:
        rows = scratch.table(quantised(vectors, every), "integers")
        found = None
        for r in rows.groupBy("n").agg(F.max("norm2").alias("largest"), F.max("peak").alias("peak")).collect():
            kind = "<i2" if r.peak < 1 << 15 else "<i8"
            own = _solved(scratch, rows.where(F.col("n") == r.n), r.n, r.largest, kind, k)
            found = own if found is None else found.union(own)
        if found is None:
            return spark.createDataFrame([], schema)
        return scratch.result(found, "top-k")


def _solved(scratch: Scratch, rows: DataFrame, n: int, largest: int, kind: str, k: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("vector").distinct().collect()
    pivots = np.unique(_matrix([bytes(r.vector) for r in sample], n), axis=0) if n else np.zeros((1, 0))
    cells = spark.sparkContext.broadcast(Cells(pivots, largest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            vector = _rows(batch.column("vector"), n, "<i8")
            small = pa.array([x.tobytes() for x in vector.astype(kind)], pa.binary())
            for query in (True, False):  # a query is a candidate of the other queries too
                at = np.flatnonzero(is_query) if query else np.arange(batch.num_rows)
                if len(at):
                    cell, distance = cells.value.place(vector[at], np.full(len(at), query))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("vec_id").take(pa.array(at)),
                            pa.array(np.full(len(at), query)),
                            pa.array(cell.astype(np.int32)),
                            pa.array(distance),
                            small.take(pa.array(at)),
                        ],
                        names=["vec_id", "is_query", "cell", "distance", "vector"],
                    )

    placed = scratch.table(rows.select("vec_id", "is_query", "vector").mapInArrow(place, CELLS), "cells")
    reach, counts = {}, {}
    for r in placed.groupBy("cell", "is_query").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect():
        counts[r.cell, r.is_query] = r.n
        if r.is_query:
            reach[r.cell] = r.far
    nearest: dict[int, list[float]] = {}
    candidates = placed.where("NOT is_query")
    least = candidates.select("cell", "distance").mapInArrow(_least(k + 1), "cell int, distance double")
    for r in least.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("distance")), 1, k + 1).alias("d")).collect():
        nearest[r.cell] = r.d
    threshold = cells.value.thresholds(reach, nearest, k)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = _rows(batch.column("vector"), n, kind)
            for to, at in cells.value.wanted_by(vector, reach, threshold):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), to, np.int32)),
                        batch.column("vec_id").take(pa.array(at)),
                        batch.column("vector").take(pa.array(at)),
                    ],
                    names=["cell", "vec_id", "vector"],
                )

    blocks = F.create_map(*[F.lit(x) for c in sorted(reach) for x in (c, -(-counts[c, True] // QUERIES_PER_BLOCK))]) if reach else None
    if blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = candidates.select("vec_id", "vector").mapInArrow(send, "cell int, vec_id long, vector binary")
    total = sum(v for (_, query), v in counts.items() if not query)
    parts = -(-total // ROWS_PER_BLOCK)  # a cell's candidates are cut by id, in as many parts as all rows would need
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    q_block = F.pmod(F.xxhash64("vec_id", F.lit(7)), blocks[F.col("cell")]).cast("int")
    queries = placed.where("is_query").select(
        "cell", q_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "vector")
    sent = sent.select(
        "cell", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")].cast("int") - 1)).alias("block"), slice_.alias("part"), "vec_id", "vector")
    keys = ["cell", "block", "part"]

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, n, kind, k)

    local = queries.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _rows(column, n: int, kind: str) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return _matrix(values, n, kind) if n else np.zeros((len(column), 0), np.int64)


def _least(k: int):
    """The k least distances of each cell among the rows of a task."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, distance = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                own = np.concatenate((kept.get(c, np.zeros(0)), distance[cell == c]))
                kept[c] = np.sort(own)[:k]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, d in kept.items() for _ in d], pa.int32()),
                pa.array([x for d in kept.values() for x in d.tolist()], pa.float64()),
            ],
            names=["cell", "distance"],
        )

    return least


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, n: int, kind: str, k: int) -> pd.DataFrame:
    """The k best candidates of each query of a block."""
    out: list[tuple[int, int, int]] = []
    if len(queries) and len(candidates):
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        theirs = _rows(candidates["vector"], n, kind)[order]
        mine = _rows(queries["vector"], n, kind)
        exact = np.abs(theirs).max(initial=0) * np.abs(mine).max(initial=0) * max(n, 1) < 2**53
        for first in range(0, len(mine), 128):
            part = mine[first : first + 128]
            if exact:  # whole numbers below 2**53: the floating product is exact
                score = (part.astype(np.float64) @ theirs.T.astype(np.float64)).astype(np.int64)
            else:
                score = part @ theirs.T
            for q, s in zip(queries["vec_id"].to_numpy()[first : first + 128].tolist(), score, strict=True):
                take = min(len(s), k + int((ids == q).sum()))
                least = np.partition(s, len(s) - take)[len(s) - take]
                at = np.flatnonzero(s >= least)
                at = at[ids[at] != q]
                at = at[np.lexsort((ids[at], -s[at]))][:k]
                out += [(q, int(ids[i]), int(s[i])) for i in at]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
