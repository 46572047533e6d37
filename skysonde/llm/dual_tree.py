"""Vector codes by product quantisation, its codebooks learnt by dual-tree Lloyd rounds.

Vectors are integers throughout, so results don't depend on how rows are dealt to tasks.
Rows are cut into blocks; in each block and for each position of the cut there is one tree
over the parts, written once.  A round walks that tree and a tree over the entries of the
codebook together: bounds on the distance between two boxes prune combinations of nodes,
a node left with one entry hands its cached sum to it as a whole, and what is still open
at the leaves is decided by integer distances.  Only sums of entries leave a task.
"""

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Values (rows times components) of a block, so that its size doesn't depend on the length of vectors.
BLOCK_VALUES = 1 << 18
#: Parts in a leaf at most.
LEAF = 32
#: Up to so many different labels are joined by broadcast, 16 bytes each; more by shuffle.
BROADCAST_LABELS = 500_000
#: Copies of a label's sum in that shuffle, so that a frequent label is dealt to many tasks.
LABEL_COPIES = 32
BLOCKS = "ids array<{id}>, labels array<{label}>, n int, points binary, rows binary, low binary, high binary, sums binary"


class TooLarge(ValueError):
    """A component is so large that a sum of squared distances would not fit into 64 bits."""


def largest_component(length: int) -> int:
    """Integer components up to this keep a squared distance over `length` of them in 64 bits."""
    return min(isqrt((2**63 - 1) // max(length, 1)) // 4, 2**31 - 1)


def padded(length: int, parts: int) -> int:
    """Length of vectors that can be cut into equal parts; short ones get zeros behind."""
    return -(-length // parts) * parts


def integers(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of a matrix, with zeros up to `width` columns."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.astype(np.float64))
    limit = largest_component(values.shape[1])
    if len(x) and not np.abs(x).max(initial=0.0) <= limit:
        raise TooLarge(f"components beyond {limit / scale:g} at {values.shape[1]} components a vector")
    return np.pad(x.astype(np.int64), ((0, 0), (0, width - x.shape[1])))


class Tree(NamedTuple):
    """A balanced tree over rows: node 0 is the root, 2i+1 and 2i+2 are below i.

    `rows` lists them leaf by leaf; every node of a level has as many places, and places
    beyond the rows (`-1`) are at the end of leaves.  `low` and `high` bound a node.
    """

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @property
    def depth(self) -> int:
        return (len(self.counts) + 1).bit_length() - 2


def tree_over(points: np.ndarray, leaf: int) -> Tree:
    """Split in the middle of the widest side, level by level, until leaves hold `leaf` rows."""
    n, m = points.shape
    depth = max(0, (-(-n // leaf) - 1).bit_length()) if m else 0
    places = 1 << depth
    size = -(-n // places) if n else 1
    order = np.full(places * size, -1)
    order[:n] = np.arange(n)
    for level in range(depth):
        nodes = order.reshape(1 << level, -1)
        there = nodes >= 0
        at = points[nodes]
        low = np.where(there[:, :, None], at, np.iinfo(np.int64).max).min(axis=1)
        high = np.where(there[:, :, None], at, np.iinfo(np.int64).min).max(axis=1)
        side = (high.astype(float) - low).argmax(axis=1)
        key = np.where(there, np.take_along_axis(at, side[:, None, None], axis=2)[:, :, 0], np.iinfo(np.int64).max)
        nodes = np.take_along_axis(nodes, np.lexsort((~there, key), axis=-1), axis=1)
        counts = there.sum(axis=1)  # rows are in front now; each half gets half of them
        half = nodes.shape[1] // 2
        left = (counts + 1) // 2
        split = np.full_like(nodes, -1)
        column = np.arange(nodes.shape[1])
        source = np.where(column < half, column, column - half + left[:, None])
        used = np.where(column < half, column < left[:, None], source < counts[:, None])
        split[used] = np.take_along_axis(nodes, np.minimum(source, nodes.shape[1] - 1), axis=1)[used]
        order = split.reshape(-1)
    leaves = order.reshape(places, size)
    there = leaves >= 0
    at = points[leaves]
    low = np.where(there[:, :, None], at, np.iinfo(np.int64).max).min(axis=1)
    high = np.where(there[:, :, None], at, np.iinfo(np.int64).min).max(axis=1)
    sums = np.where(there[:, :, None], at, 0).sum(axis=1)
    counts = there.sum(axis=1)
    levels = [(low, high, sums, counts)]
    for _ in range(depth):
        low, high, sums, counts = levels[0]
        levels.insert(
            0,
            (
                low.reshape(-1, 2, m).min(axis=1),
                high.reshape(-1, 2, m).max(axis=1),
                sums.reshape(-1, 2, m).sum(axis=1),
                counts.reshape(-1, 2).sum(axis=1),
            ),
        )
    return Tree(order, *(np.concatenate(x) for x in zip(*levels)))


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    return (gap * gap).sum(axis=-1)


def _reach(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Largest squared distance between points of boxes."""
    span = np.maximum(np.abs(other_high - low), np.abs(high - other_low))
    return (span * span).sum(axis=-1)


class Found(NamedTuple):
    """Entries of the rows of a tree, their squared distances, and what each entry got."""

    entry: np.ndarray
    distance: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    decided: int  # rows that nodes took along as a whole


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray, each: bool) -> Found:
    """Nearest entry (the lower one on ties) of every row, walking both trees together.

    `each` also gives entry and distance of every row; otherwise only rows of leaves that
    bounds leave open are looked at, and the others count with the sums of their nodes.
    """
    k, m = entries.shape
    book = tree_over(entries, 1)
    sums, counts = np.zeros((k, m), np.int64), np.zeros(k, np.int64)
    whole = np.full(1 << tree.depth, -1)  # entry of a leaf, where bounds decided it
    decided = 0
    # pairs of a node of parts and a node of entries that may hold the nearest entry of some part
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    left_open, left_entry = [], []
    single = len(book.counts) - (1 << book.depth)  # nodes of entries from here on are entries
    for level in range(tree.depth + book.depth + 1):
        keep = (tree.counts[node] > 0) & (book.counts[other] > 0)
        node, other = node[keep], other[keep]
        if not len(node):
            break
        boxes = tree.low[node], tree.high[node], book.low[other], book.high[other]
        first = (1 << min(level, tree.depth)) - 1
        limit = np.full(1 << min(level, tree.depth), np.iinfo(np.int64).max)
        np.minimum.at(limit, node - first, _reach(*boxes))
        near = _apart(*boxes) <= limit[node - first]
        node, other = node[near], other[near]
        if level >= book.depth:
            entry = book.rows[other - single]
            node, entry = _undominated(tree, entries, node, entry)
            alone = np.bincount(node - first, minlength=len(limit))[node - first] == 1
            np.add.at(sums, entry[alone], tree.sums[node[alone]])
            np.add.at(counts, entry[alone], tree.counts[node[alone]])
            decided += int(tree.counts[node[alone]].sum())
            below = tree.depth - min(level, tree.depth)
            for v, e in zip(node[alone] - first, entry[alone]):
                whole[v << below : (v + 1) << below] = e
            node, entry = node[~alone], entry[~alone]
            other = single + _places(book)[entry]
            if level >= tree.depth:
                left_open, left_entry = node - first, entry
                break
        # one level down on both sides, where there is one
        if level < tree.depth:
            node, other = np.repeat(2 * node + 1, 2) + np.tile([0, 1], len(node)), np.repeat(other, 2)
        if level < book.depth:
            node, other = np.repeat(node, 2), np.repeat(2 * other + 1, 2) + np.tile([0, 1], len(other))
    return _with_rows(tree, points, entries, whole, left_open, left_entry, sums, counts, decided, each)


def _places(book: Tree) -> np.ndarray:
    """Place of every entry among the leaves of its tree."""
    places = np.zeros(int(book.counts[0]), np.int64)
    there = book.rows >= 0
    places[book.rows[there]] = np.flatnonzero(there)
    return places


def _undominated(tree: Tree, entries: np.ndarray, node: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs but those whose entry is nowhere in the node's box nearer than the one nearest to its middle.

    |x-a|^2 - |x-b|^2 is linear in x, so over a box it is largest at a corner.
    """
    low, high = tree.low[node], tree.high[node]
    middle = (2 * entries[entry] - low - high).astype(np.float64)
    order = np.lexsort((entry, (middle * middle).sum(axis=1), node))
    node, entry, low, high = node[order], entry[order], low[order], high[order]
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    best = np.repeat(entry[starts], np.diff(np.append(starts, len(node))))
    a, b = entries[best], entries[entry]
    step = 2 * (b - a)
    gain = (np.where(step > 0, high, low) * step).sum(axis=1) + (a * a - b * b).sum(axis=1)
    keep = (best == entry) | (gain > 0) | ((gain == 0) & (entry < best))
    return node[keep], entry[keep]


def _with_rows(tree, points, entries, whole, left_open, left_entry, sums, counts, decided, each) -> Found:
    """Integer distances for the rows of open leaves, and for all rows where they are wanted."""
    leaves = tree.rows.reshape(len(whole), -1)
    n = int(tree.counts[0])
    entry_of, distance = np.full(n, -1), np.zeros(n, np.int64)
    if len(left_open):
        order = np.lexsort((left_entry, left_open))
        leaf, entry = left_open[order], left_entry[order]
        starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        per_leaf = np.diff(np.append(starts, len(leaf)))
        apart = points[leaves[leaf]] - entries[entry][:, None, :]
        squares = (apart * apart).sum(axis=2)  # of every pair left, for every place of its leaf
        least = np.repeat(np.minimum.reduceat(squares, starts), per_leaf, axis=0)
        best = np.minimum.reduceat(np.where(squares == least, entry[:, None], len(entries)), starts)
        rows = leaves[leaf[starts]]
        there = rows >= 0
        rows, best = rows[there], best[there]
        entry_of[rows] = best
        np.add.at(sums, best, points[rows])
        np.add.at(counts, best, 1)
    if each:
        for i in np.flatnonzero(whole >= 0):
            entry_of[leaves[i][leaves[i] >= 0]] = whole[i]
        apart = points - entries[entry_of]
        distance = (apart * apart).sum(axis=1)
    return Found(entry_of, distance, sums, counts, decided)


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, label) of the rows that take part."""
    v = F.col("embedding")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & whole).select("vec_id", v.cast("array<double>").alias("v"), "label")


def vector_length(kept: DataFrame) -> int | None:
    """The length most vectors have, the shorter one on a tie; None without vectors."""
    row = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return None if row is None else row.n


def _blocks(kept: DataFrame, length: int, scale: int, parts: int, schema: str) -> DataFrame:
    """Blocks of rows as integers by part, each with its trees."""
    width = padded(length, parts)
    rows_per_block = max(LEAF, BLOCK_VALUES // max(width, 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, rows_per_block):
                piece = batch.slice(first, rows_per_block)
                if n and n + piece.num_rows > rows_per_block:
                    yield block(waiting)
                    waiting, n = [], 0
                waiting.append(piece)
                n += piece.num_rows
        if n:
            yield block(waiting)

    def block(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pieces).combine_chunks()
        n = table.num_rows
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        whole = integers(flat.reshape(n, length), scale, width)
        cuts = whole.reshape(n, parts, width // parts).transpose(1, 0, 2)
        trees = [tree_over(p, LEAF) for p in cuts]
        limits = pa.array([0, n], pa.int32())

        def packed(arrays: list[np.ndarray], kind: str) -> pa.Array:
            return pa.array([b"".join(np.ascontiguousarray(x, kind).tobytes() for x in arrays)], pa.binary())

        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(limits, table.column("vec_id").combine_chunks()),
                pa.ListArray.from_arrays(limits, table.column("label").combine_chunks()),
                pa.array([n], pa.int32()),
                packed(cuts, "<i4"),
                packed([t.rows for t in trees], "<i4"),
                # bounds of empty nodes are cut off; they are never looked at
                packed([t.low.clip(max=2**31 - 1) for t in trees], "<i4"),
                packed([t.high.clip(min=-(2**31)) for t in trees], "<i4"),
                packed([np.column_stack((t.counts, t.sums)) for t in trees], "<i8"),
            ],
            names=["ids", "labels", "n", "points", "rows", "low", "high", "sums"],
        )

    return kept.where(F.size("v") == length).mapInArrow(cut, schema)


def _unpacked(batch: pa.RecordBatch, i: int, width: int, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """Points and tree of every part of a stored block."""
    n, m = batch.column("n")[i].as_py(), width // parts

    def values(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_buffer(), kind).astype(np.int64)

    points = values("points", "<i4").reshape(parts, n, m)
    rows = values("rows", "<i4").reshape(parts, -1)
    sums = values("sums", "<i8").reshape(parts, -1, m + 1)
    low, high = (values(name, "<i4").reshape(parts, sums.shape[1], m) for name in ("low", "high"))
    for p in range(parts):
        yield points[p], Tree(rows[p], low[p], high[p], sums[p, :, 1:], sums[p, :, 0])


def _first_entries(kept: DataFrame, length: int, scale: int, parts: int, entries: int) -> np.ndarray:
    """[part, entry, component]: the parts of the vectors with the smallest ids."""
    first = kept.where(F.size("v") == length).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    width = padded(length, parts)
    whole = integers(np.array([r.v for r in first], np.float64).reshape(len(first), length), scale, width)
    return whole.reshape(len(whole), parts, width // parts).transpose(1, 0, 2)


def _round(blocks: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after one round: entries become the floor of the mean of their parts.

    A task sums over all its blocks, so parts * entries rows leave it, and as many in all
    reach the driver.
    """
    parts, k, m = books.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, m), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, (points, tree) in enumerate(_unpacked(batch, i, width, parts)):
                    found = assigned(tree, points, books[p], each=False)
                    sums[p] += found.sums
                    counts[p] += found.counts
        used = np.flatnonzero(counts.reshape(-1))
        limits = pa.array(np.arange(len(used) + 1) * m, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(counts.reshape(-1)[used], pa.int64()),
                pa.ListArray.from_arrays(limits, pa.array(sums.reshape(parts * k, m)[used].reshape(-1), pa.int64())),
            ],
            names=["entry", "n", "total"],
        )

    stored = blocks.select("n", "points", "rows", "low", "high", "sums")
    each = stored.mapInArrow(totals, "entry int, n long, total array<long>")
    # decimals: a sum over all rows of a large table need not fit into 64 bits
    added = each.groupBy("entry").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("total", F.lit(j)).cast("decimal(38,0)")) for j in range(m)]).alias("total"),
    )
    new = books.copy().reshape(parts * k, m)
    for row in added.collect():
        new[row.entry] = [int(x) // row.n for x in row.total]
    return new.reshape(parts, k, m)


def _coded(blocks: DataFrame, books: np.ndarray, width: int, schema: str) -> DataFrame:
    """vec_id, label, code and error of every row."""
    parts = len(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [assigned(t, p, books[j], each=True) for j, (p, t) in enumerate(_unpacked(batch, i, width, parts))]
                entries = np.column_stack([f.entry for f in found]).astype(np.uint8)
                texts = [bytes(row).hex() for row in entries]
                error = sum(f.distance for f in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(texts, pa.string()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(code, schema)


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows with the error of all rows of their label.

    The sums of labels are broadcast where they are few.  Otherwise they are joined by
    shuffle: each sum in several copies, so that no label's rows are all in one task.
    """
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(LABEL_COPIES - 1))))
    dealt = coded.withColumn("_deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_COPIES)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_deal") == F.col("_copy"))
    return dealt.join(copies, same, "left").drop("_label", "_copy", "_deal")


class Codebooks(NamedTuple):
    """Learnt entries as [part, entry, component], and the length of the vectors they are for."""

    entries: np.ndarray
    length: int

    @property
    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors of (vec_id, embedding, label), and the codebooks they refer to.

    Rows: vec_id, code (two hexadecimal digits per part), error (squared distance, integer
    components floor(scale * x)), label_error (error summed over equal labels, nulls
    together).  Codebooks start as the parts of the `entries` (256 at most) smallest
    vec_ids; repeated ids go by their vectors, null ids last.

    Null vectors and such with null or non-finite components are left out, and so are
    vectors that haven't the length most vectors have (the shorter one on a tie).  A length
    that `parts` doesn't divide is filled up with zeros; empty vectors are all alike.  Fewer
    vectors than entries give fewer entries; repeated rows count and come out each; no
    vectors give no rows and no codebooks.  Ties of distance go to the lower entry.
    Components so large that distances leave 64 bits raise TooLarge (at 64 components,
    |x| above 23,000).  Other columns are left behind, whatever their names.

    Blocks with their trees are a table in the shared folder that every round reads; a lost
    executor costs its blocks of one round.
    """
    kept = kept_vectors(vectors)
    types = {"id": kept.schema["vec_id"].dataType.simpleString(), "label": kept.schema["label"].dataType.simpleString()}
    schema = "vec_id {id}, label {label}, code string, error long".format(**types)
    columns = ["vec_id", "code", "error", "label_error"]
    length = vector_length(kept)
    if length is None:
        return _with_label_errors(vectors.sparkSession.createDataFrame([], schema)).select(columns), None
    width = padded(length, parts)
    with Scratch(vectors.sparkSession) as scratch:
        blocks = scratch.table(_blocks(kept, length, scale, parts, BLOCKS.format(**types)), "blocks")
        books = _first_entries(kept, length, scale, parts, entries)
        for _ in range(rounds):
            books = _round(blocks, books, width)
        coded = scratch.table(_coded(blocks, books, width, schema), "codes")
        result = scratch.result(_with_label_errors(coded).select(columns), "vector-codes")
    return result, Codebooks(books, length)


_NEAREST = """
a{i} AS MATERIALIZED (SELECT n, p, arg_min(j, (d, j)) AS j, min(d) AS d
    FROM (SELECT x.n, x.p, y.j,
            CAST(list_sum(list_transform(list_zip(x.v, y.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM cuts x JOIN b{i} y ON x.p = y.p) GROUP BY n, p)"""
_MEANS = """
s{i} AS (SELECT p, j, k, CAST(sum(y) AS BIGINT) AS t, count(*) AS m
    FROM (SELECT a.p, a.j, unnest(x.v) AS y, unnest(range(len(x.v))) AS k
        FROM a{i} a JOIN cuts x ON a.n = x.n AND a.p = x.p) GROUP BY p, j, k),
m{i} AS (SELECT p, j, list((t - ((t % m) + m) % m) // m ORDER BY k) AS c FROM s{i} GROUP BY p, j),
b{next} AS MATERIALIZED (SELECT p, j, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, j))"""


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The codes of the table `embeddings` in SQL: every part with every entry, round by round.

    For vectors of one length that `parts` divides.
    """
    steps = [
        f"""
valid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cuts AS MATERIALIZED (SELECT n, p, list_transform(e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})],
        lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM valid, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, n - 1 AS j, v AS c FROM cuts WHERE n <= {entries})"""
    ]
    for i in range(rounds):
        steps += [_NEAREST.format(i=i), _MEANS.format(i=i, next=i + 1)]
    steps.append(_NEAREST.format(i=rounds))
    steps.append(f"""
codes AS (SELECT n, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{rounds} GROUP BY n),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds})""")
    return (
        "WITH"
        + ",".join(steps)
        + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM valid JOIN codes USING (n), books"""
    )
