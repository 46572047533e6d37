"""Shared helpers: texts of Arrow batches as bytes, words as 64-bit symbols."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skysonde.sources.storage import fresh_folder

# Arrow's own pools keep freed memory for the process; many tasks share an executor.
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
#: Rows of long texts in one Arrow batch; the session's default suits short rows.
BATCH_ROWS = 1000
#: Texts are worked on in chunks of about this many bytes; one longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: Words are turned into symbols for so many bytes at a time.
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have at most BATCH_ROWS rows from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


class Texts(NamedTuple):
    """Consecutive texts of a batch: rows first..last of it, their bytes and offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into chunks of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Texts(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def word_table(separators: list[range | int]) -> np.ndarray:
    """Value of every byte: 0 for separators, else the byte with A-Z lower-cased, plus 1."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    for s in separators:
        table[list(s) if isinstance(s, range) else s] = 0
    return table


class Words(NamedTuple):
    """Words of a chunk in order: bytes [start, end), the text each is in, and its symbol."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    symbol: np.ndarray
    per_row: np.ndarray


def words(chunk: Texts, table: np.ndarray) -> Words:
    """Maximal runs of word bytes.  Equal words have equal symbols, which are never 0.

    UTF-8 bytes of a character outside ASCII are all word bytes or none, so runs of
    bytes are runs of characters.
    """
    value = table[chunk.data]
    inside = value != 0
    n = len(value)
    edges = np.zeros(n + 1, bool)  # where a text begins
    edges[chunk.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edges[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edges[1:])) + 1
    h = np.empty(len(start), U)
    first = 0
    while first < len(start):  # piece by piece, so that 64-bit values are held for few bytes
        last = max(int(np.searchsorted(end, start[first] + PIECE_BYTES, side="right")), first + 1)
        begin = start[first]
        piece = value[begin : end[last - 1]]
        up, down = POWERS.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, U)
        np.cumsum(piece * up[: len(piece)], out=total[1:])
        h[first:last] = (total[end[first:last] - begin] - total[start[first:last] - begin]) * down[start[first:last] - begin]
        first = last
    h ^= (end - start).astype(U) << U(48)
    h = mixed(h)
    h[h == 0] = 1
    row = np.searchsorted(chunk.offsets, start, side="right") - 1
    return Words(start, end, row, h, np.bincount(row, minlength=len(chunk.offsets) - 1))


class Scratch:
    """Intermediate tables in the shared folder, removed when the block ends.

    with Scratch(spark) as scratch: ... scratch.table(df, "name") ...
    The result of the block must not read them any more, or be kept by `result`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def _written(self, df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
        path = fresh_folder(self.spark, purpose)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        """df, written and read back; lineage ends here, and a lost executor costs no more."""
        back, path = self._written(df, purpose)
        self.paths.append(path)
        return back

    def result(self, df: DataFrame, purpose: str) -> DataFrame:
        """Like table, but left for the caller to read."""
        return self._written(df, purpose)[0]

    def drop_before(self, kept: int) -> None:
        """Remove all but the last `kept` tables now."""
        gone, self.paths = self.paths[:-kept], self.paths[-kept:]
        self._remove(gone)

    def _remove(self, paths: list[str]) -> None:
        jvm = self.spark._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *failure) -> None:
        self._remove(self.paths)
