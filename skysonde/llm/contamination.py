"""Benchmark decontamination with suffix arrays of the training text."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skysonde.llm.common import U, Texts, small_batches, text_chunks, word_table, words

WINDOW = 10
#: Benchmark items are searched in blocks of at most this many bytes of text, so that
#: what a task holds of them doesn't grow with the benchmark.
BLOCK_BYTES = 8 << 20
#: Bytes of documents in one suffix array.
SHARD_BYTES = 8 << 20
#: ASCII letters, digits and everything outside ASCII make words.
WORD_BYTES = word_table([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])
REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "matches array<struct<first_word:long,n_words:long>>"
)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the dense rank of each."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), U)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))).astype(U)
    return order, rank


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts ordered by their first `depth` symbols; behind the end all are 0.

    Prefix doubling: ranks of 2k symbols come from ranks of k symbols, k places apart;
    the last step overlaps so that it ends at `depth` exactly.
    """
    order, rank = _ranks(symbols)
    known = 1
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(len(rank), U)
        later[: len(rank) - step] = rank[step:] + U(1)
        order, rank = _ranks(rank * U(len(rank) + 2) + later)
        known += step
    return order


class Benchmark:
    """The distinct windows of a block of benchmark items, as symbols."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        chunk = next(text_chunks(pa.array([t for _, t in items], pa.large_string()), 1 << 62))
        found = words(chunk, WORD_BYTES)
        first = np.cumsum(found.per_row) - found.per_row
        size = np.minimum(found.per_row, window)
        count = np.where(found.per_row > 0, found.per_row - size + 1, 0)
        row = np.repeat(np.arange(len(items)), count)
        begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        padded = np.concatenate((found.symbol, np.zeros(window, U)))
        table = padded[begin[:, None] + np.arange(window)]
        table[np.arange(window)[None, :] >= size[row][:, None]] = 0
        # windows in lexicographic order, and which items have them
        order = np.lexsort(table.T[::-1]) if len(table) else np.zeros(0, int)
        table, row = table[order], row[order]
        new = np.ones(len(table), bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)
        self.windows = table[new]
        self.sizes = (self.windows != 0).sum(axis=1)
        self.item_first = np.flatnonzero(np.append(new, True)) if len(table) else np.zeros(1, int)
        self.item_rows = row
        self.ids = [i for i, _ in items]
        self.window = window

    def bounds(self, symbols: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every window among the suffixes: the range that starts with it."""
        columns = np.arange(self.window)

        def search(which: np.ndarray, past_equal: bool) -> np.ndarray:
            wanted, care = self.windows[which], columns[None, :] < self.sizes[which][:, None]
            low, high = np.zeros(len(which), np.int64), np.full(len(which), len(suffixes))
            while (open_ := low < high).any():
                mid = np.minimum((low + high) // 2, len(suffixes) - 1)
                seen = symbols[suffixes[mid][:, None] + columns]
                differs = (seen != wanted) & care
                at = differs.argmax(axis=1)
                rows = np.arange(len(which))
                right = np.where(differs[rows, at], seen[rows, at] < wanted[rows, at], past_equal) & open_
                low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
            return low

        low = search(np.arange(len(self.windows)), False)
        mid = np.minimum(low, len(suffixes) - 1)
        seen = symbols[suffixes[mid][:, None] + columns]
        equal = ((seen == self.windows) | (columns[None, :] >= self.sizes[:, None])).all(axis=1)
        equal &= low < len(suffixes)
        high = low.copy()
        high[equal] = search(np.flatnonzero(equal), True)
        return low, high


def scan(chunk: Texts, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Words per text, which words are hit, and the items each text shares windows with."""
    found = words(chunk, WORD_BYTES)
    n_rows = len(found.per_row)
    # one 0 behind each text, and enough behind all, so that no window crosses texts
    place = np.arange(len(found.row)) + found.row
    symbols = np.zeros(len(found.row) + n_rows + benchmark.window, U)
    symbols[place] = found.symbol
    hit = np.zeros(len(found.row), bool)
    items: dict[int, set[str]] = {}
    if len(found.row) and len(benchmark.windows):
        suffixes = suffix_array(symbols, benchmark.window)
        suffixes = suffixes[suffixes < len(symbols) - benchmark.window]
        low, high = benchmark.bounds(symbols, suffixes)
        some = np.flatnonzero(high > low)
        count = (high - low)[some]
        window = np.repeat(some, count)
        at = np.repeat(low[some] - (np.cumsum(count) - count), count) + np.arange(len(window))
        begin = suffixes[at]
        marks = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + benchmark.sizes[window], -1)
        hit = np.cumsum(marks)[place] > 0
        row_of = np.zeros(len(symbols), np.int64)
        row_of[place] = found.row
        for row, w in np.unique(np.stack((row_of[begin], window), axis=1), axis=0).tolist():
            rows = benchmark.item_rows[benchmark.item_first[w] : benchmark.item_first[w + 1]]
            items.setdefault(row, set()).update(benchmark.ids[r] for r in rows.tolist())
    return found.per_row, hit, items


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Benchmark]:
    """Blocks of items of bounded size; at least one block, so that every text is read."""
    block, size, made = [], 0, False
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator(prefetchPartitions=True):
        block.append(("" if r.item_id is None else str(r.item_id), r.text))
        size += len(r.text)
        if size >= block_bytes:
            yield Benchmark(block, window)
            block, size, made = [], 0, True
    if block or not made:
        yield Benchmark(block or [("", "")], window)


def _scan_blocks(chunk: Texts, blocks: list) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    counts, hit, items = scan(chunk, blocks[0].value)
    for b in blocks[1:]:
        _, more, others = scan(chunk, b.value)
        hit |= more
        for row, ids in others.items():
            items.setdefault(row, set()).update(ids)
    return counts, hit, items


def _broadcast(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, window, block_bytes)]


def overlap_report(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: words, words inside benchmark windows, items met, runs of hit words.

    docs needs doc_id and text, benchmark item_id and text; other columns are not read.
    A window is `window` consecutive words of an item, or all words of a shorter item.
    Each task builds suffix arrays over shards of whole texts and binary-searches every
    benchmark window in each; blocks of the benchmark are broadcast.  Null and empty
    texts have no words; a null item_id reads as the empty id; repeated documents each
    get their row, repeated items count once.  `matches` has the longest verbatim runs.
    """
    blocks = _broadcast(docs, benchmark, window, block_bytes)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), SHARD_BYTES):
                counts, hit, items = _scan_blocks(chunk, blocks)
                edge = np.cumsum(counts) - counts
                summed = np.concatenate(([0], np.cumsum(hit)))
                n_hit = summed[edge + counts] - summed[edge]
                runs = [[] for _ in counts]
                for row in np.flatnonzero(n_hit):
                    own = np.concatenate(([0], hit[edge[row] : edge[row] + counts[row]].view(np.int8), [0]))
                    step = np.diff(own)
                    for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                        runs[row].append({"first_word": int(a), "n_words": int(b - a)})
                own_items = [sorted(items.get(row, ())) for row in range(len(counts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.last - chunk.first).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in own_items], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in own_items]),
                        pa.array(n_hit > 0),
                        pa.array(runs, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(report, REPORT)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents, all columns as they are, that share no window with the benchmark."""
    blocks = _broadcast(docs, benchmark, window, block_bytes)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for chunk in text_chunks(batch.column(at), SHARD_BYTES):
                counts, hit, _ = _scan_blocks(chunk, blocks)
                row = np.repeat(np.arange(len(counts)), counts)[hit]
                clean[chunk.first + row] = False
            yield batch.filter(pa.array(clean))

    return small_batches(docs).mapInArrow(keep, docs.schema)
