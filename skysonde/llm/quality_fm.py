"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import U, Texts, small_batches, text_chunks, word_table, words

#: Bins of hashed words, and factors of every feature.
BINS, FACTORS = 1 << 13, 8
#: The model is fitted on at most this many labelled rows of each class: those with the
#: least hashes of their ids.  Scores and statistics cover all rows.
SAMPLE_PER_CLASS = 6000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-5
CHUNK = 4 << 20
REPORT = "doc_id long, held_out boolean, score double, predicted int"

_TEXT = word_table([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)])
_MARKS = word_table([range(0x00, 0x21), range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x7F, 0x100)])
_LINES = word_table([0x0A])
_CLASSES = ("upper", "lower", "digit", "blank", "line", "mark", "control", "wide")
_CLASS = np.full(256, 7, np.uint8)
_CLASS[0x21:0x7F], _CLASS[:0x20], _CLASS[0x7F] = 5, 6, 6
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[0x0A] = 0, 1, 2, 3, 4
STATISTICS = 17


class Features(NamedTuple):
    """Sparse rows: features first[i]..first[i+1] of row i with their values."""

    first: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _counted(key: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, count = np.unique(key, return_counts=True)
    return pairs // width, pairs % width, count


def features(chunk: Texts) -> Features:
    """Log counts of hashed words and marks, of length 1 per text, and statistics in 0..1."""
    n_rows = len(chunk.offsets) - 1
    size = np.diff(chunk.offsets).astype(np.float64)
    text, marks, lines = words(chunk, _TEXT), words(chunk, _MARKS), words(chunk, _LINES)
    bins = np.concatenate((text.symbol % U(BINS), mixed_marks(marks.symbol) % U(BINS))).astype(np.int64)
    rows = np.concatenate((text.row, marks.row))
    row, bin_, count = _counted(rows * BINS + bins, n_rows, BINS)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, n_rows))
    value /= norm[row]

    byte_row = np.repeat(np.arange(n_rows), np.diff(chunk.offsets))
    kinds = np.bincount(byte_row * 8 + _CLASS[chunk.data], minlength=n_rows * 8).reshape(n_rows, 8)
    per = np.maximum(size, 1)
    n_words, n_marks, n_lines = (np.maximum(x.per_row, 1) for x in (text, marks, lines))
    distinct = np.bincount(row, minlength=n_rows) / np.maximum(text.per_row + marks.per_row, 1)
    line_row, _, line_count = _counted(lines.row * (1 << 20) + (lines.symbol % U(1 << 20)).astype(np.int64), n_rows, 1 << 20)
    repeated = 1 - np.bincount(line_row, minlength=n_rows) / n_lines
    mark_length = np.bincount(marks.row, marks.end - marks.start, n_rows) / n_marks
    word_length = np.bincount(text.row, text.end - text.start, n_rows) / n_words
    again = np.zeros(len(text.row), bool)  # words that repeat the word before
    again[1:] = (text.symbol[1:] == text.symbol[:-1]) & (text.row[1:] == text.row[:-1])
    statistics = np.column_stack(
        (
            *(kinds[:, k] / per for k in range(8)),
            np.log1p(size) / 14,
            distinct,
            repeated,
            np.bincount(text.row, again, n_rows) / n_words,
            np.minimum(word_length / 16, 1),
            np.minimum(mark_length / 4, 1),
            np.minimum(marks.per_row / n_words, 1),
            np.minimum(n_lines / n_words, 1),
            np.ones(n_rows),
        )
    )
    statistics[size == 0, : STATISTICS - 1] = 0
    row = np.concatenate((row, np.repeat(np.arange(n_rows), STATISTICS)))
    index = np.concatenate((bin_, np.tile(BINS + np.arange(STATISTICS), n_rows)))
    value = np.concatenate((value, statistics.ravel()))
    order = np.argsort(row, kind="stable")
    return Features(
        np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows)))), index[order].astype(np.int32), value[order].astype(np.float32)
    )


def mixed_marks(symbols: np.ndarray) -> np.ndarray:
    """Marks hash apart from words."""
    return symbols * U(0x9E3779B97F4A7C15) >> U(20)


class Machine:
    """score = 1 / (1 + exp(-(bias + sum w x + 1/2 sum over factors ((sum v x)^2 - sum v^2 x^2))))"""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.bias, self.weight, self.factor = bias, weight, factor

    def margin(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """Margins in time linear in the features, and the factor sums of each row.

        Every row has features, as the statistics are always there.
        """
        v = self.factor[x.index] * x.value[:, None]
        sums = np.add.reduceat(v, x.first[:-1], axis=0)
        squares = np.add.reduceat(v * v, x.first[:-1], axis=0)
        linear = np.add.reduceat(self.weight[x.index] * x.value, x.first[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, x: Features) -> np.ndarray:
        if len(x.first) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(x)[0].astype(np.float64), -500, 500)))


def _some_rows(x: Features, rows: np.ndarray) -> Features:
    count = (x.first[1:] - x.first[:-1])[rows]
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(x.first[:-1][rows] - first[:-1], count) + np.arange(first[-1])
    return Features(first, x.index[at], x.value[at])


def fit(x: Features, label: np.ndarray, weight: np.ndarray) -> Machine:
    """Weighted logistic loss, minimised by Adam over mini-batches; the same rows give the same model."""
    random = np.random.RandomState(9)
    width = BINS + STATISTICS
    machine = Machine(0.0, np.zeros(width, np.float32), random.normal(0, 0.02, (width, FACTORS)).astype(np.float32))
    params = np.zeros((width, 1 + FACTORS), np.float32)
    params[:, 1:] = machine.factor
    mean, square, bias_mean, bias_square, step = np.zeros_like(params), np.zeros_like(params), 0.0, 0.0, 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for rows in np.array_split(random.permutation(len(label)), max(1, len(label) // BATCH)):
            part = _some_rows(x, rows)
            machine.weight, machine.factor = params[:, 0], params[:, 1:]
            margin, sums = machine.margin(part)
            pull = (weight[rows] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label[rows])).astype(np.float32) / weight[rows].sum()
            row = np.repeat(np.arange(len(rows)), np.diff(part.first))
            scaled = pull[row] * part.value
            used, place = np.unique(part.index, return_inverse=True)
            own = scaled[:, None] * (sums[row] - machine.factor[part.index] * part.value[:, None])
            gradient = np.column_stack(
                [np.bincount(place, c, len(used)) for c in (scaled, *own.T)]
            ).astype(np.float32) + DECAY * params[used]
            step += 1
            mean[used] = 0.9 * mean[used] + 0.1 * gradient
            square[used] = 0.999 * square[used] + 0.001 * gradient**2
            bias_mean, bias_square = 0.9 * bias_mean + 0.1 * pull.sum(), 0.999 * bias_square + 0.001 * float(pull.sum()) ** 2
            size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            params[used] -= size * mean[used] / (np.sqrt(square[used]) + 1e-8)
            machine.bias -= size * bias_mean / (np.sqrt(bias_square) + 1e-8)
    return Machine(float(machine.bias), params[:, 0].copy(), params[:, 1:].copy())


def held_out(doc_id) -> "F.Column":
    """Rows no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Model of labels.quality from a bounded sample of labelled documents.

    Rows without label, with other labels than 0 and 1, or held out aren't learnt from.
    Without any such row, or with one class only, the model scores by the share of 1.
    """
    known = labels.select("doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id")))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        bias = 0.0 if not counts else (20.0 if 1 in counts else -20.0)
        return Machine(bias, np.zeros(BINS + STATISTICS, np.float32), np.zeros((BINS + STATISTICS, FACTORS), np.float32))
    picks = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)
    ]
    sample = picks[0].union(picks[1]).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class ids

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), CHUNK):
                x = features(chunk)
                own = range(len(x.first) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.last - chunk.first).cast(pa.int64()),
                        batch.column(2).slice(chunk.first, chunk.last - chunk.first).cast(pa.int32()),
                        pa.array([x.index[x.first[i] : x.first[i + 1]].tobytes() for i in own], pa.binary()),
                        pa.array([x.value[x.first[i] : x.first[i + 1]].tobytes() for i in own], pa.binary()),
                    ],
                    names=["doc_id", "quality", "index", "value"],
                )

    got = rows.mapInArrow(convert, "doc_id long, quality int, index binary, value binary")
    # repeated ids could repeat rows without bound
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "index", "value").limit(2 * per_class).collect()
    index = [np.frombuffer(r["index"], np.int32) for r in got]
    x = Features(
        np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64),
        np.concatenate(index) if index else np.zeros(0, np.int32),
        np.concatenate([np.frombuffer(r["value"], np.float32) for r in got]) if got else np.zeros(0, np.float32),
    )
    label = np.array([r["quality"] for r in got], np.float32)
    if not len(label):
        return Machine(0.0, np.zeros(BINS + STATISTICS, np.float32), np.zeros((BINS + STATISTICS, FACTORS), np.float32))
    # classes weigh as among all labelled rows
    seen = {q: max(float((label == q).sum()), 1.0) for q in (0, 1)}
    weight = np.where(label == 1, counts[1] / seen[1], counts[0] / seen[0])
    return fit(x, label, (weight / weight.mean()).astype(np.float32))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per document: score of its whole text, and whether it counts as label 1.

    docs needs doc_id and text; other columns are not read.  Null texts score as empty
    ones; repeated rows each get their row.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), CHUNK):
                s = model.value.score(features(chunk))
                part = slice(chunk.first, chunk.last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start).cast(pa.int64()),
                        batch.column(2).slice(part.start, part.stop - part.start),
                        pa.array(s),
                        pa.array((s >= 0.5).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return small_batches(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, REPORT)


def without_low_quality(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that score `least` or more."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.value.score(features(c)) >= least for c in text_chunks(batch.column(at), CHUNK)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(keep, docs.schema)
