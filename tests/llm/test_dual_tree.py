import hashlib

import numpy as np
import pytest
from pyspark.errors import PythonException

from skysonde.llm import dual_tree
from skysonde.llm.dual_tree import assigned, compressed, tree_over


def lloyd(vectors, parts, entries, rounds, scale):
    """Brute force: every part with every entry, in plain integers."""
    whole = [[int(np.floor(scale * float(x))) for x in v] for v in vectors]
    m = len(whole[0]) // parts
    cuts = [[tuple(v[p * m : (p + 1) * m]) for v in whole] for p in range(parts)]
    books = [list(c[:entries]) for c in cuts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(x, books[p])[1] for x in cuts[p]]
            for j in range(len(books[p])):
                mine = [x for x, c in zip(cuts[p], chosen) if c == j]
                if mine:
                    books[p][j] = tuple(sum(x[i] for x in mine) // len(mine) for i in range(m))
    last = [[nearest(cuts[p][i], books[p]) for p in range(parts)] for i in range(len(whole))]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return ["".join(f"{j:02x}" for _, j in row) for row in last], [sum(d for d, _ in row) for row in last], hashlib.sha256(flat.encode()).hexdigest()


def frame(spark, vectors, labels, ids=None, parts=3):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, label, "x", 7) for i, v, label in zip(ids, vectors, labels)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int").repartition(parts)


@pytest.mark.parametrize("kind", ["spread", "clusters", "few different", "alike"])
def test_codes_equal_plain_lloyd_rounds(spark, kind, monkeypatch):
    rng = np.random.default_rng(7)
    n = 300
    vectors = {
        "spread": lambda: rng.normal(size=(n, 16)),
        "clusters": lambda: rng.integers(0, 5, size=(n, 1)) * 3.0 + rng.normal(size=(n, 16)) * 0.01,
        "few different": lambda: rng.integers(-1, 2, size=(n, 16)) / 4096,
        "alike": lambda: np.full((n, 16), -0.3),
    }[kind]().astype(np.float32)
    labels = [None if i % 7 == 0 else i % 3 for i in range(n)]
    monkeypatch.setattr(dual_tree, "BLOCK_VALUES", 16 * 70)  # several blocks, the last ones not full
    result, books = compressed(frame(spark, vectors.tolist(), labels), parts=4, entries=6, rounds=3)
    codes, errors, digest = lloyd(vectors, 4, 6, 3, 4096)
    got = {r.vec_id: r for r in result.collect()}
    assert [got[i].code for i in range(n)] == codes
    assert [got[i].error for i in range(n)] == errors
    assert books.digest == digest
    for label in (None, 0, 1, 2):
        rows = [i for i in range(n) if labels[i] == label]
        assert {got[i].label_error for i in rows} == {sum(errors[i] for i in rows)}


@pytest.mark.parametrize("n, m, k", [(1, 3, 1), (2, 2, 5), (33, 1, 4), (257, 8, 16), (1000, 2, 16), (640, 4, 200)])
def test_the_walk_finds_the_nearest_entry_and_takes_nodes_as_a_whole(n, m, k):
    rng = np.random.default_rng(n)
    points = rng.integers(-50, 50, size=(n, m)) * (40 if m == 2 else 1)
    entries = points[rng.integers(0, n, size=k)] + rng.integers(-1, 2, size=(k, m))
    tree = tree_over(points, dual_tree.LEAF)
    rows = tree.rows[tree.rows >= 0]
    assert sorted(rows) == list(range(n)) and (tree.sums[0] == points.sum(axis=0)).all()
    squares = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for each in (True, False):
        found = assigned(tree, points, entries, each)
        assert (found.counts == np.bincount(squares.argmin(axis=1), minlength=k)).all()
        assert (found.sums == [points[squares.argmin(axis=1) == j].sum(axis=0) for j in range(k)]).all()
    found = assigned(tree, points, entries, True)
    assert (found.entry == squares.argmin(axis=1)).all() and (found.distance == squares.min(axis=1)).all()


def test_bounds_decide_well_separated_rows_without_looking_at_them():
    rng = np.random.default_rng(1)
    points = np.repeat([[0, 0], [10_000, 0], [0, 10_000], [9_000, 9_000]], 500, axis=0) + rng.integers(0, 30, size=(2000, 2))
    found = assigned(tree_over(points, 32), points, points[::500].copy(), each=False)
    assert found.decided >= 1900 and found.counts.tolist() == [500] * 4


def test_vectors_that_take_no_part_and_odd_lengths(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, 1.0, -1.0], None, [nan, 0.0, 0.0], [None, 0.0, 0.0], [inf, 0.0, 0.0], [1.0], [], [0.5, 1.0, -1.0]]
    result, books = compressed(frame(spark, vectors, [1] * 8, ids=[5, 1, 2, 3, 4, 0, 6, 5]), parts=2, entries=4)
    assert sorted(map(tuple, result.collect())) == [(5, "0000", 0, 0), (5, "0000", 0, 0)]
    assert books.entries.tolist() == [[[2048, 4096]] * 2, [[-4096, 0]] * 2]


@pytest.mark.parametrize("vectors", [[], [None, None]])
def test_no_vectors(spark, vectors):
    result, books = compressed(frame(spark, vectors, [None] * len(vectors)))
    assert result.collect() == [] and books is None


def test_empty_vectors_and_null_ids_and_labels(spark):
    result, _ = compressed(frame(spark, [[], []], [None, None], ids=[None, 3]))
    assert {tuple(r) for r in result.collect()} == {(3, "00" * 8, 0, 0), (None, "00" * 8, 0, 0)}


def test_components_that_leave_64_bits_are_refused(spark):
    with pytest.raises((PythonException, dual_tree.TooLarge), match="components beyond"):
        compressed(frame(spark, [[3e7] * 8, [1.0] * 8], [1, 1]))


def test_sums_of_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BROADCAST_LABELS", 2)
    vectors = [[float(i % 11), float(i % 7)] for i in range(60)]
    labels = [None if i < 30 else i % 5 for i in range(60)]
    got = compressed(frame(spark, vectors, labels), parts=2, entries=3)[0].collect()
    assert len(got) == 60
    for label in {None, 0, 1, 2, 3, 4}:
        rows = [r for r in got if labels[r.vec_id] == label]
        assert {r.label_error for r in rows} == {sum(r.error for r in rows)}
