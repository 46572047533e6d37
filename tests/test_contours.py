"""Contour lines: chains of segments, open and closed, and saddles."""

import math

import pandas as pd

from skysonde.operators.contours import chained, contour_lines, segments


def lines_of(pairs):
    frame = pd.DataFrame([(10, p, q) for p, q in pairs], columns=["level", "p", "q"])
    out = {}
    for r in chained(frame).sort_values(["line", "position"]).itertuples():
        out.setdefault((r.line, r.closed), []).append(r.node)
    return out


def test_segments_are_chained_in_order():
    assert lines_of([(5, 2), (9, 5), (7, 9)]) == {(2, False): [2, 5, 9, 7]}
    assert lines_of([(4, 1), (1, 3), (3, 4)]) == {(1, True): [1, 3, 4]}
    assert lines_of([(1, 2), (3, 4), (8, 9), (9, 10), (10, 8)]) == {(1, False): [1, 2], (3, False): [3, 4], (8, True): [8, 9, 10]}


def mesh(spark, n, value, hole=None):
    rows = [(i, j, float(i), float(j), None if (i, j) == hole else float(value(i, j))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "i int, j int, mesh_day double, mesh_altitude double, value double")


def points(frame):
    out = {}
    for r in frame.orderBy("level", "line", "position").collect():
        out.setdefault((r.level, r.line, r.closed), []).append((r.cross_day, r.cross_altitude))
    return out


def test_a_cone_has_closed_lines_around_its_top(spark):
    got = points(contour_lines(mesh(spark, 21, lambda i, j: 25 - 3 * math.hypot(i - 10, j - 10.2)), step=10))
    closed = {level: line for (level, _, is_closed), line in got.items() if is_closed}
    assert sorted(closed) == [0, 10, 20]
    for level, line in closed.items():
        assert len(set(line)) == len(line) > 4
        assert all(abs(math.hypot(x - 10, y - 10.2) - (25 - level) / 3) < 0.2 for x, y in line)
        assert all(math.dist(a, b) <= math.sqrt(2) for a, b in zip(line, line[1:] + line[:1]))


def test_a_slope_has_one_open_line_per_level_and_none_beside_a_hole(spark):
    whole = points(contour_lines(mesh(spark, 5, lambda i, j: 4 * i + 1), step=10))
    assert {level: (closed, [round(x, 6) for x, _ in line]) for (level, _, closed), line in whole.items()} == {10: (False, [2.25] * 5)}
    assert [y for _, y in next(iter(whole.values()))] == [0.0, 1.0, 2.0, 3.0, 4.0]
    torn = points(contour_lines(mesh(spark, 5, lambda i, j: 4 * i + 1, hole=(3, 2)), step=10))
    assert sorted(len(line) for line in torn.values()) == [2, 2]


def test_the_mean_of_a_saddle_tells_which_edges_belong_together(spark):
    def pairs(high, low):
        got = segments(mesh(spark, 2, lambda i, j: high if i == j else low), step=10).where("level = 0").collect()
        return sorted((r.p, r.q) for r in got)

    bottom, top, left, right = 0, 2, 1, 1_000_000 * 2 + 1
    assert pairs(5, -1) == sorted([(bottom, right), (left, top)])
    assert pairs(1, -5) == sorted([(bottom, left), (top, right)])
