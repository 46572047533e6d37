import random
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from skysonde.llm import prefix_trie
from skysonde.llm.common import Scratch
from skysonde.llm.prefix_trie import conversation_trie, ranked


def brute_force(rows):
    """The same rows from a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = (role or "").encode(), (text or "").encode()
            digest = sha256(b"%d:" % len(role) + role + text).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    below = defaultdict(list)
    for prefix in members:
        if prefix:
            below[prefix[:-1]].append(prefix)
    out = {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves = sum(out[p][5] for p in below[prefix]) or 1
        last = len(prefix[-1][1]) if prefix else 0
        saved = (len(members[prefix]) - 1) * last + sum(out[p][6] for p in below[prefix])
        ends = ",".join(map(str, sorted(c for c in members[prefix] if built[c] == prefix)))
        parent = min(members[prefix[:-1]]) if prefix else None
        out[prefix] = (
            min(members[prefix]), len(prefix), parent, len(members[prefix]), len(below[prefix]),
            leaves, saved, sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values())


def result(frame, **options):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = conversation_trie(frame, **options)
    assert got.columns == names
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def conversations(seed, n):
    """Few different texts, so that many conversations share turns; some odd turns and ids."""
    pick = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 11 == 3:
            continue
        for t in range(pick.choice([1, 2, 3, 5, 12])):
            turn = pick.choice([t, t, t, None, 3])
            rows.append((c, turn, pick.choice(["user", "assistant", None, ""]), pick.choice(["é", "b", None, "", "a longer text"])))
    return rows


def frame(spark, rows):
    data = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, depth string, x int").repartition(3)


@pytest.mark.parametrize("at_once", [200_000, 3])
def test_nodes_equal_all_prefixes(spark, at_once, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 4)  # slices of slices, and strings of few ids
    rows = conversations(1, 40)
    assert result(frame(spark, rows), at_once=at_once) == brute_force(rows)


def test_sql_gives_the_same_rows():
    rows = conversations(2, 60)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = db.execute(prefix_trie.ORACLE)
    assert sorted(cursor.fetchall(), key=lambda r: r[:2]) == brute_force(rows)


def test_one_conversation_with_most_turns_and_one_shared_by_most(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 16)
    rows = [(1, t, "user", f"t{t % 7}") for t in range(300)] + [(10, t, "user", f"s{t}") for t in range(9)]
    rows += [(c, t, "user", f"s{t}") for c in range(20, 80) for t in range(3)]
    assert result(frame(spark, rows), at_once=50) == brute_force(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 0, "user", "a")],
        [(0, None, None, None)],
        [(7, 0, "user", "a")],
        [(5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a")],
        [(5, 0, "user", "x" * 3_000_000), (6, 0, "user", "x" * 3_000_000)],
    ],
)
def test_small_and_odd_tables(spark, rows):
    assert result(frame(spark, rows)) == brute_force(rows)


def test_list_ranking(spark):
    order = list(range(700))
    random.Random(3).shuffle(order)
    links = [(a, order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, a in enumerate(order)]
    arcs = spark.createDataFrame(links, "arc long, before long, after long").repartition(5)
    with Scratch(spark) as scratch:
        got = ranked(scratch, arcs, at_once=20)
        assert [r.arc for r in got.orderBy("rank").collect()] == order
        assert [r.rank for r in got.orderBy("rank").collect()] == list(range(700))
