"""Prefix trie of conversations, measured over its Euler tour.

Every conversation is rebuilt with the first turns of another one, and every distinct
sequence of first turns is a node.  The tour enters and leaves each node once; its arcs are
ranked distributedly, and sums over the subtree of a node are differences of prefix sums at
its two arcs.

No step gathers a group: conversations, children and members are numbered over range
partitions, running values go through slices of bounded size, and joins on a key that many
rows have go by slices as well.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch

#: Families of five conversations share the turns of their first; of up to eight turns, by a checksum.
FAMILY, SHARES = 5, 9
#: Rows of a slice: of a running value, of a join on a frequent key, and of ids joined to one string.
SLICE = 1024
#: So many arcs are ranked in one task; longer lists are shortened first.
RANKED_AT_ONCE = 200_000
NODE = ("depth", "x", "y")


def numbered(scratch: Scratch, df: DataFrame, *order: Column | str, number: str) -> DataFrame:
    """Rows numbered from 0 in a total order.  The ranges are written, so that they are drawn once."""
    ranged = scratch.table(df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = counts.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(F.broadcast(before), "_block")
    placed = placed.withColumn(number, (F.col("_own") + F.col("_before") - 1).cast("long"))
    return scratch.table(placed.drop("_block", "_own", "_before"), "numbered")


def running(scratch: Scratch, df: DataFrame, keys: list[str], at: str, values: dict[str, str], combine) -> DataFrame:
    """Running values in the order of `at` (from 0, without gaps) per key, by slices of slices.

    `values` maps new columns to columns; `combine` is an aggregate without regard to order.
    A slice has at most SLICE rows, and so has every slice of slices above it.
    """
    slices = df.withColumn("_slice", F.expr(f"{at} div {SLICE}"))
    within = Window.partitionBy(*keys, "_slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = slices.withColumns({new: combine(old).over(within) for new, old in values.items()})
    if not df.where(F.col(at) >= SLICE).limit(1).count():
        return own.drop("_slice")
    totals = slices.groupBy(*keys, F.col("_slice").alias("_place")).agg(*[combine(old).alias(old) for old in values.values()])
    above = {f"_upto_{new}": old for new, old in values.items()}
    upto = running(scratch, scratch.table(totals, "totals"), keys, "_place", above, combine)
    before = scratch.table(upto.select(*keys, (F.col("_place") + 1).alias("_slice"), *above), "before")
    joined = own.join(before, [*keys, "_slice"], "left")
    pairs = {new: (F.col(new), F.col(f"_upto_{new}")) for new in values}
    both = {new: F.coalesce(COMBINED[combine](*pair), pair[0]) for new, pair in pairs.items()}
    return joined.withColumns(both).drop("_slice", *above)


#: How two values are combined, by the aggregate.
COMBINED = {F.sum: lambda a, b: a + b, F.bit_xor: lambda a, b: a.bitwiseXOR(b)}


def _slices_of(first: str, count: str) -> Column:
    """The slices that `count` rows numbered from `first` on are in."""
    last = F.col(first) + F.col(count) - 1
    return F.explode(F.sequence(F.expr(f"{first} div {SLICE}"), (last / SLICE).cast("long")))


def checksum(conv_id: Column) -> Column:
    """Turns that a conversation shares: the checksum of its decimal id modulo SHARES."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SHARES)).cast("int")


def _lanes(digest: Column, *names: str) -> list[Column]:
    """The first 64 bits of a hexadecimal digest, the next, and so on."""
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long").alias(n) for i, n in enumerate(names)]


def _turns(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(conv_id, at, u, v, bytes): turns in order, role and text as a digest of 128 bits.

    Turns of one conversation that have the same number go in the order of their digests.
    """
    role, text = (F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8") for c in ("role", "text"))
    size = F.octet_length(role).cast("string").cast("binary")
    digest = F.sha2(F.concat(size, F.lit(":").cast("binary"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest")]
    # equal rows are interchangeable, so that the order is as good as total
    return numbered(scratch, rows, *order, number="at").select("conv_id", "at", "bytes", *_lanes(F.col("digest"), "u", "v"))


def _conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, first, n, base, shares, shared): where the turns of each conversation are, and what it shares."""
    own = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "shares": checksum(F.col("conv_id"))})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    shared = F.least(F.coalesce("_n", F.lit(0)), F.col("shares")).cast("int")
    return own.join(bases, "base", "left").withColumn("shared", shared).drop("_n")


def rebuilt(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth from 1, u, v, bytes), and all conversations with their length.

    A conversation's own turns find it by slices, so a very long one is many small groups.
    """
    turns = _turns(scratch, conversations)
    info = scratch.table(_conversations(turns), "conversations")
    sliced = info.withColumn("_slice", _slices_of("first", "n"))
    placed = turns.withColumn("_slice", F.expr(f"at div {SLICE}")).join(sliced, ["conv_id", "_slice"])
    place = F.col("at") - F.col("first")
    own = placed.where(place >= F.col("shares")).select(
        "conv_id", (F.col("shared") + place - F.col("shares") + 1).alias("depth"), "u", "v", "bytes"
    )
    # the few first turns of a base go to each of its family
    lead = placed.where((place < SHARES - 1) & (F.col("base") == F.col("conv_id"))).select(
        "base", place.alias("place"), "u", "v", "bytes"
    )
    family = info.where("shares > 0").select("base", F.col("conv_id").alias("_conv"), "shares")
    given = lead.join(family, "base").where("place < shares").select(
        F.col("_conv").alias("conv_id"), (F.col("place") + 1).alias("depth"), "u", "v", "bytes"
    )
    length = F.col("shared") + F.greatest(F.col("n") - F.col("shares"), F.lit(0))
    return scratch.table(own.unionByName(given), "rebuilt"), info.select("conv_id", length.alias("length"))


def _prefixes(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """Rebuilt turns with (x, y) of their first turns, and (up_x, up_y) without the last one.

    A sequence has the combination of digests that hold their place in it: 128 bits, whose
    equality is verified node by node afterwards.
    """
    placed = F.sha2(F.concat_ws(":", "depth", "u", "v").cast("binary"), 256)
    rows = turns.withColumn("_placed", placed).select("*", *_lanes(F.col("_placed"), "_x", "_y")).drop("_placed")
    rows = rows.withColumn("_at", F.col("depth") - 1)
    run = running(scratch, rows, ["conv_id"], "_at", {"x": "_x", "y": "_y"}, F.bit_xor)
    up = {f"up_{c}": F.col(c).bitwiseXOR(F.col(f"_{c}")) for c in "xy"}
    return run.withColumns(up).drop("_x", "_y", "_at")


def _nodes(scratch: Scratch, prefixes: DataFrame, all_convs: DataFrame) -> DataFrame:
    """One row per node, its conv_id the smallest member; the root has depth 0 and no bytes."""
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("bytes").alias("bytes"),
        F.min("up_x").alias("up_x"),
        F.min("up_y").alias("up_y"),
        reduce(and_, [F.min(c) == F.max(c) for c in ("u", "v", "bytes", "up_x", "up_y")]).alias("one"),
    )
    zero = F.lit(0).cast("long")
    root = all_convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("bytes"),
        F.lit(None).cast("long").alias("up_x"), F.lit(None).cast("long").alias("up_y"), F.lit(True).alias("one"),
    )
    nodes = scratch.table(nodes.unionByName(root), "nodes")
    if nodes.where("NOT one").limit(1).count():
        raise RuntimeError("different sequences of turns have equal digests")
    return nodes.drop("one")


def _family(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Nodes numbered so that siblings follow each other, with what they need to know of their relatives.

    id; first and n_children (of the children's ids); parent_id, parent_conv_id; is_first and
    is_last among siblings.  Children find their parent by slices of ids.
    """
    order = [F.col("depth"), F.asc_nulls_first("up_x"), F.asc_nulls_first("up_y"), F.col("x"), F.col("y")]
    placed = numbered(scratch, nodes, *order, number="id")
    below = (
        placed.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_children"))
    )
    parents = scratch.table(placed.join(below, [*NODE], "left").fillna({"n_children": 0}), "parents")
    sliced = parents.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"),
        F.col("x").alias("up_x"),
        F.col("y").alias("up_y"),
        F.col("id").alias("parent_id"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("first").alias("_first"),
        F.col("n_children").alias("_n"),
        _slices_of("first", "n_children").alias("_slice"),
    )
    child = parents.withColumn("_slice", F.expr(f"id div {SLICE}"))
    related = child.join(sliced, ["depth", "up_x", "up_y", "_slice"], "left")
    related = related.withColumns(
        {"is_first": F.col("id") == F.col("_first"), "is_last": F.col("id") == F.col("_first") + F.col("_n") - 1}
    )
    return scratch.table(related.drop("_slice", "_first", "_n", "up_x", "up_y"), "family")


def _arcs(family: DataFrame) -> DataFrame:
    """(arc, before, after) of the tour: arc 2i enters node i, arc 2i+1 leaves it; null at both ends.

    Every link is known at one of the nodes it joins or at their parent: siblings have
    consecutive ids.
    """
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    leaf = F.col("n_children") == 0
    # before a first child its parent is entered, before another one the sibling is left
    into = F.when(F.col("is_first"), F.col("parent_id") * 2).when(F.col("parent_id").isNotNull(), enter - 1)
    out = F.when(F.col("is_last"), F.col("parent_id") * 2 + 1).when(F.col("parent_id").isNotNull(), leave + 1)
    down = F.when(leaf, leave).otherwise(F.col("first") * 2)
    back = F.when(leaf, enter).otherwise((F.col("first") + F.col("n_children") - 1) * 2 + 1)
    arcs = F.array(
        F.struct(enter.alias("arc"), into.alias("before"), down.alias("after")),
        F.struct(leave.alias("arc"), back.alias("before"), out.alias("after")),
    )
    return family.select(F.inline(arcs))


def _removable() -> Column:
    """Arcs whose hash is below those of both neighbours: never two in a row, and about a third."""
    h = [F.xxhash64(F.col(c), F.col("turn")) for c in ("arc", "before", "after")]
    return F.col("before").isNotNull() & F.col("after").isNotNull() & (h[0] < h[1]) & (h[0] < h[2])


def ranked(scratch: Scratch, arcs: DataFrame, at_once: int = RANKED_AT_ONCE) -> DataFrame:
    """(arc, rank): places in a doubly linked list, from 0.

    Rounds take out arcs between two others, a third of them each, and link their
    neighbours over the gap; the rest, of bounded number, is followed in one task.  Then
    the arcs come back in reverse order, each behind the one that was before it.  Hence all
    rounds together move a few times the list.
    """
    now = scratch.table(arcs.withColumn("step", F.lit(1).cast("long")), "arcs")  # step: from `before` to the arc
    removed = []
    while now.count() > at_once:
        marked = now.withColumn("turn", F.lit(len(removed))).withColumn("_out", _removable()).drop("turn")
        marked = scratch.table(marked, "marked")
        gone = marked.where("_out")
        stay = marked.where("NOT _out").select("arc", "before", "after", "step", F.lit(0).alias("_news"))
        none = F.lit(None).cast("long")
        # both neighbours of an arc that goes stay
        ahead = gone.select(F.col("after").alias("arc"), "before", none.alias("after"), "step", F.lit(1).alias("_news"))
        behind = gone.select(F.col("before").alias("arc"), none.alias("before"), "after", none.alias("step"), F.lit(2).alias("_news"))
        told = stay.unionByName(ahead).unionByName(behind).groupBy("arc").agg(
            F.coalesce(F.max(F.when(F.col("_news") == 1, F.col("before"))), F.max(F.when(F.col("_news") == 0, F.col("before")))).alias("before"),
            F.coalesce(F.max(F.when(F.col("_news") == 2, F.col("after"))), F.max(F.when(F.col("_news") == 0, F.col("after")))).alias("after"),
            F.sum(F.when(F.col("_news") < 2, F.col("step"))).alias("step"),
        )
        removed.append(gone.select("arc", "before", "step"))
        now = scratch.table(told, "arcs")
    ranks = scratch.table(now.repartition(1).mapInArrow(_follow, "arc long, rank long"), "ranks")
    for gone in reversed(removed):
        ahead = ranks.select(F.col("arc").alias("before"), "rank")
        back = gone.join(ahead, "before").select("arc", (F.col("rank") + F.col("step")).alias("rank"))
        ranks = scratch.table(ranks.unionByName(back), "ranks")
    return ranks


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a short list: its arcs one after the other."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([(c, pa.int64()) for c in ("arc", "before", "after", "step")]))
    arcs, steps = (table.column(c).to_numpy() for c in ("arc", "step"))
    after = table.column("after").fill_null(-1).to_numpy()
    first = np.flatnonzero(table.column("before").is_null().to_numpy())
    index = dict(zip(arcs.tolist(), range(len(arcs))))
    ranks = np.zeros(len(arcs), np.int64)
    at = int(first[0]) if len(first) else None
    rank = 0
    while at is not None:
        ranks[at] = rank
        at = index.get(int(after[at]))
        rank += int(steps[at]) if at is not None else 0
    yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(ranks)], names=["arc", "rank"])


def _subtrees(scratch: Scratch, family: DataFrame, at_once: int) -> DataFrame:
    """(id, n_leaves, saved_tokens): sums over subtrees, as differences of prefix sums at the two arcs."""
    ranks = ranked(scratch, _arcs(family), at_once)
    worth = family.select(
        (F.col("id") * 2).alias("arc"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    tour = ranks.join(worth, "arc", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in ("leaf", "saved")})
    # one list: no key but the place in it
    sums = running(scratch, scratch.table(tour, "tour"), [], "rank", {"leaves": "leaf", "total": "saved"}, F.sum)
    entered = F.col("arc") % 2 == 0

    def over(total: str, own: str) -> Column:
        return F.sum(F.when(entered, F.col(own) - F.col(total)).otherwise(F.col(total)))

    return sums.groupBy(F.expr("arc div 2").alias("id")).agg(
        over("leaves", "leaf").alias("n_leaves"), over("total", "saved").alias("saved_tokens")
    )


def _ends(scratch: Scratch, prefixes: DataFrame, all_convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end.

    Ids are joined to strings of up to SLICE of them; one task then digests the strings of a
    node as they stream by.
    """
    last = prefixes.join(all_convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*NODE, "conv_id")
    zero = F.lit(0).cast("long")
    empty = all_convs.where("length = 0").select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id")
    placed = numbered(scratch, last.unionByName(empty), *NODE, "conv_id", number="at")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = placed.groupBy(*NODE, F.expr(f"at div {SLICE}").alias("_slice")).agg(ids.alias("ids"))
    dealt = strings.repartition(*NODE).sortWithinPartitions(*NODE, "_slice")
    return dealt.mapInArrow(_digested, "depth long, x long, y long, ends_sha256 string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for consecutive strings of a node, a string at a time."""
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if (depth, x, y) == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, x, y), hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield _digests(done)
    if node is not None:
        yield _digests([(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])


def conversation_trie(conversations: DataFrame, at_once: int = RANKED_AT_ONCE) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Turns go by number, null first, and where numbers are equal by the SHA-256 of role and
    text; null role or text is empty, rows without conv_id are left out.  A conversation c
    becomes the first h turns of conversation c - c%5 (truncated, as SQL's %), h being the
    CRC-32 of its decimal id modulo 9, and its own turns from the h-th on.  Every sequence of
    first turns is a node, the root among them; conversations that begin with it are members.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree,
    members but one times UTF-8 bytes of the last text), ends_sha256 (of the ids that end
    here, in numerical order, joined by commas).  Repeated rows are turns of their own; no
    rows give none; other columns are left behind.
    """
    with Scratch(conversations.sparkSession) as scratch:
        turns, all_convs = rebuilt(scratch, conversations)
        prefixes = scratch.table(_prefixes(scratch, turns), "prefixes")
        family = _family(scratch, _nodes(scratch, prefixes, all_convs))
        subtrees = _subtrees(scratch, family, at_once)
        ends = _ends(scratch, prefixes, all_convs)
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        nodes = family.join(subtrees, "id").join(ends, [*NODE], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
        return scratch.result(nodes, "trie")


#: The same rows in SQL: prefixes as lists, subtrees by a join of every node with those above it.
ORACLE = """
WITH t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
sums AS (SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                lambda u, k: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
    FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
convs AS MATERIALIZED (SELECT s.c, s.n, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS shared
    FROM sums s LEFT JOIN sums b ON b.c = s.base),
turns AS (SELECT k.c, t.p AS d, role, text FROM convs k JOIN t ON t.c = k.base AND t.p <= k.h
    UNION ALL SELECT k.c, k.shared + t.p - k.h, role, text FROM convs k JOIN t ON t.c = k.c AND t.p > k.h),
prefixes AS MATERIALIZED (SELECT c, d, strlen(text) AS bytes,
        list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS k FROM turns),
nodes AS MATERIALIZED (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY d, k
    UNION ALL SELECT 0, NULL, min(c), count(*), 0 FROM convs HAVING count(*) > 0),
members AS MATERIALIZED (SELECT p.c, p.d, n.conv_id FROM prefixes p JOIN nodes n ON p.d = n.d AND p.k = n.k
    UNION ALL SELECT c, 0, (SELECT min(c) FROM convs) FROM convs),
parents AS MATERIALIZED (SELECT n.conv_id, n.d, n.n_convs, n.bytes, m.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN members m ON m.c = n.conv_id AND m.d = n.d - 1),
children AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY 1, 2),
whole AS MATERIALIZED (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (conv_id, d)),
subtrees AS (SELECT m.conv_id, m.d, count_if(w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
    FROM whole w JOIN members m ON m.c = w.conv_id AND m.d <= w.d GROUP BY 1, 2),
ends AS (SELECT m.conv_id, m.d, string_agg(k.c::VARCHAR, ',' ORDER BY k.c) AS ids
    FROM convs k JOIN members m ON m.c = k.c AND m.d = k.shared + greatest(k.n - k.h, 0) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, w.parent_conv_id, w.n_convs, w.n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN subtrees USING (conv_id, d) LEFT JOIN ends USING (conv_id, d)
"""
