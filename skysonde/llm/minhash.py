"""Near-duplicates: MinHash bands, signature and full-set checks, connected components."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch, U, Texts, mixed, small_batches, text_chunks, word_table, words
from skysonde.llm.components import component_labels

SHINGLE_WORDS = 4
#: Two sets are linked from this percentage of their union on.
PERCENT = 80
#: 28 bands of 4 minima: a pair at 80 % shares no band once in 2.6 million times.
BANDS, ROWS = 28, 4
#: Signatures must agree in so many of their 112 places (of 90 expected at 80 %; five
#: standard deviations of 4.2 below).
LEAST_EQUAL = 69
#: A document that shares so many buckets with a lead is checked against it first.  That
#: only saves work: pairs it doesn't join are found in the blocks of their groups.
LEAST_SHARED = 4
#: Followers of a lead that one group has; more are dealt to several.
FOLLOWERS = 512
#: Members of a bucket group that are compared in one piece; larger groups are cut.
BLOCK = 1024
SUMMARY = "doc_id long, n_shingles long, set_key binary, signature binary"
#: Everything but ASCII white space makes words.
WORD_BYTES = word_table([0x20, range(0x09, 0x0E)])

_rng = np.random.RandomState(20)
_MUL = (_rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(chunk: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; fewer words than `size` make one."""
    found = words(chunk, WORD_BYTES)
    s = found.symbol
    joined = s.copy()
    for k in range(1, size):
        joined *= U(0xD6E8FEB86659FD93)
        joined[: max(len(s) - k, 0)] += s[k:]
    joined = mixed(joined)
    sets = []
    first = 0
    for n in found.per_row.tolist():
        if n >= size:
            sets.append(np.unique(joined[first : first + n - size + 1]))
        elif n:
            h = U(0)
            with np.errstate(over="ignore"):
                for x in s[first : first + n]:
                    h = h * U(0xD6E8FEB86659FD93) + x
            sets.append(mixed(np.array([h ^ U(n)], U)))
        else:
            sets.append(np.zeros(0, U))
        first += n
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the universal hash functions over each non-empty set, a row per set."""
    size = np.array([len(x) for x in sets])
    out = np.zeros((len(sets), BANDS * ROWS), np.uint32)
    some = np.flatnonzero(size)
    if len(some):
        keys = (np.concatenate([sets[i] for i in some]) >> U(32)).astype(np.uint32)
        begin = np.cumsum(size[some]) - size[some]
        for k in range(BANDS * ROWS):
            out[some, k] = np.minimum.reduceat(keys * _MUL[k] + _ADD[k], begin)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band and row; the band is part of it."""
    pairs = signature.reshape(len(signature), BANDS, ROWS // 2, 2).astype(U)
    joined = (pairs[..., 0] << U(32)) | pairs[..., 1]
    h = np.arange(BANDS, dtype=U)[None, :] + U(1)
    for k in range(ROWS // 2):
        h = mixed(h * U(0x9E3779B97F4A7C15) + joined[:, :, k])
    return h.view(np.int64)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(1), 2 << 20):
            sets = shingle_sets(chunk, SHINGLE_WORDS)
            signature = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.first, chunk.last - chunk.first).cast(pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(1), 2 << 20):
            sets = shingle_sets(chunk, SHINGLE_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.first, chunk.last - chunk.first),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                names=["doc", "shingles"],
            )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            raw = b"".join(part.column(1).to_pylist())
            keys = band_keys(np.frombuffer(raw, np.uint32).reshape(part.num_rows, -1))
            docs = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(docs)], names=["bucket", "doc"])


def _similar(signature: np.ndarray, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many places of the signatures agree, for rows `mine` against rows `others`."""
    equal = np.zeros((len(mine), len(others)), np.int16)
    for k in range(signature.shape[1]):
        equal += signature[mine, k][:, None] == signature[others, k][None, :]
    return equal


def _slabs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a block that aren't joined yet, with the places of their signatures that agree.

    Members of the rest of a group meet members of all of it; those of one label are joined.
    """
    signature = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(len(pdf), -1)
    rest, label = pdf["rest"].to_numpy(bool), pdf["label"].to_numpy()
    left, right = np.flatnonzero(rest), np.flatnonzero(~rest)
    for first in range(0, len(left), 256):
        mine = left[first : first + 256]
        equal = _similar(signature, mine, right)
        equal[label[mine][:, None] == label[right][None, :]] = 0
        yield mine, right, equal


def _with_partner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of a block whose signature agrees with that of a member of another label."""
    alive = np.zeros(len(pdf), bool)
    for mine, others, equal in _slabs(pdf):
        near = equal >= LEAST_EQUAL
        alive[mine[near.any(axis=1)]] = True
        alive[others[near.any(axis=0)]] = True
    return pdf.loc[alive, ["lead", "doc", "label"]]


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block, checked on the full sets, that join labels that aren't joined yet.

    Pairs are tried by falling agreement of the signatures; pairs that are connected through
    their labels and links already found are not tried.
    """
    labels, node = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    root = list(range(len(labels)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tried = [np.zeros((3, 0), np.int64)]
    for mine, others, equal in _slabs(pdf):
        x, y = np.nonzero(equal >= LEAST_EQUAL)
        tried.append(np.stack((equal[x, y].astype(np.int64), mine[x], others[y])))
    tried = np.concatenate(tried, axis=1)
    docs, shingles, node = pdf["doc"].to_numpy(), pdf["shingles"].to_numpy(), node.tolist()
    a, b = [], []
    for x, y in tried[1:, np.argsort(-tried[0], kind="stable")].T.tolist():
        p, q = find(node[x]), find(node[y])
        if p != q and _alike(shingles[x], shingles[y]):
            root[p] = q
            a.append(docs[x])
            b.append(docs[y])
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _alike(one: bytes, other: bytes) -> bool:
    """Whether two sets, each sorted, have PERCENT of their union in common."""
    few, many = sorted((np.frombuffer(one, U), np.frombuffer(other, U)), key=len)
    if not len(few):
        return False
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * both >= PERCENT * (len(few) + len(many) - both)


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Give each (lead, doc, label) the blocks (i, j) of its group that it must be in.

    Groups of one label have nothing to find.  In the others the members of all labels but
    the most frequent one are the rest, and only pairs with one of them can join labels: all
    members are cut into parts by hash, the rest likewise, and every part of the one meets
    every part of the other.  So a group of n members with r in its rest is copied
    n * r / block rows' worth; a group whose rest fits one block is copied once.
    """
    per_label = members.groupBy("lead", "label").agg(F.count("*").alias("n"))
    groups = per_label.groupBy("lead").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", F.col("label").alias("main"))).alias("top")
    )
    cut = groups.where(F.col("n") > F.col("top.n")).select(
        "lead",
        F.col("top.main").alias("main"),
        F.ceil(F.col("n") / block).cast("int").alias("parts"),
        F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("rest_parts"),
    )
    own = members.join(cut, "lead").withColumn("_hash", F.xxhash64("doc"))

    def met(part: str, others: str, rest: bool) -> DataFrame:
        mine = F.pmod("_hash", F.col(part)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        i, j = (theirs.alias("i"), mine.alias("j")) if rest else (mine.alias("i"), theirs.alias("j"))
        rows = own.where(F.col("label") != F.col("main")) if rest else own
        return rows.select("lead", "doc", "label", F.lit(rest).alias("rest"), i, j)

    return met("parts", "rest_parts", False).unionByName(met("rest_parts", "parts", True))


def _sets_of(scratch: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, shingles) of the documents of (doc), made from their texts.

    The ids are a table, whose size is known: while it is small it goes to the texts, and
    else the texts go to it.
    """
    ids = scratch.table(wanted.distinct(), "wanted")
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(ids, "doc", "left_semi")
    return texts.mapInArrow(_full_sets, "doc long, shingles binary")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, mine, theirs) whose sets are alike."""
    for batch in batches:
        mine, theirs = batch.column("mine"), batch.column("theirs")
        near = pa.array([_alike(x.as_py(), y.as_py()) for x, y in zip(mine, theirs)], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def _with_leads(scratch: Scratch, docs: DataFrame, followers: DataFrame) -> DataFrame:
    """Links (a, b) of documents b with the lead a they share most buckets with, checked on the full sets.

    The set of each document goes there once; a lead of many is copied, and they are dealt.
    """
    found = followers.where(F.col("n") >= LEAST_SHARED).groupBy("doc").agg(
        F.max_by("lead", F.struct(F.col("n"), -F.col("lead"))).alias("lead")
    )
    best = scratch.table(found, "best")
    deals = F.ceil(F.count("*") / FOLLOWERS).cast("int")
    hot = scratch.table(best.groupBy("lead").agg(deals.alias("deals")).where("deals > 1"), "hot")
    own = F.pmod(F.xxhash64("doc"), F.coalesce("deals", F.lit(1))).cast("int")
    dealt = best.join(hot, "lead", "left").select("lead", "doc", own.alias("deal"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))
    leads = best.select("lead").distinct().join(hot, "lead", "left").select("lead", copies.alias("deal"))
    sets = _sets_of(scratch, docs, best.select("doc").union(best.select(F.col("lead").alias("doc"))))
    mine = dealt.join(sets, "doc").select("lead", "deal", "doc", F.col("shingles").alias("mine"))
    theirs = leads.join(sets, F.col("lead") == F.col("doc")).select("lead", "deal", F.col("shingles").alias("theirs"))
    pairs = mine.join(theirs, ["lead", "deal"]).select(F.col("lead").alias("a"), F.col("doc").alias("b"), "mine", "theirs")
    return pairs.mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: set size, component of near-duplicates, and whether it stays.

    docs needs doc_id (long) and text; other columns are not read.  Null or empty texts
    have an empty set and are linked with nothing.  Rows that share a doc_id count as one
    document with several texts: they are one node, and each gets its row.  Rows without
    doc_id stand alone: component_id null, kept.  Equal sets are one class, represented by
    its least doc_id, so copies are never paired with each other.  An empty table gives no rows.

    1. One pass makes set sizes, set keys and signatures.  2. Classes are dealt to one
    bucket per band; a bucket is led by its least member, and all that share a bucket
    with a lead are its group, so every pair that shares a bucket is in some group.
    3. Every document is checked against the lead it shares most buckets with; what is
    linked so has one label.  4. Groups that still hold several labels go to blocks, where
    members without a partner of like signature and another label drop out; the rest get
    their full sets and are checked in blocks, which yield links between labels, never all
    pairs.  5. Components of links and copies.
    """
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.table(small_batches(docs).select("doc_id", "text").mapInArrow(_summary, SUMMARY), "signatures")
        real = known.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
        grouped = real.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"))
        classes = scratch.table(grouped, "classes")
        followers = scratch.table(_followers(classes), "followers")
        joined = scratch.table(_with_leads(scratch, docs, followers), "joined")
        labels = component_labels(joined, scratch)
        near = scratch.table(_like_signatures(classes, _labelled(followers, labels), block), "near")
        blocks = _in_blocks(near, block).join(classes.select("doc", "signature"), "doc")
        sized = blocks.join(_sets_of(scratch, docs, near.select("doc")), "doc")
        links = sized.groupBy("lead", "i", "j").applyInPandas(_links, "a long, b long")
        copies = real.select("doc_id", "set_key").join(classes.select("set_key", "doc"), "set_key")
        copies = copies.where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
        labels = component_labels(joined.union(links).union(copies), scratch)
        out = known.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("node"), "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return scratch.result(out.withColumn("kept", F.expr("doc_id <=> component_id")), "near-duplicates")


def _followers(classes: DataFrame) -> DataFrame:
    """(lead, doc, n): documents in buckets of a lead, and in how many."""
    dealt = classes.select("doc", "signature").mapInArrow(_buckets, "bucket long, doc long")
    leads = dealt.groupBy("bucket").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last")
    return dealt.join(leads, "bucket").where("doc <> lead").groupBy("lead", "doc").agg(F.count("*").alias("n"))


def _labelled(followers: DataFrame, labels: DataFrame) -> DataFrame:
    """(lead, doc, label) of all groups, the leads among their members."""
    led = followers.select("lead", F.col("lead").alias("doc")).distinct()
    members = followers.select("lead", "doc").union(led)
    found = members.join(labels, F.col("doc") == F.col("node"), "left")
    return found.select("lead", "doc", F.coalesce("component", "doc").alias("label"))


def _like_signatures(classes: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(lead, doc, label) of documents with a partner of like signature and another label in the group."""
    blocks = _in_blocks(members, block).join(classes.select("doc", "signature"), "doc")
    return blocks.groupBy("lead", "i", "j").applyInPandas(_with_partner, "lead long, doc long, label long").distinct()


def without_near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents, all columns as they are, that stay: one of each component.

    Of rows that repeat a doc_id that stays, all stay.
    """
    gone = near_duplicates(docs, block).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
