"""URL lists as cascades of Bloom filters: exact for every key of the corpus, without joins."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch, U, mixed

#: Bits and hash functions per encoded key.
BITS_PER_KEY, HASHES = 12, 6
#: Listed keys in one cascade; a longer list becomes several, applied one after the other,
#: so that none of them (about 2 MB per million keys) grows with the list.
KEYS_PER_CASCADE = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REPORT = "page_id long, host string, path string, rule string, verdict string"


class Level(NamedTuple):
    """One filter; `depth` makes its hash functions others than those of the level before."""

    words: np.ndarray
    bits: int
    depth: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys the filter seems to hold."""
        held = np.ones(len(h1), bool)
        for at in positions(h1, h2, self.bits, self.depth):
            held &= (self.words[at >> 6] >> (at & 63).astype(U)) & U(1) != 0
        return held


def positions(h1: np.ndarray, h2: np.ndarray, bits: int, depth: int) -> Iterator[np.ndarray]:
    salt = U((depth + 1) * 0x9E3779B97F4A7C15 % 2**64)
    a, b = mixed(h1.view(U) + salt), mixed(h2.view(U) ^ salt) | U(1)
    for k in range(HASHES):
        yield ((a + U(k) * b) % U(bits)).astype(np.int64)


class Cascade:
    """Levels by turns of listed keys and of unlisted ones that all levels before hold.

    The first level that doesn't hold a key decides; a key that all levels hold is on the
    side of the last one, as that has no false positives left in the corpus.
    """

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        verdict = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            held = level.holds(h1[open_], h2[open_])
            verdict[open_[~held]] = i % 2 == 1
            open_ = open_[held]
        return verdict


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def _encoded(keys: DataFrame, depth: int) -> Level | None:
    """A filter of keys (h1, h2), or-ed together by Spark; None if there are none."""
    n = keys.count()
    if not n:
        return None
    bits = max(1024, n * BITS_PER_KEY)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.unique(np.concatenate(list(positions(h1, h2, bits, depth))))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    parts = keys.select("h1", "h2").where("h1 IS NOT NULL").mapInArrow(words, "word long, value long")
    out = np.zeros(bits // 64 + 1, U)
    # at most BITS_PER_KEY * KEYS_PER_CASCADE bits
    for r in parts.groupBy("word").agg(F.bit_or("value").alias("value")).toLocalIterator():
        out[r.word] = r.value & (2**64 - 1)
    return Level(out, bits, depth)


def _still_held(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            yield batch.filter(pa.array(shared.value.holds(h1, h2)))

    return keys.mapInArrow(held, keys.schema)


def build_cascade(scratch: Scratch, listed: DataFrame, unlisted: DataFrame) -> Cascade:
    """Cascade over two disjoint sets of keys (h1, h2)."""
    inside, outside = listed, unlisted
    levels: list[Level] = []
    while (level := _encoded(inside, len(levels))) is not None:
        levels.append(level)
        inside, outside = scratch.table(_still_held(outside, level), "false-positives"), inside
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    host = F.translate(part(r"(?s)^.*?://([^/?#]*)"), _UPPER, _LOWER)
    return host, part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def _candidates(labels: list[int], lengths: list[int]) -> Column:
    """Keys of a page that could be listed, longest first, then by the longer host."""
    host, path = F.col("host"), F.col("path")
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = []
    for d in labels:
        suffix = F.substring_index(host, ".", -d)
        for n in lengths:
            key = F.concat(suffix, F.substring(path, 1, n))
            fits = (host != "") & (n_labels >= d) & (F.length(path) >= n)
            keys.append(F.when(fits, F.struct(F.length(key).alias("n"), F.length(suffix).alias("h"), key.alias("key"))))
    some = F.filter(F.array(*keys), lambda k: k.isNotNull())
    return F.transform(F.sort_array(some, asc=False), lambda k: k["key"])


def judged_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Per page: host, path, the longest rule that fits, and the verdict.

    pages needs page_id and url, rules host, path and verdict (allow or block); other
    columns are not read.  A rule fits its host and all subdomains, if the path starts with
    the rule's.  A key is a host suffix with a path prefix, in the numbers of labels and
    path lengths that rules have.  Two cascades, of allow and of block rules, encode the
    listed keys against all keys of the corpus.  Null urls and such without `://` have empty
    parts and fit no rule; they and all others without a rule get `otherwise`, as no list
    has them.  A key listed with both verdicts is blocked.  Rules with nulls are left out,
    repeated rules count once, repeated pages each get their row.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    shape = rules.select(
        F.collect_set(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    host, path = url_parts(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape.labels:
        return keyed.select(F.col("page_id").cast("long"), "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(otherwise).alias("verdict"))
    keys = _candidates(sorted(shape.labels), sorted(shape.lengths))
    keyed = keyed.withColumn("keys", keys)
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    listed = listed.select("verdict", "key", *[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)])
    with Scratch(spark) as scratch:
        corpus = keyed.select(F.explode("keys").alias("key")).distinct()
        corpus = corpus.select("key", *[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)])
        corpus, listed = scratch.table(corpus, "keys"), scratch.table(listed, "listed")
        parts = -(-listed.count() // KEYS_PER_CASCADE)
        cascades = []
        for verdict in ("block", "allow"):
            for p in range(parts):
                own = listed.where((F.col("verdict") == verdict) & (F.pmod("h1", F.lit(parts)) == p))
                rest = corpus.where(F.pmod("h1", F.lit(parts)) == p).join(own.select("key"), "key", "left_anti")
                cascade = build_cascade(scratch, own.select("h1", "h2"), rest.select("h1", "h2"))
                cascades.append((verdict, p, parts, spark.sparkContext.broadcast(cascade)))
    hashed = keyed.select(
        F.col("page_id").cast("long"), "host", "path", "keys",
        F.transform("keys", lambda k: _hashes(k)[0]).alias("h1"),
        F.transform("keys", lambda k: _hashes(k)[1]).alias("h2"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy()
            first = int(offsets[0])
            flat, h1, h2 = (batch.column(i).flatten() for i in (3, 4, 5))
            h1, h2 = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
            which = np.full(len(h1), "", object)
            for verdict, p, n, cascade in cascades:
                own = np.flatnonzero((h1 % n == p) & (which == ""))
                which[own[cascade.value.listed(h1[own], h2[own])]] = verdict
            hit = np.flatnonzero(which != "")
            row = np.searchsorted(offsets - first, hit, side="right") - 1
            row, at = np.unique(row, return_index=True)  # the first is the longest
            rule = np.full(batch.num_rows, None, object)
            said = np.full(batch.num_rows, otherwise, object)
            rule[row] = flat.take(pa.array(hit[at])).to_pylist()
            said[row] = which[hit[at]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(said, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return hashed.mapInArrow(judge, REPORT)
