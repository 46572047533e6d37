"""Repeated byte strings by interval expansion on Burrows-Wheeler transforms."""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import POWERS, Scratch, U, mixed, small_batches, text_chunks

LENGTH = 50
#: Strings are dealt out by the least hash among their substrings of so many bytes.
SEED = 24
#: Bytes of text in a shard, hashed at a time, and transformed at a time.
SHARD_BYTES, PIECE_BYTES, TRANSFORM_BYTES = 4 << 20, 512 << 10, 256 << 10
#: Shards of text for each bucket of seeds.
SHARDS_PER_BUCKET = 1
SHARDS = "doc_ids binary, sizes binary, text binary"
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_NO_ID = np.int64(2**63 - 1)  # a document without id is later than all others


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal place together compress better."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return zstandard.compress(flat.T.tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


class Runs(NamedTuple):
    """Runs of window starts in a shard whose windows share their seed.

    The windows of start..start+count-1 all hold the seed; `seed` is its hash, `content`
    that of the run's whole string, which is count + length - 1 bytes long.
    """

    start: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    content: np.ndarray


def _runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """Runs of a piece; every window of `length` bytes inside a text is in one run."""
    n = len(data)
    windows = length - SEED + 1
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    seeds = mixed((total[SEED:] - total[:-SEED]) * down[: n - SEED + 1])
    place = (1 << 32) - 1  # the same share of the hash decides everywhere
    least = (seeds & ~U(place)) | np.arange(len(seeds), dtype=U)  # of equal hashes the leftmost
    have = 1
    while have < windows:
        step = min(have, windows - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & U(place)).astype(np.int64)
    # windows that reach over the end of their text don't count
    valid = np.ones(len(at) + 1, bool)
    for end in offsets[1:].tolist():
        valid[max(end - length + 1, 0) : end] = False
    valid[len(at) :] = False
    valid = valid[: len(at)]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + length  # of the string
    content = mixed((total[end] - total[start]) * down[start] ^ (end - start).astype(U) << U(40))
    # least hashes are small numbers; mixed again they spread evenly over buckets
    return Runs(start, end - length + 1 - start, mixed(seeds[at[start]]), content)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Runs:
    """Runs of a whole shard, made piece by piece of whole texts."""
    parts = []
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = max(last, first + 1)
        begin = offsets[first]
        if offsets[last] - begin >= length:
            own = _runs_of(data[begin : offsets[last]], offsets[first : last + 1] - begin, length)
            parts.append(own._replace(start=own.start + begin))
        first = last
    if not parts:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _bucket(seed: np.ndarray, n: int) -> np.ndarray:
    return ((seed >> U(32)) * U(n) >> U(32)).astype(np.int64)


class Shard(NamedTuple):
    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, doc_ids: bytes, sizes: bytes, text: bytes) -> "Shard":
        size = np.frombuffer(sizes, np.int64)
        raw = np.frombuffer(zstandard.decompress(text), np.uint8)
        return cls(np.frombuffer(doc_ids, np.int64), np.concatenate(([0], np.cumsum(size))), raw)


def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sizes, texts, held = [], [], [], 0

    def shard() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()),
                pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()),
            ],
            names=["doc_ids", "sizes", "text"],
        )

    for batch in batches:
        for chunk in text_chunks(batch.column(1)):
            own = batch.column(0).slice(chunk.first, chunk.last - chunk.first).cast(pa.int64()).fill_null(_NO_ID)
            ids.append(own.to_numpy(zero_copy_only=False))
            sizes.append(np.diff(chunk.offsets))
            texts.append(chunk.data.tobytes())
            held += len(texts[-1])
            if held >= SHARD_BYTES:
                yield shard()
                ids, sizes, texts, held = [], [], [], 0
    if ids:
        yield shard()


def _seen_seeds(n_buckets: int, length: int):
    """Of each shard and bucket the different seeds, and which of them it has twice."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row["doc_ids"], row["sizes"], row["text"])
                seed, count = np.unique(runs(shard.data, shard.offsets, length).seed, return_counts=True)
                bucket = _bucket(seed, n_buckets)
                edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = np.flatnonzero(edge[1:] > edge[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array(np.full(len(some), row["shard"]), pa.int64()),
                        pa.array([_packed(np.diff(seed[edge[b] : edge[b + 1]], prepend=U(0))) for b in some], pa.binary()),
                        pa.array([np.packbits(count[edge[b] : edge[b + 1]] > 1).tobytes() for b in some], pa.binary()),
                    ],
                    names=["bucket", "shard", "seeds", "twice"],
                )

    return seen


def _repeated_seeds(table: pa.Table) -> pa.Table:
    """For each shard of a bucket, a bit for each of its seeds that there are two of anywhere."""
    rows = table.to_pylist()
    seeds = [np.cumsum(_unpacked(r["seeds"], "<u8"), dtype=U) for r in rows]
    twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(s)) for r, s in zip(rows, seeds, strict=True)]
    unique, place, count = np.unique(np.concatenate(seeds), return_inverse=True, return_counts=True)
    often = count > 1
    often[place[np.concatenate(twice) > 0]] = True
    bits = np.split(often[place], np.cumsum([len(s) for s in seeds])[:-1])
    return pa.table(
        {
            "bucket": table["bucket"].combine_chunks(),
            "shard": table["shard"].combine_chunks(),
            "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
        }
    )


def _repeated_strings(n_buckets: int, length: int):
    """The strings of a shard whose seed is repeated, each once, with its least document."""

    def strings(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {"bucket": [], "shard": [], "run": [], "seed": [], "content": [], "count": [], "doc": [], "text": []}
        bits = {r["bucket"]: r["bits"] for r in right.to_pylist()}
        for row in left.to_pylist():
            shard = Shard.of(row["doc_ids"], row["sizes"], row["text"])
            own = runs(shard.data, shard.offsets, length)
            seed, place = np.unique(own.seed, return_inverse=True)
            bucket = _bucket(seed, n_buckets)
            edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
            often = np.zeros(len(seed), bool)
            for b, raw in bits.items():
                often[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=edge[b + 1] - edge[b]) > 0
            at = np.flatnonzero(often[place])
            if not len(at):
                continue
            doc = shard.ids[np.searchsorted(shard.offsets, own.start[at], side="right") - 1]
            order = np.lexsort((doc, own.content[at]))
            new = np.ones(len(order), bool)
            new[1:] = own.content[at][order][1:] != own.content[at][order][:-1]
            at, doc = at[order[new]], doc[order[new]]
            order = np.argsort(own.seed[at], kind="stable")
            at, doc = at[order], doc[order]
            edge = np.searchsorted(_bucket(own.seed[at], n_buckets), np.arange(n_buckets + 1))
            for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                part = slice(edge[b], edge[b + 1])
                runs_ = at[part]
                text = _gathered(shard.data, own.start[runs_], own.count[runs_] + length - 1)
                columns["bucket"].append(b)
                columns["shard"].append(row["shard"])
                columns["run"].append(_packed(runs_.astype("<u4")))
                columns["seed"].append(_packed(np.diff(own.seed[runs_], prepend=U(0))))
                columns["content"].append(own.content[runs_].tobytes())
                columns["count"].append(_packed(own.count[runs_].astype("<u2")))
                columns["doc"].append(_packed(doc[part]))
                columns["text"].append(zstandard.compress(text.tobytes(), 3))
        return pa.table(columns, schema=_STRINGS)

    return strings


_STRINGS = pa.schema(
    [("bucket", pa.int32()), ("shard", pa.int64())] + [(n, pa.binary()) for n in ("run", "seed", "content", "count", "doc", "text")]
)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings data[start : start + size], one after the other."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return order, rank


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text in the order of their next `depth` symbols (0 behind the end)."""
    padded = np.concatenate((text, np.zeros(8, text.dtype))).astype(U)
    key = np.zeros(len(text), U)
    for k in range(7):  # nine bits a symbol
        key = (key << U(9)) | padded[k : k + len(text)]
    order, rank = _ranks(key)
    known = 7
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        order, rank = _ranks(rank * (len(rank) + 2) + later)
        known += step
    return order


def common_prefix_classes(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of a text (symbols from 1, 0 between strings) the number of its class:
    places have one class if their next `length` symbols are equal.

    An interval of the suffix order holds the places that go on with one string; extending
    the string to the left by a symbol maps the interval, through the transform, to those
    of the longer strings.  Breadth first, a border between two neighbours of the order
    comes up at the level that is the length of their common prefix: at level l + 1 the
    neighbours t - 1 and t are parted if their left-extended predecessors lie in different
    intervals of level l.  Only pairs without border are looked at, and at `length` the
    expansion stops: pairs left without one share at least that many symbols.
    """
    n = len(text)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the first place follows the last
    # in the order of (symbol, place) the transform's symbols are the first symbols
    source = np.argsort(before.astype(np.uint16), kind="stable").astype(np.int32)
    symbol = before[source]
    border = np.ones(n, bool)
    border[1:] = symbol[1:] != symbol[:-1]
    open_ = np.flatnonzero(~border)
    left, right = source[open_ - 1], source[open_]
    for _ in range(1, length):
        interval = np.cumsum(border, dtype=np.int32)
        parted = interval[left] != interval[right]
        if not parted.any():
            break
        border[open_[parted]] = True
        open_, left, right = open_[~parted], left[~parted], right[~parted]
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(border) - 1
    return classes


class Verdicts(NamedTuple):
    """Stretches of windows of unique strings with the least document that has each."""

    string: np.ndarray
    first: np.ndarray
    count: np.ndarray
    least: np.ndarray


def least_documents(text: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> Verdicts:
    """For unique strings (one after the other, count + length - 1 bytes each)."""
    size = count + length - 1
    spaced = np.zeros(len(text) + len(size), np.uint16)
    begin = np.cumsum(size + 1) - (size + 1)
    spaced[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(text))] = text.astype(np.uint16) + 1
    classes = common_prefix_classes(spaced, length)
    window = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    string = np.repeat(np.arange(len(count)), count)
    own = classes[window]
    least = np.full(int(own.max()) + 1, _NO_ID)
    np.minimum.at(least, own, doc[string])
    least = least[own]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (string[1:] != string[:-1])
    at = np.flatnonzero(new)
    return Verdicts(string[at], window[at] - begin[string[at]], np.diff(np.append(at, len(least))), least[at])


def _judged(length: int):
    """For each string of a bucket: stretches of windows and the least document of each."""

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        read = lambda name, kind: [_unpacked(r[name], kind) for r in rows]
        run, count, doc = read("run", "<u4"), read("count", "<u2"), read("doc", "<i8")
        size = [len(r) for r in run]
        seed = np.concatenate([np.cumsum(s, dtype=U) for s in read("seed", "<u8")])
        content = np.concatenate([np.frombuffer(r["content"], U) for r in rows])
        shard = np.repeat(np.arange(len(rows)), size)
        run, count, doc = np.concatenate(run), np.concatenate(count).astype(np.int64), np.concatenate(doc)
        data = np.frombuffer(b"".join(zstandard.decompress(r["text"]) for r in rows), np.uint8)
        start = np.cumsum(count + length - 1) - (count + length - 1)
        # equal strings once, with the least document; strings of one seed stay together
        order = np.lexsort((doc, content, seed))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (seed[order][1:] != seed[order][:-1])
        unique = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        parts: list[Verdicts] = []
        seeds = np.flatnonzero(np.append(seed[unique][1:] != seed[unique][:-1], True)) + 1  # ends of seeds
        filled = np.cumsum(count[unique] + length)
        first = 0
        while first < len(unique):
            limit = (filled[first - 1] if first else 0) + TRANSFORM_BYTES
            fits = seeds[(seeds > first) & (filled[seeds - 1] <= limit)]
            last = int(fits[-1]) if len(fits) else int(seeds[np.searchsorted(seeds, first, side="right")])
            own = unique[first:last]
            text = _gathered(data, start[own], count[own] + length - 1)
            v = least_documents(text, count[own], doc[own], length)
            parts.append(v._replace(string=v.string + first))
            first = last
        v = Verdicts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        edge = np.searchsorted(v.string, np.arange(len(unique) + 1))
        many = np.diff(edge)[of]
        at = np.repeat(edge[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        run, shard = np.repeat(run, many), np.repeat(shard, many)
        cut = np.searchsorted(shard, np.arange(len(rows) + 1))
        out = {"shard": table["shard"].combine_chunks(), "run": [], "first": [], "count": [], "least": []}
        for i in range(len(rows)):
            part = slice(cut[i], cut[i + 1])
            out["run"].append(_packed(run[part].astype("<u4")))
            out["first"].append(_packed(v.first[at[part]].astype("<u2")))
            out["count"].append(_packed(v.count[at[part]].astype("<u2")))
            out["least"].append(_packed(v.least[at[part]].astype("<i8")))
        return pa.table(out, schema=_VERDICTS)

    return judge


_VERDICTS = pa.schema([("shard", pa.int64())] + [(n, pa.binary()) for n in ("run", "first", "count", "least")])


def _removed(length: int):
    """Bytes to remove of each document of a shard."""

    def remove(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        said = right.to_pylist()
        read = lambda name, kind: np.concatenate([_unpacked(r[name], kind) for r in said] or [np.zeros(0, kind)])
        run, first, count, least = read("run", "<u4"), read("first", "<u2"), read("count", "<u2"), read("least", "<i8")
        columns: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for row in left.to_pylist():
            shard = Shard.of(row["doc_ids"], row["sizes"], row["text"])
            marks = np.zeros(len(shard.data) + 1, np.int32)
            if len(run):
                own = runs(shard.data, shard.offsets, length)
                # what was said of a string holds for all runs of equal content
                said_of = own.content[run]
                order = np.argsort(said_of, kind="stable")
                low, high = (np.searchsorted(said_of[order], own.content, side=s) for s in ("left", "right"))
                many = high - low
                at = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                start = np.repeat(own.start, many) + first[at]
                doc = shard.ids[np.searchsorted(shard.offsets, start, side="right") - 1]
                gone = least[at] < doc
                np.add.at(marks, start[gone], 1)
                np.add.at(marks, start[gone] + count[at][gone].astype(np.int64) + length - 1, -1)
            removed = np.cumsum(marks)[:-1] > 0
            for i, doc_id in enumerate(shard.ids.tolist()):
                begin, end = shard.offsets[i], shard.offsets[i + 1]
                mask = removed[begin:end]
                step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
                spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
                columns["doc_id"].append(None if doc_id == _NO_ID else doc_id)
                columns["n_bytes"].append(int(end - begin))
                columns["n_removed"].append(int(mask.sum()))
                columns["n_spans"].append(len(spans))
                columns["kept_sha256"].append(hashlib.sha256(shard.data[begin:end][~mask].tobytes()).hexdigest())
                columns["spans"].append([{"start": a, "end": b} for a, b in spans])
        return pa.table(columns, schema=_RESULT)

    return remove


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: bytes covered by a string of `length` bytes (above SEED) that also
    starts in a document with a smaller doc_id, as spans, and a digest of the rest.

    docs needs doc_id and text; other columns are not read.  Texts are UTF-8 bytes; null
    ones are empty.  Strings never cross texts and are judged on the input.  Rows without
    doc_id are later than all others; rows that share a doc_id keep what only they share.

    1. Shards of whole texts are written once.  2. Every window of `length` bytes has a
    seed, the substring of SEED bytes with the least hash, so equal windows have equal
    seeds.  Seeds are dealt to buckets by hash, each once per shard; buckets answer which
    occur twice.  3. Strings of windows with a repeated seed go to the seed's bucket, equal
    ones once per shard, however many documents have them.  4. A bucket transforms its
    strings in pieces of bounded size (all strings of one seed in one piece) and expands
    intervals up to `length`, which gives classes of equal windows and their least document.
    5. Shards take the answers and mark the bytes.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        made = small_batches(docs).select("doc_id", "text").mapInArrow(_to_shards, SHARDS)
        shards = scratch.table(made.withColumn("shard", F.monotonically_increasing_id()), "shards")
        n = max(12, -(-shards.count() // SHARDS_PER_BUCKET))
        seen = shards.mapInArrow(_seen_seeds(n, length), "bucket int, shard long, seeds binary, twice binary")
        bits = seen.groupBy("bucket").applyInArrow(_repeated_seeds, "bucket int, shard long, bits binary")
        bits = scratch.table(bits, "repeated-seeds")
        strings = shards.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(
            _repeated_strings(n, length),
            "bucket int, shard long, run binary, seed binary, content binary, count binary, doc binary, text binary")
        said = strings.groupBy("bucket").applyInArrow(
            _judged(length), "shard long, run binary, first binary, count binary, least binary")
        said = scratch.table(said, "verdicts")
        out = shards.groupBy("shard").cogroup(said.groupBy("shard")).applyInArrow(_removed(length), REPORT)
        return scratch.result(out, "removed")
