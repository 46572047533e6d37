"""Byte-level BPE: encoding by longest matches with backtracking, and decoding."""

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skysonde.llm.common import small_batches

#: Pieces a task remembers; when the memo is full it starts anew.
MEMO_PIECES = 400_000
#: Longer pieces are not remembered.
MEMO_BYTES = 64
_NEVER = 1 << 62
REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 bytes, blank, rank on every line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder for one set of ranks.

    The encoding of a piece is the one sequence of tokens in which every two neighbours
    are compatible: merging their joint bytes gives just these two again.  So a piece is
    read from the left, longest token first; where a token isn't compatible with the one
    before it, the next shorter one is tried, and without any the one before is taken
    back.  A place from which no way leads to the end is marked and not tried again, so
    the work is linear in the piece.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def prepare(self) -> "Codec":
        """Build what a task needs; not sent along."""
        if hasattr(self, "pairs"):
            return self
        self.split = regex.compile(self.pattern).findall
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.size = {i: len(t) for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            # Latin-1 gives every byte one character, the only text the automaton takes
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter = {}
        for token, i in self.ranks.items():
            n = len(token) - 1
            while n and token[:n] not in self.ranks:
                n -= 1
            self.shorter[i] = self.ranks[token[:n]] if n else None
        self.ending, self.beginning = self._growth()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        return self

    def _growth(self) -> tuple[dict, dict]:
        """Tokens at the end (and at the beginning) of each token while it is merged together.

        A token is made of two tokens of lower rank, so on either side a chain of ever
        higher ranks leads from a single byte to the token itself.  None for a token
        that merging doesn't make.
        """
        ending: dict[int, tuple[int, ...] | None] = {}
        beginning: dict[int, tuple[int, ...] | None] = {}
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                ending[i] = beginning[i] = (i,)
                continue
            parts = merged(token, self.ranks, until=2)
            if len(parts) == 2 and max(parts) < i and ending.get(parts[1]) and beginning.get(parts[0]):
                ending[i] = (*ending[parts[1]], i)
                beginning[i] = (*beginning[parts[0]], i)
            else:
                ending[i] = beginning[i] = None
        return ending, beginning

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joint bytes of two tokens merge into just these two."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PIECES:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Merges happen by rank, so both tokens grow along their chains in time with each
        other; they stay apart if at no time the two at the border are due to merge."""
        ends, begins = self.ending[left], self.beginning[right]
        if ends is None or begins is None:
            return merged(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        bytes_of, ranks = self.bytes_of, self.ranks
        i = j = 0
        while True:
            next_left = ends[i + 1] if i + 1 < len(ends) else _NEVER
            next_right = begins[j + 1] if j + 1 < len(begins) else _NEVER
            across = ranks.get(bytes_of[ends[i]] + bytes_of[begins[j]], _NEVER)
            # of equal ranks the leftmost is merged first
            if across < next_left and across <= next_right and across != _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = token  # matches come by their end, so the longest is last
        ids: list[int] = []
        dead = bytearray(len(piece) + 1)
        size, pairs, shorter = self.size, self.pairs, self.shorter
        at, token, total = 0, longest[0], len(piece)
        while True:
            end = at + size[token]
            if not dead[end]:
                fits = not ids or pairs.get((ids[-1], token))
                if fits is None:
                    fits = self.compatible(ids[-1], token)
                if fits:
                    ids.append(token)
                    if end == total:
                        return ids
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token is None:  # nothing goes on from here: take the last token back
                dead[at] = 1
                last = ids.pop()
                at -= size[last]
                token = shorter[last]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self.memo.make_room()
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    """Encoded pieces; a missing one is encoded when asked for."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.codec.piece(raw)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= MEMO_BYTES and len(self) < MEMO_PIECES:
            self[piece] = ids
        return ids

    def make_room(self) -> None:
        if len(self) >= MEMO_PIECES:
            self.clear()


def merged(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[int]:
    """BPE by its definition: merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best = min(
            ((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks),
            default=None,
        )
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document the ids of its whole text, their number, and the text decoded from them.

    docs needs doc_id and text; other columns are not read.  Null and empty texts have no
    ids; the digests are then those of no bytes.  Repeated rows each get their row.
    The ranks (a vocabulary of fixed size) are broadcast; nothing is shuffled.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value.prepare()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [own.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                back = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(encode, REPORT)


def decoded(encodings: DataFrame, ranks: dict[bytes, int], pattern: str = "") -> DataFrame:
    """Texts (as bytes) of rows with doc_id and ids; null ids give null."""
    codec = encodings.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value.prepare()
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "bytes"]
            )

    return encodings.select("doc_id", "ids").mapInArrow(decode, "doc_id long, bytes binary")
