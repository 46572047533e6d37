"""Secret scan: candidate strings, and a random forest that removes false positives."""

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import Scratch, small_batches

#: The forest learns from at most this many labelled findings of each kind, those with the
#: least hashes; statistics and candidates cover all rows.
FINDINGS_PER_KIND = 5000
TREES, DEPTH = 24, 6
#: The dictionary is this many most frequent words of the corpus.
DICTIONARY_WORDS = 4096
LEAST_SCORE = 0.5
#: Different words a task counts before it sends them on.
HELD_WORDS = 200_000
#: Longer words are counted as their pairs of letters: no text beside a candidate (60
#: characters at most) can hold them whole.
LONGEST_WORD = 64
#: In candidates above this length the parts between separators are candidates, too.
LONG = 256

# Shapes of strings that can be secrets, of known keys, and of harmless strings.
CANDIDATE = r"[A-Za-z0-9_+/=-]{16,}"
KNOWN_SECRET = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"xox[baprs]-[0-9A-Za-z-]{10,}",
)
KNOWN_HARMLESS = (
    r"[0-9]+",
    r"[A-Za-z]+",
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"[=+/_-]+",
)
NAMES = ("key", "token", "secret", "passw", "pwd", "credential", "auth", "bearer", "private", "api")
PLACEHOLDERS = ("example", "test", "dummy", "sample", "changeme", "placeholder", "xxxx")

_ASSIGNED = re.compile(r"([A-Za-z_.-]{2,40})[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?$")
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "symbols", "class_changes", "likelihood", "coverage",
    "longest_letters", "distinct", "hexadecimal", "assigned", "named", "quoted", "placeholder", "neighbours", "path",
)
FOUND = (
    "doc_id long, candidates array<struct<start:int,end:int,known:int,"
    + ",".join(f"{n}:double" for n in FEATURES) + ">>"
)


def _letters(text: str) -> str:
    return re.sub("[^a-z]", "", text.lower())


class CorpusModel:
    """Letter transitions of the corpus, and its most frequent words."""

    def __init__(self, pairs: dict[str, float], words: frozenset[str]) -> None:
        self.pairs, self.words = pairs, words
        self.rare = min(pairs.values(), default=-10.0) - 1.0

    def likelihood(self, text: str) -> float:
        """Mean log probability of a letter after another; strings of few letters are unlikely."""
        letters = _letters(text)
        if len(letters) < 2:
            return self.rare
        return sum(self.pairs.get(letters[i : i + 2], self.rare) for i in range(len(letters) - 1)) / (len(letters) - 1)

    def coverage(self, text: str) -> float:
        """Share of characters inside dictionary words of three letters or more."""
        text, covered, at = text.lower(), 0, 0
        while at < len(text):
            n = next((n for n in range(min(12, len(text) - at), 2, -1) if text[at : at + n] in self.words), 0)
            covered += n
            at += n or 1
        return covered / len(text)


def described(text: str, start: int, end: int, path: str, corpus: CorpusModel) -> dict[str, float]:
    """Features of a candidate: itself, its path, and the words beside it."""
    own = text[start:end]
    n = len(own)
    kind = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in own]
    count = np.unique(list(own), return_counts=True)[1] / n
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    assigned = _ASSIGNED.search(before) or _ASSIGNED.search(before + re.split("[=:]", own)[0] + "=" if "=" in own[:-2] else "")
    name = (assigned.group(1) if assigned else "").lower() + (own.split("=")[0].lower() if "=" in own[:-2] else "")
    letters = re.findall("[A-Za-z]+", own)
    beside = re.findall(r"[^\W\d_]+", before)[-2:] + re.findall(r"[^\W\d_]+", after)[:2]
    return {
        "length": min(float(len(own)), 512.0),
        "entropy": float(-(count * np.log2(count)).sum()),
        "digits": kind.count(0) / n, "upper": kind.count(1) / n, "lower": kind.count(2) / n, "symbols": kind.count(3) / n,
        "class_changes": sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
        "likelihood": corpus.likelihood(own),
        "coverage": corpus.coverage(own),
        "longest_letters": max(map(len, letters), default=0) / n,
        "distinct": len(count) / n,
        "hexadecimal": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", own.split("=")[-1]))),
        "assigned": float(bool(assigned) or "=" in own[1:-2]),
        "named": float(any(x in name for x in NAMES)),
        "quoted": float(before[-1:] in "\"'`" and before != ""),
        "placeholder": float(any(x in own.lower() for x in PLACEHOLDERS)),
        "neighbours": float(np.mean([b.lower() in corpus.words for b in beside])) if beside else 0.0,
        "path": float(sum(map(ord, path or "")) % 64),
    }


def known_kind(own: str, features: dict[str, float]) -> int | None:
    """Label of a finding that needs no forest: 1 for keys of known services and values
    given to secret names, 0 for plain words, numbers and identifiers; else None."""
    if any(re.fullmatch(p, own) for p in KNOWN_SECRET):
        return 1
    if any(re.fullmatch(p, own) for p in KNOWN_HARMLESS):
        return 0
    if features["named"] and features["assigned"] and not features["placeholder"] and features["digits"] > 0.2:
        return 1
    return 0 if features["placeholder"] or features["coverage"] > 0.8 else None


def corpus_model(docs: DataFrame) -> CorpusModel:
    """Counts over all documents; at most 26 * 26 pairs and DICTIONARY_WORDS words are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                for w in re.findall("[a-z]{3,}", (text.as_py() or "").lower()):
                    if len(w) <= LONGEST_WORD:
                        seen[w] += 1
                    else:
                        seen.update(a + b for a, b in pairwise(w))
                if len(seen) > HELD_WORDS:
                    yield counted()
                    seen.clear()
        yield counted()

    with Scratch(docs.sparkSession) as scratch:
        # partial counts per task, then per word
        words = small_batches(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        words = scratch.table(words, "words")
        frequent = words.where(F.length("word") > 2).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).select("word").collect()
        at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
        pairs = words.select("word", "n", at.alias("at")).select(F.expr("substring(word, at, 2)").alias("pair"), "n")
        counts = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    first: dict[str, int] = {}
    for pair, n in counts.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    logs = {p: float(np.log(n / first[p[0]])) for p, n in counts.items()}
    return CorpusModel(logs, frozenset(r.word for r in frequent))


def _spans(scan: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Runs of characters of a secret, and the parts of long ones."""
    for m in scan.finditer(text):
        yield m.span()
        if m.end() - m.start() > LONG:
            parts = {(p.start(), p.end()) for sep in ("/=", "/=_-") for p in re.finditer(f"[^{sep}]{{16,}}", m.group())}
            yield from sorted((m.start() + a, m.start() + b) for a, b in parts - {(0, m.end() - m.start())})


def candidates(docs: DataFrame, corpus: CorpusModel, path: str | None = "source") -> DataFrame:
    """(doc_id, candidates): strings of 16 characters or more with a digit or capitals inside.

    Parts of a candidate above LONG characters, between `/` and `=` or all separators, are
    candidates beside it, so that a path of words doesn't hide the key at its end."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    place = F.col(path).cast("string") if path in docs.columns else F.lit("")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = re.compile(CANDIDATE)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("known", pa.int32()), *((n, pa.float64()) for n in FEATURES)]))
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                out = []
                for text, where in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own = []
                    for start, end in _spans(scan, text or ""):
                        if re.search("[0-9]|[A-Z].*[A-Z]", text[start + 1 : end]):
                            f = described(text, start, end, where, shared.value)
                            own.append({"start": start, "end": end, "known": known_kind(text[start:end], f), **f})
                    out.append(own)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "candidates"])

    return docs.select("doc_id", "text", place.alias("_path")).mapInArrow(find, FOUND)


def secret_scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Per document: candidates, secrets that the forest confirms, and their spans with scores.

    docs needs doc_id and text, and may have `source`, which serves as path; other columns
    are not read.  findings are labelled ones (columns of FEATURES and label 0/1); without
    them, those candidates of the corpus are used whose kind is known by their shape, but
    for documents that are held out (crc32 of the id modulo 3 is 1).  With findings of one
    label or none, every candidate is kept unless its shape is harmless.  Null and empty
    texts have no candidates; repeated rows each get their row.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = candidates(docs, corpus_model(docs)).withColumn("_row", F.monotonically_increasing_id())
        found = scratch.table(found, "candidates")
        each = found.select("_row", "doc_id", F.explode("candidates").alias("c")).select("_row", "doc_id", "c.*")
        if findings is None:
            known = each.where("known IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
            findings = known.withColumn("label", F.col("known").cast("double"))
        picks = [
            findings.where(F.col("label") == k).select("label", *FEATURES)
            .orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(FINDINGS_PER_KIND)
            for k in (0, 1)
        ]
        sample = scratch.table(picks[0].union(picks[1]), "findings")
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        if sample.select("label").distinct().count() == 2:
            forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, labelCol="label", featuresCol="features")
            model = forest.fit(assemble.transform(sample.coalesce(1)))  # at most 2 * FINDINGS_PER_KIND rows
            judged = model.transform(assemble.transform(each))
            judged = judged.withColumn("score", vector_to_array("probability")[1])
        else:
            judged = each.withColumn("score", F.when(F.col("known") == 0, 0.0).otherwise(1.0))
        kept = judged.where(F.col("score") >= LEAST_SCORE).select(
            "_row", F.struct("start", "end", F.round("score", 6).alias("score")).alias("hit"))
        kept = kept.groupBy("_row").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
        out = found.select("_row", "doc_id", F.size("candidates").cast("long").alias("n_candidates")).join(kept, "_row", "left")
        spans = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"], h["end"], h["score"])), ",")
        return scratch.result(out.select(
            "doc_id", "n_candidates", F.coalesce(F.array_size("hits"), F.lit(0)).cast("long").alias("n_secrets"),
            F.coalesce(spans, F.lit("")).alias("secrets")), "secrets")
