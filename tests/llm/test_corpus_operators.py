"""Operators over pairs, lists and models, and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from skysonde.llm import components, minhash, quality_fm, secret_forest, url_cascade, voronoi_knn

SF = "/root/testdata/sf0.001"


# --- near-duplicates ----------------------------------------------------------------


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(x & y)
        if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(i, len(s), find(i), i == find(i)) for i, s in sets}


def near_copies(n):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [random.choices(vocabulary, k=60) for _ in range(4)]
    texts = []
    for _ in range(n):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 8])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [1024, 16])
def test_components_of_near_copies(rows, block):
    texts = [None, "", "one", "ONE", "a b c", "A  b\tc", "a b d"] + near_copies(120)
    docs = list(enumerate(texts))
    found = minhash.near_duplicates(rows(texts), block=block).collect()
    assert {tuple(r) for r in found} == brute_components(docs) and len(found) == len(texts)


@pytest.mark.parametrize("n", range(6))
def test_one_text_of_few_words(rows, n):
    texts = [" ".join("abcde"[:n])]
    found = minhash.near_duplicates(rows(texts, parts=1)).collect()
    assert {tuple(r) for r in found} == brute_components(list(enumerate(texts))) and len(found) == 1


def test_components_of_the_corpus(corpus):
    found = minhash.near_duplicates(corpus[0]).collect()
    assert {tuple(r) for r in found} == brute_components(list(corpus[1].items()))


def test_rows_without_or_with_the_same_id(rows):
    docs = rows([(None, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (9, "x y z"), (9, "q r s t"), (5, "q r s t")])
    found = sorted(minhash.near_duplicates(docs).collect(), key=repr)
    assert [(r.doc_id, r.component_id, r.kept) for r in found] == [
        (3, 3, True), (5, 5, True), (7, 3, False), (9, 5, False), (9, 5, False), (None, None, True)]
    stay = minhash.without_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == [3, 5, None]


def test_labels_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = {r.node: r.component for r in components.component_labels(df).collect()}
    assert labels == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components.component_labels(df.where("false")).count() == 0


# --- top-k --------------------------------------------------------------------------


def brute_top(vectors, k=5, every=50):
    valid = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.append((i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)))
    out = []
    for i, v in valid:
        if i % every == 0:
            scores = sorted((-int(v @ w), j) for j, w in valid if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_of_odd_vectors(spark):
    random.seed(3)
    vectors = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    vectors += [(300, [1.0, float("nan"), 0.0, 0.0]), (350, None), (400, [1.0, None, 0.0, 0.0]), (450, [0.0] * 4),
                (500, [1.0, 2.0]), (501, [float("inf")] * 4), (550, []), (None, [1.0] * 4)]
    vectors += [(600 + i, [0.5] * 4) for i in range(60)] + [(601, [0.5] * 4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    data = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors]
    assert sorted(map(tuple, voronoi_knn.top_k(df).collect())) == brute_top(data)
    large = spark.createDataFrame([(i, [x * 1000 for x in v]) for i, v in vectors[:60]], "vec_id long, embedding array<double>")
    expected = brute_top([(i, [x * 1000 for x in v]) for i, v in vectors[:60]])
    assert sorted(map(tuple, voronoi_knn.top_k(large).collect())) == expected
    assert voronoi_knn.top_k(df.where("false")).count() == 0


def test_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(voronoi_knn, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(voronoi_knn, "QUERIES_PER_BLOCK", 2)
    random.seed(5)
    vectors = [(i, [random.gauss(i % 3 * 4, 1) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, voronoi_knn.top_k(df, k=3, every=7).collect())) == brute_top(vectors, 3, 7)


def test_bounds_leave_distant_cells_out():
    random_ = np.random.RandomState(1)
    near, far = random_.normal(0, 1, (50, 3)), random_.normal(0, 1, (50, 3)) + 1000
    vectors = np.concatenate((near, far)).astype(np.int64)
    cells = voronoi_knn.Cells(vectors[[0, 60]], int((vectors**2).sum(axis=1).max()))
    sent = dict(cells.wanted_by(vectors, {0: 3.0}, {0: 5.0}))
    assert len(sent[0]) < 100


# --- url lists ----------------------------------------------------------------------


def test_cascade_is_exact(spark):
    random.seed(9)
    urls = [f"http://h{random.randrange(400)}.s{random.randrange(30)}.net/p{random.randrange(9)}/x" for _ in range(800)]
    rules = [(f"h{i}.s{j}.net", f"/p{i % 9}/", random.choice(["allow", "block"])) for i in range(0, 400, 3) for j in range(0, 30, 4)]
    rules += [("s1.net", "/", "block"), ("net", "", "allow"), (None, "/", "block"), ("s2.net", None, "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    said = {h + p: v for h, p, v in rules if h and p is not None}
    for r in url_cascade.judged_urls(pages, listed).collect():
        fits = [h + p for h, p, v in rules if h and p is not None
                and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert (r.rule, r.verdict) == (best, said.get(best, "allow"))


def test_odd_urls_and_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "KEYS_PER_CASCADE", 1)
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "block")], "host string, path string, verdict string")
    urls = [None, "", "a.com/x", "http://", "http://A.Com/xy?q", "x://b.a.com/x#", "http://a.com", "http://a.com:8/x", "http://com/", "h://\na.com/x\n"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(4, urls[4], "z")], "page_id long, url string, rule string")
    found = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_cascade.judged_urls(pages, rules).collect() if r.rule)
    assert found == [
        (4, "a.com", "/xy", "a.com/x", "block"), (4, "a.com", "/xy", "a.com/x", "block"),
        (5, "b.a.com", "/x", "a.com/x", "block"), (8, "com", "/", "com/", "allow"), (9, "\na.com", "/x\n", "com/", "allow")]
    assert {r.verdict for r in url_cascade.judged_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert url_cascade.judged_urls(pages.where("false"), rules).count() == 0


# --- quality ------------------------------------------------------------------------


def test_margin_equals_the_sum_over_pairs():
    random_ = np.random.RandomState(2)
    width = quality_fm.BINS + quality_fm.STATISTICS
    machine = quality_fm.Machine(0.3, random_.normal(size=width), random_.normal(size=(width, 3)))
    index = np.array([1, 5, 9, 2, 5], np.int32)
    value = np.array([0.5, 1.0, -2.0, 1.5, 3.0])
    margin, _ = machine.margin(quality_fm.Features(np.array([0, 3, 5]), index, value))
    for row, part in enumerate((range(3), range(3, 5))):
        expected = 0.3 + sum(machine.weight[index[i]] * value[i] for i in part)
        for i, j in itertools.combinations(part, 2):
            expected += machine.factor[index[i]] @ machine.factor[index[j]] * value[i] * value[j]
        assert abs(margin[row] - expected) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = quality_fm.scored(docs, quality_fm.trained(docs, labels))
    own = scored.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in own]) > 0.97
    assert np.mean([r.predicted == 1 for r in own if r.quality == 1]) > 0.99


def test_odd_texts_and_labels(spark, rows):
    docs = rows([None, "", "x " * 40000, "ok words here", "ok words here", (None, "no id"), (3, "again")])
    for labels in ([], [(3, 1)], [(3, 1), (4, 0), (2, 0), (1, None), (99, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        machine = quality_fm.trained(docs, known)
        found = quality_fm.scored(docs, machine).collect()
        assert len(found) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
        assert quality_fm.without_low_quality(docs, machine).columns == docs.columns
    assert quality_fm.scored(docs.where("false"), machine).count() == 0


# --- secrets ------------------------------------------------------------------------


def test_secrets_are_found_and_words_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    planted = re.compile(r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}|password=[0-9a-f]{18}")
    wanted = hit = found = 0
    for r in secret_forest.secret_scan(docs).collect():
        true = {(m.start(), m.end()) for m in planted.finditer(texts[r.doc_id])}
        own = {tuple(map(int, s.split(":")[:2])) for s in r.secrets.split(",") if s}
        assert r.n_secrets == len(own) <= r.n_candidates
        wanted, hit, found = wanted + len(true), hit + len(true & own), found + len(own)
    assert wanted and hit / wanted > 0.95 and hit / found > 0.9


def test_odd_candidates(spark, rows):
    docs = rows([None, "", "k" * 50000, 'token = "' + "9f" * 20 + '"', "1234567890123456", 'token = "' + "9f" * 20 + '"'])
    findings = spark.createDataFrame([], "label double, " + ", ".join(f"{n} double" for n in secret_forest.FEATURES))
    found = sorted(tuple(r) for r in secret_forest.secret_scan(docs, findings).collect())
    assert [f[1:3] for f in found] == [(0, 0), (0, 0), (0, 0), (1, 1), (1, 0), (1, 1)]
    assert secret_forest.secret_scan(docs.where("false")).count() == 0


def test_keys_behind_long_paths_and_long_words(spark, rows):
    key = "9f3a" * 10
    path = "something/different/" * 30
    docs = rows(["something different"] * 3 + [path + key, path.replace("/", "-") + key, "ab" * 32 + "ac" * 18])
    corpus = secret_forest.corpus_model(docs)
    assert corpus.pairs["ab"] == pytest.approx(np.log(32 / 50))
    long = secret_forest.described("word" * 64 + "9f" * 64, 0, 384, "", corpus)
    assert long["digits"] == pytest.approx(64 / 384)
    findings = spark.createDataFrame([], "label double, " + ", ".join(f"{n} double" for n in secret_forest.FEATURES))
    found = {r.doc_id: r.secrets for r in secret_forest.secret_scan(docs, findings).collect()}
    assert f"{len(path)}:{len(path) + 40}:1.0" in found[3].split(",") and f"{len(path)}:{len(path) + 40}:1.0" in found[4].split(",")


# --- pipeline -----------------------------------------------------------------------


def test_stages_follow_their_operators(spark):
    """Each stage on what the one before kept, against brute force on the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.good_documents(spark, docs, SF).cache()
    machine = quality_fm.trained(docs, labels)
    wanted = {r.doc_id for r in quality_fm.scored(docs, machine).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted

    rows_ = [(r.doc_id, r.text) for r in kept.collect()]
    distinct = corpus_pipeline.distinct_documents(spark, kept, SF).cache()
    assert {r.doc_id for r in distinct.collect()} == {i for i, _, _, stays in brute_components(rows_) if stays}
    assert distinct.columns == docs.columns

    unseen = corpus_pipeline.unseen_documents(spark, distinct, SF).cache()
    assert unseen.columns == docs.columns and unseen.count() < distinct.count()
    private = corpus_pipeline.private_documents(spark, unseen, SF).cache()
    assert private.columns == docs.columns and private.count() == unseen.count()
    assert private.where("text RLIKE '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    tokens = corpus_pipeline.token_ids(spark, private, SF)
    texts = {r.doc_id: r.text for r in private.collect()}
    for r in tokens.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in tokens.collect()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
