"""Operators on single texts against brute force, an exact round trip, or SQL."""

import hashlib
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from skysonde.llm import bwt_repeats, byte_bpe, contamination, disclosure, license_rules

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "@", ".", "b-c", "1", "23", "+", "(", ")", " ", "-", "255", "4111111111111111", "é", "🙂", "_", "%", "\n"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_license_sentences", "op7_voronoi_top_k", "op8_url_bloom_cascade"])
def test_same_rows_as_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    result = sql.execute(entry.oracle_sql()[name])
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


# --- licences ---------------------------------------------------------------------


def test_license_sequences(rows):
    texts = [
        None,
        "",
        "No word of it.",
        "All rights reserved.\nLicensed under the Apache License, Version 2.0.",
        "Redistributions of source code must retain the above copyright notice, x. Redistributions in binary form must "
        "reproduce the above copyright notice. Nothing. Endorse or promote products derived from this software without "
        "specific prior written permission.",
        "GNU General Public License, version 2. At your option any later version of the license. A strange licence here.",
        "All rights reserved. All rights reserved.",
    ]
    found = {r.doc_id: r for r in license_rules.license_scan(rows(texts)).collect()}
    assert [found[i].licenses for i in range(7)] == [
        "", "", "", "Apache-2.0,proprietary", "BSD-3-Clause", "GPL-2.0-or-later", "proprietary"]
    assert found[3].sentence_ids == "AllRights,ApacheVer2" and found[5].n_unknown == 1


# --- personal data ------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


#: One sentence for each of SENTENCES, bare.
BARE = {
    "SPDX": "SPDX-License-Identifier: MIT",
    "ApacheVer2": "Licensed under the Apache License, Version 2.0",
    "ApacheWarranty": 'Software distributed under the License is distributed on an "AS IS" basis.',
    "LGPLVer": "GNU Lesser General Public License, version 2.1",
    "AGPLVer3": "GNU Affero General Public License v3",
    "GPLVer3": "GNU General Public License, version 3",
    "GPLVer2": "GNU General Public License, version 2",
    "GPLAny": "GNU General Public License",
    "LaterVersion": "(at your option) any later version of the licence",
    "MPLVer2": "Mozilla Public License, version 2.0",
    "CCByNcSa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0.",
    "CCByNc": "CC BY-NC 4.0.",
    "CCBySa": "CC BY-SA 4.0.",
    "CCBy": "Licensed under CC BY 4.0.",
    "CC0": "Text is available as CC0 1.0 Universal.",
    "PublicDomain": "Released into the public\ndomain",
    "MITName": "Released under the MIT License",
    "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MITNotice": "The copyright notice and this permission notice shall be included in all copies",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted",
    "BSDSource": "Redistributions of source code must retain the above copyright notice",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice",
    "BSDEndorse": "Endorse or promote products derived from this software without prior permission",
    "BSDName": "Available under the 3-clause BSD License",
    "NoWarranty": "Provided as is, without any warranty",
    "SeeLicense": "See the file LICENSE",
    "AllRights": "All rights reserved",
    "Copyright": "Copyright (c) 2020",
}


BARE |= {
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSLGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose",
    "ZlibNoWarranty": "This software is provided 'as-is', without any express or implied warranty.",
    "OFL": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "ArtisticVer2": "The Artistic License 2.0",
    "EPLVer2": "Eclipse Public License - v 2.0",
    "EPLVer1": "Eclipse Public License v1.0",
    "EUPL": "European Union Public Licence",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "LGPLAny": "GNU Library General Public License",
    "AGPLAny": "GNU Affero General Public License",
}
#: One for each of NOTICES.
NOTED = {
    "LGPLOrLater": "GNU Lesser General Public License or any later version",
    "AGPLOrLater": "GNU Affero General Public License, or any later version",
    "GPLVer3OrLater": "GNU General Public License as published by the FSF, version 3, or any later version",
    "GPLVer2OrLater": "GNU General Public License v2 or any later version",
    "Ver3OrLater": "Either version 3 of the License, or (at your option) any later version.",
    "Ver2OrLater": "Either version 2 of the License, or (at your option) any later version.",
    "GnuHope": "In the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GnuImplied": "Without even the implied warranty of MERCHANTABILITY",
    "GnuAddress": "If not, see <https://www.gnu.org/licenses/>.",
    "ApacheUse": "You may not use this file except in compliance with the License.",
    "ApacheSee": "See the License for the specific language governing permissions",
    "NoLiability": "In no event shall the authors be liable for any claim.",
    "Disclaimer": "Provided by the authors AS IS and any express or implied warranties are disclaimed",
}


def test_each_known_sentence_passes_the_stems(rows):
    assert sorted(BARE) == sorted(name for name, _ in license_rules.SENTENCES)
    assert list(NOTED) == [name for name, _ in license_rules.NOTICES]
    more = {"CC0 Universal": "CC0", "CC0 dedication": "CC0", "cc attribution-sharealike": "CCBySa"}
    texts = [*BARE.values(), *NOTED.values(), *more]
    found = {r.doc_id: r.sentence_ids for r in license_rules.license_scan(rows(texts)).collect()}
    assert [found[i] for i in range(len(found))] == ["SPDX:mit", *list(BARE)[1:], *NOTED, *more.values()]


def test_spdx_lines_count_as_their_expressions(rows):
    texts = ["# SPDX-License-Identifier: GPL-2.0-only", "/* SPDX-License-Identifier: MIT OR Apache-2.0; */\n// SPDX-License-Identifier: MIT."]
    found = {r.doc_id: r.licenses for r in license_rules.license_scan(rows(texts)).collect()}
    assert found == {0: "gpl-2.0-only", 1: "mit or apache-2.0,mit"}


LONG = (
    "provided as is ", "gnu general public license as published by ", "gnu lesser general public license ", "permission to use, copy, "
    "modify, and distribute this software ", "endorse or promote products derived from this software without ", "*", "-", "/*", "*/ ", "\n * ", "v. ",
)


def test_long_texts_of_half_known_sentences_take_time_in_proportion(rows):
    texts = [part * (200_000 // len(part)) + end for part in LONG for end in ("", " licence")]
    begun = time.monotonic()
    assert len(license_rules.license_scan(rows(texts)).collect()) == len(texts)
    assert time.monotonic() - begun < 60


def test_license_sql_equals_the_scan_on_notices_and_comments(rows):
    kinds = (BARE, NOTED, HEADERS)
    texts = [x for kind in kinds for x in (kind if kind is HEADERS else kind.values())]
    texts += [". ".join(texts), "\r\n".join(f"// {t}" for t in texts), "\n".join(f"   * {t} */" for t in texts), "<!-- *** --- rem x ---> licence"]
    frame = rows(texts)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts)])
    result = db.execute(license_rules.oracle())
    names = [c[0] for c in result.description]
    expected = sorted(result.fetchall())
    assert sorted(map(tuple, license_rules.license_scan(frame).select(names).collect())) == expected


GNU = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {}General Public License for more details.

You should have received a copy of the GNU {}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
HEADERS = {
    GNU.format(":", "", ",", 3, "", ""): "GPL-3.0-or-later",
    GNU.format(";", "", ";", 2, "", ""): "GPL-2.0-or-later",
    GNU.format(":", "", ",", 3, "", "").replace("either version 3 of the License, or\n(at your option) any later version", "version 3"): "GPL-3.0",
    GNU.format(";", "Lesser ", ";", "2.1", "Lesser ", "Lesser "): "LGPL",
    GNU.format(":", "Affero ", ",", 3, "Affero ", "Affero "): "AGPL-3.0-or-later",
    """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""": "Apache-2.0",
    """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files, to deal in
the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.""": "MIT",
    """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0.""": "MPL-2.0",
}


@pytest.mark.parametrize("begin, line, end", [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("/* ", "", " */"), ("<!--\n", "", "\n-->"), ("", "-- ", "")])
def test_standard_notices_plain_and_commented(rows, begin, line, end):
    texts = [begin + "\n".join(line + x for x in text.split("\n")) + end for text in HEADERS]
    found = {r.doc_id: r for r in license_rules.license_scan(rows(texts)).collect()}
    assert [found[i].licenses for i in range(len(texts))] == list(HEADERS.values())
    assert [found[i].n_unknown for i in range(5)] == [0] * 5


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
                "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind]
            if valid(m.group(), digits):
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_on_odd_texts(rows):
    random.seed(2)
    texts = [None, "", "a@b.c_d@e.f x@y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.04", "x" * 20000 + "@y.z", "1" * 20000,
             "1 " * 9000 + "2", "a@b." * 500, "4111 1111 1111 1111-4111111111111111"]
    texts += ["".join(random.choices(PIECES, k=random.randint(1, 40))) for _ in range(600)]
    found = {r.doc_id: r for r in disclosure.personal_data(rows(texts)).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        joined = ",".join(s for own in spans.values() for s in own)
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()], text
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_disclosing_terms_and_rewriting(rows, monkeypatch, broadcast):
    monkeypatch.setattr(disclosure, "BROADCAST_TERMS", broadcast)
    told = [f"word{'abcdefghij'[i]} zzyyx mail me{i}@ex.org now" for i in range(10)]
    texts = told + ["common now text", "", None] + [f"plain {'abcdefghij'[i]} common now" for i in range(10)]
    found = {r.doc_id: r for r in disclosure.personal_data(rows(texts), support=5).collect()}
    for i in range(10):
        terms = [told[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].spans.split(",")) if k == "term"]
        assert terms == ["zzyyx", "mail"]
    assert found[10].spans == "" and found[12].spans == ""
    docs = rows(texts)
    new = {r.doc_id: r for r in disclosure.sanitised(docs, support=5).collect()}
    assert docs.columns == list(new[0].asDict())
    assert new[0].text == "worda   [EMAIL] now" and new[0].n_chars == len(new[0].text)
    assert new[10].text == "common now text" and new[12].text is None and len(new) == len(texts)


# --- byte-level BPE -----------------------------------------------------------------


def test_ids_equal_the_library_and_come_back(rows, corpus):
    ranks = byte_bpe.read_ranks(None, VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    tokens = list(ranks)
    texts = [None, "", " ", "a" * 5000, "<|endoftext|>", "漢字🙂 don't\r\n\t x"]
    texts += [b"".join(random.choices(tokens, k=8)).decode("utf8", "ignore") for _ in range(500)]
    texts += list(corpus[1].values())[:60]
    found = {r.doc_id: r for r in byte_bpe.encoded(rows(texts), ranks, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(found[i]["ids"]) == ids and found[i].n_tokens == len(ids) // 4
        assert found[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_decoding_ids(spark):
    ranks = byte_bpe.read_ranks(None, VOCABULARY)
    ids = np.array([5, 300, 70], "<u4").tobytes()
    df = spark.createDataFrame([(1, ids), (2, None), (3, b"")], "doc_id long, ids binary")
    out = {r.doc_id: r["bytes"] for r in byte_bpe.decoded(df, ranks).collect()}
    back = {i: t for t, i in ranks.items()}
    assert bytes(out[1]) == back[5] + back[300] + back[70] and out[2] is None and bytes(out[3]) == b""


# --- decontamination ----------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_overlaps(text, items, window=10):
    words = WORD.findall(ascii_lower(text))
    hit, met = set(), set()
    for item, other in items:
        theirs = WORD.findall(ascii_lower(other))
        n = min(window, len(theirs))
        for j in range(len(theirs) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == theirs[j : j + n]:
                    hit.update(range(k, k + n))
                    met.add("" if item is None else str(item))
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_overlaps(spark, rows, block_bytes):
    random.seed(4)
    vocabulary = ["Ab", "c", "d9", "é", "xyz", "q"]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(1, 18)))) for i in range(12)]
    items += [(3, "c c c"), (None, "only this"), (20, None), (21, "..."), (22, "")]
    texts = [None, "", "only this", "c, c; C.", "..."]
    texts += ["-".join(random.choices(vocabulary, k=random.randint(5, 40))) for _ in range(60)]
    texts += [f"q {t} q" for _, t in items if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = rows(texts)
    found = {r.doc_id: r for r in contamination.overlap_report(docs, bench, block_bytes=block_bytes).collect()}
    for i, text in enumerate(texts):
        n_words, n_hit, met = brute_overlaps(text, items)
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(met), n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()
        assert sum(m.n_words for m in r.matches) == n_hit
    clean = contamination.without_contaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if not found[i].contaminated]


def test_no_benchmark_and_no_documents(spark, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in contamination.overlap_report(rows(["a b", None]), empty).collect())
    none = rows(["a"]).where("false")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert contamination.overlap_report(none, bench).count() == 0
    assert byte_bpe.encoded(none, byte_bpe.read_ranks(None, VOCABULARY), public_tokenizers.PATTERN).count() == 0
    assert disclosure.personal_data(none).count() == 0
    assert license_rules.license_scan(none).count() == 0
    assert bwt_repeats.repeated_bytes(none).count() == 0


# --- repeated strings -----------------------------------------------------------------


def brute_removed(docs, length=50):
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for j in range(len(raw) - length + 1):
            first[raw[j : j + length]] = min(first.get(raw[j : j + length], 2**64), 2**63 if doc is None else doc)
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - length + 1):
            if first[raw[j : j + length]] < (2**63 if doc is None else doc):
                gone[j : j + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_of_odd_texts(spark, rows):
    random.seed(6)
    base = ["".join(random.choices("abc dé\n", k=300)) for _ in range(4)]
    docs = [(None, base[0]), (1, None), (2, ""), (3, "x" * 300), (4, "x" * 120), (5, "ab" * 90), (6, "ab" * 55),
            (7, "漢" * 40), (8, "漢" * 30), (9, "z" * 49), (10, "z" * 50), (11, "z" * 50)]
    for k in range(12, 90):
        cuts = [(random.choice(base), random.randint(0, 250)) for _ in range(3)]
        docs.append((k, "".join(b[a : a + random.randint(10, 150)] for b, a in cuts)))
    docs += [(12, docs[15][1]), (20, base[1]), (20, base[1]), (None, base[2])]
    found = bwt_repeats.repeated_bytes(rows(docs)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_removed(docs)


def test_repeats_of_the_corpus(corpus):
    found = bwt_repeats.repeated_bytes(corpus[0]).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_removed(list(corpus[1].items()))


def test_pieces_of_a_bucket(monkeypatch, rows):
    monkeypatch.setattr(bwt_repeats, "TRANSFORM_BYTES", 200)
    random.seed(8)
    base = "".join(random.choices("abcdefgh ", k=900))
    docs = [(i, base[a : a + 200]) for i, a in enumerate(random.choices(range(700), k=30))]
    table = bwt_repeats.least_documents(
        np.frombuffer(b"".join(t.encode() for _, t in docs), np.uint8), np.full(30, 151), np.arange(30), 50)
    assert table.count.sum() == 30 * 151
    found = bwt_repeats.repeated_bytes(rows(docs)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute_removed(docs)
