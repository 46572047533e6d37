"""Licence scan: known licence sentences, and ordered rules over their sequence.

Everything here is a column expression; the same tables give the SQL counterpart.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde.functions.staging import computed_once

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences with one of these speak of licences.
STEMS = ("licen", "copyright", "reserved", "warrant", "permission", "redistribution", "public domain")
#: Known sentences without one of STEMS have one of these.
MORE_STEMS = ("in no event shall", "creative commons", "cc by", "cc attribution", "cc0 1.0", "cc0 universal", "cc0 dedication")

def _versioned(name: str, version: str) -> tuple[str, str]:
    """A licence of the GNU project and its version, next to each other or after who publishes it."""
    return rf"{name},? (version|v) ?{version}", rf"{name},? as published by .*(version|v) ?{version}"


_GNU = r"gnu {}general public licen[sc]e"
_WORD = r"[a-z0-9+-]+(\.[a-z0-9+-]+)*"
_SPDX = rf"spdx-license-identifier: ?({_WORD}( (or|and|with) {_WORD})*)"
#: Identifier and patterns of known sentences; the first that fits names the sentence.  In a
#: pattern .* stands between parts that are looked for one behind the other.
SENTENCES = (
    ("SPDX", _SPDX),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("BSLGrant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose"),
    ("ZlibNoWarranty", r"this software is provided .?as-is.?, without any express or implied warranty"),
    ("OFL", r"sil open font licen[sc]e,? (version|v) ?1\.1"),
    ("ArtisticVer2", r"artistic licen[sc]e,? ?(version|v)? ?2\.0"),
    ("EPLVer2", r"eclipse public licen[sc]e,? ?(-|version)? ?(v ?)?2\.0"),
    ("EPLVer1", r"eclipse public licen[sc]e,? ?(-|version)? ?(v ?)?1\.0"),
    ("EUPL", r"european union public licen[sc]e"),
    ("WTFPL", r"do what the fuck you want to public licen[sc]e"),
    ("ApacheVer2", r"licensed under (the )?apache (software )?licen[sc]e,? ?(version|v) ?2(\.0)?"),
    ("ApacheWarranty", r"software distributed under the licen[sc]e is distributed on an .?as is.? basis"),
    ("LGPLVer", _versioned(_GNU.format("(lesser|library) "), r"[23](\.[01])?")),
    ("AGPLVer3", _versioned(_GNU.format("affero "), r"3(\.0)?")),
    ("GPLVer3", _versioned(_GNU.format(""), r"3(\.0)?")),
    ("GPLVer2", _versioned(_GNU.format(""), r"2(\.0)?")),
    ("LGPLAny", _GNU.format("(lesser|library) ")),
    ("AGPLAny", _GNU.format("affero ")),
    ("GPLAny", _GNU.format("")),
    ("LaterVersion", r"\(?at your option\)? any later version of the licen[sc]e"),
    ("MPLVer2", r"mozilla public licen[sc]e,? (version|v\.?) ?2\.0"),
    ("CCByNcSa", r"(creative commons|cc) (attribution|by)-(noncommercial|nc)-(sharealike|sa)"),
    ("CCByNc", r"(creative commons|cc) (attribution|by)-(noncommercial|nc)"),
    ("CCBySa", r"(creative commons|cc) (attribution|by)-(sharealike|sa)"),
    ("CCBy", r"licensed under (a |the )?(creative commons|cc) (attribution|by)"),
    ("CC0", r"(cc0|public domain) (1\.0 )?(universal|dedication)"),
    ("PublicDomain", r"(released|placed) (in|into|to) the public domain"),
    ("MITName", r"(released|licensed|available|distributed) under the (terms of the )?mit licen[sc]e"),
    ("MITGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MITNotice", r"copyright notice and this permission notice shall be included in all copies"),
    ("ISCGrant", r"permission to use, copy, modify, and(/or)? distribute this software .*is hereby granted"),
    ("BSDSource", r"redistributions? of source code must retain the above copyright notice"),
    ("BSDBinary", r"redistributions? in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", r"endorse or promote products derived from this software without .*permission"),
    ("BSDName", r"(released|licensed|available|distributed) under the (terms of the )?([0-9]-clause )?bsd licen[sc]e"),
    ("NoWarranty", r"provided .*as is.* without (any )?(express or implied )?warrant(y|ies)"),
    ("SeeLicense", r"see the (file )?licen[sc]e( file)?"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (\(c\) )?[0-9]{4}"),
)

#: Licence and the sequence of identifiers that makes it, each followed by a comma; tried in
#: this order, and what a rule takes is not there for later ones.
RULES = (
    ("BSD-3-Clause", "BSDSource,BSDBinary,BSDEndorse,(NoWarranty,)?"),
    ("BSD-2-Clause", "BSDSource,BSDBinary,(NoWarranty,)?"),
    ("BSD", "BSDName,"),
    ("MIT", "MITGrant,(MITNotice,)?(NoWarranty,)?"),
    ("MIT", "MITName,"),
    ("ISC", "ISCGrant,(NoWarranty,)?"),
    ("Apache-2.0", "ApacheVer2,(ApacheWarranty,)?"),
    ("AGPL-3.0", "AGPLVer3,"),
    ("LGPL", "LGPLVer,(LaterVersion,)?"),
    ("GPL-3.0-or-later", "GPLVer3,LaterVersion,"),
    ("GPL-3.0", "GPLVer3,"),
    ("GPL-2.0-or-later", "GPLVer2,LaterVersion,"),
    ("GPL-2.0", "GPLVer2,"),
    ("GPL", "GPLAny,(LaterVersion,)?"),
    ("MPL-2.0", "MPLVer2,"),
    ("CC-BY-NC-SA", "CCByNcSa,"),
    ("CC-BY-NC", "CCByNc,"),
    ("CC-BY-SA", "CCBySa,"),
    ("CC-BY", "CCBy,"),
    ("CC0", "CC0,"),
    ("public-domain", "PublicDomain,"),
    ("SPDX", "SPDX:[^,]*,"),
    ("Unlicense", "Unlicense,(NoWarranty,)?(NoLiability,)?"),
    ("BSL-1.0", "BSLGrant,(NoWarranty,)?"),
    ("Zlib", "(ZlibNoWarranty,)?ZlibGrant,"),
    ("OFL-1.1", "OFL,"),
    ("Artistic-2.0", "ArtisticVer2,"),
    ("EPL-2.0", "EPLVer2,"),
    ("EPL-1.0", "EPLVer1,"),
    ("EUPL", "EUPL,"),
    ("WTFPL", "WTFPL,"),
    ("see-file", "SeeLicense,"),
    ("proprietary", "(Copyright,)?AllRights,"),
)
UNKNOWN = "Unknown"

_LATER = r"either (version|v) ?{} of the licen[sc]e,? or,? \(?at your option\)?,? any later version"
#: Sentences of the standard notices, tried before SENTENCES.
NOTICES = (
    ("LGPLOrLater", _GNU.format("(lesser|library) ") + ".*any later version"),
    ("AGPLOrLater", _GNU.format("affero ") + ".*any later version"),
    ("GPLVer3OrLater", _versioned(_GNU.format(""), r"3(\.0)?.*any later version")),
    ("GPLVer2OrLater", _versioned(_GNU.format(""), r"2(\.0)?.*any later version")),
    ("Ver3OrLater", _LATER.format(r"3(\.0)?")),
    ("Ver2OrLater", _LATER.format(r"2(\.[01])?")),
    ("GnuHope", r"in the hope that it will be useful, but without any warranty"),
    ("GnuImplied", r"without even the implied warranty of merchantability"),
    ("GnuAddress", r"see <?https?://www\.gnu\.org/licenses"),
    ("ApacheUse", r"you may not use this file except in compliance with the licen[sc]e"),
    ("ApacheSee", r"see the licen[sc]e for the specific language governing permissions"),
    ("NoLiability", r"in no event shall the (authors|copyright (holder|owner))"),
    ("Disclaimer", r"provided by .*as is.* and any express or implied warranties"),
)
# behind a GNU notice: what it says of warranty, and references to the licence it names
_TAIL = "(GnuHope,(GnuImplied,)?({},)*(GnuAddress,)?)?"
#: Rules with NOTICES, tried before RULES.
NOTICE_RULES = (
    ("Apache-2.0", "ApacheVer2,(ApacheUse,)?(ApacheWarranty,)?(ApacheSee,)?"),
    ("AGPL-3.0-or-later", "(AGPLOrLater|AGPLAny,Ver3OrLater|AGPLVer3,LaterVersion)," + _TAIL.format("AGPLAny")),
    ("AGPL-3.0", "AGPLVer3,GnuHope,(GnuImplied,)?(AGPLAny,)*(GnuAddress,)?"),
    ("LGPL", "(LGPLOrLater|LGPLAny,Ver[23]OrLater|LGPLVer,LaterVersion|LGPLVer)," + _TAIL.format("(LGPLAny|GPLAny)")),
    ("GPL-3.0-or-later", "(GPLVer3OrLater|GPLAny,Ver3OrLater|GPLVer3,LaterVersion)," + _TAIL.format("GPLAny")),
    ("GPL-3.0", "GPLVer3,GnuHope,(GnuImplied,)?(GPLAny,)*(GnuAddress,)?"),
    ("GPL-2.0-or-later", "(GPLVer2OrLater|GPLAny,Ver2OrLater|GPLVer2,LaterVersion)," + _TAIL.format("GPLAny")),
    ("GPL-2.0", "GPLVer2,GnuHope,(GnuImplied,)?(GPLAny,)*(GnuAddress,)?"),
    ("AGPL", "AGPLAny,"),
    ("LGPL", "LGPLAny,"),
    ("see-file", "ApacheSee,"),
)
#: Markers of comments at the beginning and the end of a line, once runs are cut short.
_RUNS = ((r"\*\*+", "*"), (r"---+", "--"))
_MARKS = (
    r"(?m)^[\x20\t]*(/\*!?|\*/|\*([\x20\t]|$)|#+|//+!?|--+|;+|%+|<!--+|(rem|dnl)[\x20\t])",
    r"(?m)(\*/|-->)[\x20\t]*$",
)


def _candidate(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in STEMS + MORE_STEMS])


def sentences(text: Column) -> Column:
    """Sentences with a stem of a lower-cased text, whose lines end with line feeds: comment
    markers of lines are left out, white space is one blank, and a sentence ends behind
    . ! ? : or ; and a blank.  `spdx-license-identifier:` and `v.` before a number are no end."""
    flat = text
    for pattern, short in _RUNS:
        flat = F.regexp_replace(flat, pattern, short)
    for pattern in _MARKS:
        flat = F.regexp_replace(flat, pattern.replace("(?m)", "(?md)"), " ")  # d: only line feeds end lines
    flat = F.regexp_replace(flat, r"[\x00-\x20]+", " ")
    flat = F.regexp_replace(flat, r"(^|[^a-z0-9_])v\. ([0-9])", "$1v.$2")
    flat = F.replace(flat, F.lit("identifier: "), F.lit("identifier:"))
    parts = F.split(F.regexp_replace(flat, r"([.!?:;]) ", "$1\u0001"), "\u0001")
    return F.filter(parts, _candidate)


def _patterns(known: str | tuple[str, ...]) -> tuple[str, ...]:
    return (known,) if isinstance(known, str) else known


def linear(pattern: str) -> str:
    """The pattern for an engine that backtracks: each part is found where it comes first
    behind the one before it, and never looked for again."""
    parts = pattern.split(".*")
    return pattern if len(parts) == 1 else "(?s)^" + "".join(f"(?>.*?{part})" for part in parts)


def _identifier(sentence: Column) -> Column:
    named = None
    for name, known in NOTICES + SENTENCES:
        fits = reduce(lambda a, b: a | b, [sentence.rlike(linear(p)) for p in _patterns(known)])
        value = F.concat(F.lit("SPDX:"), F.regexp_extract(sentence, _SPDX, 1)) if name == "SPDX" else F.lit(name)
        named = F.when(fits, value) if named is None else named.when(fits, value)
    return named.otherwise(UNKNOWN)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: identifiers of its licence sentences in order, and the licences found.

    docs needs doc_id and text; other columns are not read.  sentence_ids has `Unknown` for
    sentences that speak of licences but aren't known; licenses names every rule that
    matched, in the order of the rules; an SPDX line counts as the expression it holds.
    Null and empty texts have none of them; repeated rows each get their row, no rows give
    none.  A text takes time in proportion to its length.
    """
    lowered = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), _UPPER + "\r", _LOWER + "\n").alias("_text"))
    ids = F.transform(sentences(F.col("_text")), _identifier)
    found = computed_once(lowered, _ids=ids).drop("_text")
    # every identifier ends with a comma, so that a sequence matches whole identifiers
    joined = F.when(F.size("_ids") > 0, F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))).otherwise(F.lit(","))
    some = found.withColumn("_left", joined).withColumn("_names", F.array().cast("array<string>"))
    for name, rule in NOTICE_RULES + RULES:
        hit = F.col("_left").rlike(f",{rule}")
        found_names = F.regexp_extract_all("_left", F.lit(r",SPDX:([^,]+)"), F.lit(1)) if name == "SPDX" else F.array(F.lit(name))
        some = computed_once(
            some,
            _names=F.when(hit, F.concat("_names", found_names)).otherwise(F.col("_names")),
            _left=F.when(hit, F.regexp_replace("_left", f",{rule}", ",|,")).otherwise(F.col("_left")),
        )
    unknown = F.size(F.filter("_ids", lambda i: i == UNKNOWN)).cast("long")
    return some.select(
        "doc_id",
        (F.size("_ids") - unknown).cast("long").alias("n_known"),
        unknown.alias("n_unknown"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("_names"), ",").alias("licenses"),
    )


def oracle() -> str:
    """The scan as one SQL statement over `documents`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    stems = " OR ".join(f"contains(s, {quoted(stem)})" for stem in STEMS + MORE_STEMS)
    cases = []
    for name, known in NOTICES + SENTENCES:
        fits = " OR ".join(f"regexp_matches(s, {quoted(p)})" for p in _patterns(known))
        value = f"'SPDX:' || regexp_extract(s, {quoted(_SPDX)}, 1)" if name == "SPDX" else quoted(name)
        cases.append(f"WHEN {fits} THEN {value}")
    steps = []
    for i, (name, rule) in enumerate(NOTICE_RULES + RULES):
        pattern = quoted("," + rule)
        names = "regexp_extract_all(rest, ',SPDX:([^,]+)', 1)" if name == "SPDX" else f"[{quoted(name)}]"
        steps.append(
            f"r{i + 1} AS (SELECT doc_id, ids, regexp_replace(rest, {pattern}, ',|,', 'g') AS rest, "
            f"CASE WHEN regexp_matches(rest, {pattern}) THEN names || {names} ELSE names END AS names FROM r{i})"
        )
    flat = "text"
    for pattern, short in [*_RUNS, *((m, " ") for m in _MARKS), (r"[\x00-\x20]+", " "), (r"(^|[^a-z0-9_])v\. ([0-9])", r"\1v.\2")]:
        flat = f"regexp_replace({flat}, {quoted(pattern)}, {quoted(short)}, 'g')"
    return f"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}' || chr(13), '{_LOWER}' || chr(10)) AS text FROM documents),
flat AS (SELECT doc_id, replace({flat}, 'identifier: ', 'identifier:') AS text FROM lowered),
parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?:;]) ', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: {stems}) AS parts FROM flat),
named AS (SELECT doc_id, list_transform(parts, lambda s: CASE {" ".join(cases)} ELSE '{UNKNOWN}' END) AS ids FROM parts),
r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',') || ',' ELSE ',' END AS rest,
    CAST([] AS VARCHAR[]) AS names FROM named),
{", ".join(steps)}
SELECT doc_id, len(list_filter(ids, lambda i: i <> '{UNKNOWN}')) AS n_known,
    len(list_filter(ids, lambda i: i = '{UNKNOWN}')) AS n_unknown,
    array_to_string(ids, ',') AS sentence_ids,
    coalesce(array_to_string(list_filter(names, lambda n, i: list_position(names, n) = i), ','), '') AS licenses
FROM r{len(NOTICE_RULES + RULES)}
"""
