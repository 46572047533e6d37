"""Personal data: patterns, and terms that disclose it by co-occurrence in the corpus.

Everything here is a column expression or a DataFrame operation.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysonde.functions.staging import computed_once
from skysonde.llm.common import Scratch

#: A term discloses a kind of personal data if their pointwise mutual information is at
#: least this share of what is to be known about the kind (its information content).
DISCLOSURE = 0.9
#: Different texts that must hold term and kind together, for the estimate to mean anything.
SUPPORT = 20

KINDS = ("email", "ip", "card", "phone")
# Where a run of characters can only match from its beginning, matching starts there (or
# where the last match ended), and runs are taken whole: the matches are the same, without
# trying every later beginning of a long run.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TERM = r"\p{L}{4,}"
LONGEST_TERM = 64
#: Terms that are broadcast at most (about 20 MB); more are joined by shuffle.
BROADCAST_TERMS = 500_000
_SPAN = "array<struct<start:int,end:int>>"


def _located(text: Column, pattern: Column, valid=None) -> Column:
    """Spans (start, end) in code points of the valid matches of a pattern.

    The texts between matches and the matches themselves give the positions.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        use = piece["hit"].isNotNull()
        if valid is not None:
            use = use & valid(piece["hit"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(use, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, empty, step)["out"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def _kinds(text: Column) -> dict[str, Column]:
    """Spans of each kind; a cheap look at the text spares most of them the full pattern."""
    none = F.array().cast(_SPAN)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _located(text, F.lit(_EMAIL))).otherwise(none),
        "ip": F.when(
            text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
            _located(text, F.lit(_IP), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        ).otherwise(none),
        "card": F.when(
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _located(text, F.lit(_CARD), _valid_card)
        ).otherwise(none),
        "phone": F.when(
            F.contains(text, F.lit("+")),
            _located(text, F.lit(_PHONE), lambda m: F.length(_digits(m)).between(9, 15)),
        ).otherwise(none),
    }


def _with_kinds(docs: DataFrame, *kept: str) -> DataFrame:
    """Columns `kept`, _text (null as empty), _key of the text, and spans of each kind."""
    text = F.coalesce("text", F.lit("")).alias("_text")
    some = docs.select(*kept, text).withColumn("_key", F.sha2("_text", 256))
    return computed_once(some, **{f"_{k}": c for k, c in _kinds(F.col("_text")).items()})


def _terms(text: Column) -> Column:
    """Distinct terms of a text, lower-cased."""
    words = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) <= LONGEST_TERM), F.lower))


def _disclosing(scratch: Scratch, docs: DataFrame, share: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(texts with personal data, terms that disclose a kind), from counts over all documents.

    With N documents, n(k) with kind k, n(t) with term t and n(t, k) with both,
    PMI(t, k) = log2(N n(t, k) / (n(t) n(k))) is at most log2(N / n(k)), which it is
    when the term is never without the kind.
    """
    held = _with_kinds(docs)
    kinds = F.filter(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    held = held.select("_key", "_text", kinds.alias("kinds")).where(F.size("kinds") > 0)
    held = held.groupBy("_key").agg(
        F.first("_text").alias("_text"), F.first("kinds").alias("kinds"), F.count("*").alias("copies"))
    texts = scratch.table(held, "private")
    paired = texts.select("copies", F.explode("kinds").alias("kind"), _terms(F.col("_text")).alias("terms"))
    paired = paired.select("copies", "kind", F.explode("terms").alias("term")).groupBy("kind", "term")
    # copies of a text are no support
    paired = paired.agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    paired = scratch.table(paired, "co-occurring")
    wanted = paired.select("term").distinct()
    every = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        alone = every.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("alone"))
    else:  # counts per term first, so that the join moves one row for each
        alone = every.groupBy("term").agg(F.count("*").alias("alone"))
    of_kind = texts.select("copies", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.sum("copies").alias("of_kind"))
    joined = paired.join(alone, "term").join(of_kind, "kind").withColumn("total", F.lit(docs.count()))
    information = F.log2(F.col("total") / F.col("of_kind"))
    mutual = F.log2(F.col("total") * F.col("both") / (F.col("alone") * F.col("of_kind")))
    found = joined.where((information > 0) & (mutual >= share * information)).select("kind", "term")
    return texts, scratch.table(found, "disclosing")


def _term_spans(texts: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(_key, _term) with the spans of disclosing terms in texts that hold their kind."""
    held = texts.select("_key", F.explode("kinds").alias("kind"), _terms(F.col("_text")).alias("terms"))
    hits = held.select("_key", "kind", F.explode("terms").alias("term")).join(disclosing, ["kind", "term"])
    hits = hits.groupBy("_key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.concat_ws("|", "terms"), F.lit(r")(?!\p{L})"))
    return texts.join(hits, "_key").select("_key", _located(F.col("_text"), pattern).alias("_term"))


def _named(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _with_kind(kind: str) -> Column:
    return F.transform(
        f"_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def personal_data(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Per document: how much personal data of each kind, a digest of it, and all spans.

    docs needs doc_id and text; other columns are not read.  Null texts count as empty;
    both have no spans, and the digest is that of the empty string.  Spans of disclosing
    terms (kind `term`) come behind those of the patterns.  Copies of a text have the same
    spans; all documents count in the statistics, but a term needs `support` different texts
    with the kind.  Repeated rows each get their row.
    """
    with Scratch(docs.sparkSession) as scratch:
        texts, disclosing = _disclosing(scratch, docs, share, support)
        added = scratch.table(_term_spans(texts, disclosing), "term-spans")
        found = _with_kinds(docs, "doc_id").drop("_text").join(added, "_key", "left")
        base = F.array_join(F.concat(*[_named(k) for k in KINDS]), ",")
        terms = F.coalesce(_named("term"), F.array().cast("array<string>"))
        counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
        out = found.select(
            "doc_id",
            *counts,
            F.sha2(base, 256).alias("base_sha256"),
            F.array_join(F.concat(*[_named(k) for k in KINDS], terms), ",").alias("spans"),
        )
        return scratch.result(out, "personal-data")


def sanitised(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents with personal data generalised to its kind and disclosing terms removed.

    Overlapping spans become one, named by the first.  All columns stay; n_chars, if there,
    is that of the new text.  Texts without spans, null ones too, stay as they are.
    """
    names = docs.columns
    with Scratch(docs.sparkSession) as scratch:
        texts, disclosing = _disclosing(scratch, docs, share, support)
        spans = F.array_sort(F.concat(*[_with_kind(k) for k in (*KINDS, "term")]))
        added = _term_spans(texts, disclosing)
        whole = computed_once(texts.select("_key", "_text"), **{f"_{k}": c for k, c in _kinds(F.col("_text")).items()})
        whole = whole.join(added, "_key", "left").withColumn("_term", F.coalesce("_term", F.array().cast(_SPAN)))
        empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            before = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
            mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(
                s["start"] >= acc["at"], F.struct(F.concat(acc["out"], before, mark).alias("out"), s["end"].alias("at"))
            ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

        def finish(acc: Column) -> Column:
            return F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text")))

        changed = scratch.result(
            whole.select(F.col("_key").alias("_changed"), F.aggregate(spans, empty, step, finish).alias("_new")), "sanitised")
    keyed = docs.withColumn("_changed", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = keyed.join(changed, "_changed", "left").withColumn("text", F.coalesce("_new", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_new").isNull(), F.col("n_chars")).otherwise(
            F.length("_new").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
