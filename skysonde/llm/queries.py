"""The operators of this subpackage as queries over the driver tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysonde.llm import bwt_repeats, byte_bpe, contamination, disclosure, dual_tree, html_extraction, license_rules, minhash, prefix_trie, quality_fm, secret_forest, url_cascade, voronoi_knn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op4_byte_bpe")
def _(spark, sf):
    ranks = byte_bpe.read_ranks(spark, VOCABULARY)
    rows = byte_bpe.encoded(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return rows.drop("ids")


@query("op5_suffix_decontamination")
def _(spark, sf):
    rows = contamination.overlap_report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return rows.drop("matches")


@query("op6_minhash_near_duplicates")
def _(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


#: Rules of the list, as the contract of the query gives them.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query("op8_url_bloom_cascade")
def _(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_cascade.judged_urls(table(spark, sf, "pages"), rules)


ORACLES["op8_url_bloom_cascade"] = """
WITH rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*', 0, 's') AS raw FROM rests),
parts AS (SELECT page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0, 's') AS path FROM hosts)
SELECT page_id, host, path,
    (SELECT max_by(rh || rp, length(rh || rp)) FROM rules
     WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)) AS rule,
    coalesce((SELECT max_by(rv, length(rh || rp)) FROM rules
     WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)), 'allow') AS verdict
FROM parts
"""


@query("op7_voronoi_top_k")
def _(spark, sf):
    return voronoi_knn.top_k(table(spark, sf, "embeddings"), k=5, every=50)


ORACLES["op7_voronoi_top_k"] = """
WITH valid AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


@query("op9_factorisation_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_fm.scored(docs, quality_fm.trained(docs, table(spark, sf, "labels")))


@query("op2_disclosure_pii")
def _(spark, sf):
    return disclosure.personal_data(table(spark, sf, "documents"))


@query("op1_license_sentences")
def _(spark, sf):
    return license_rules.license_scan(table(spark, sf, "documents"))


ORACLES["op1_license_sentences"] = license_rules.oracle()


@query("op3_secret_forest")
def _(spark, sf):
    return secret_forest.secret_scan(table(spark, sf, "documents"))


@query("op10_bwt_repeats")
def _(spark, sf):
    return bwt_repeats.repeated_bytes(table(spark, sf, "documents")).drop("spans")


@query("op13_html_main_text")
def _(spark, sf):
    return html_extraction.extracted(table(spark, sf, "pages"))


@query("op11_dual_tree_codes")
def _(spark, sf):
    rows, books = dual_tree.compressed(table(spark, sf, "embeddings"))
    return rows.withColumn("codebooks_sha256", F.lit(books.digest if books else ""))


ORACLES["op11_dual_tree_codes"] = dual_tree.oracle()


@query("op12_conversation_trie")
def _(spark, sf):
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


ORACLES["op12_conversation_trie"] = prefix_trie.ORACLE
