import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame of documents with extra columns whose names clash with those of results."""

    def make(texts, parts=4, first=0):
        data = [(first + i, t, "kept", i * 10, -1) if not isinstance(t, tuple) else (t[0], t[1], "kept", 0, -1) for i, t in enumerate(texts)]
        return spark.createDataFrame(data, "doc_id long, text string, score string, n_chars long, n_hit int").repartition(parts)

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
