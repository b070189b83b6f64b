import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, salt int, key string, node bigint, row bigint, word string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts or (doc_id, text, lang, source), with extra columns whose names operators use themselves."""

    def make(rows):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else r
            doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text), "x", 1, "k", 7, 9, "w"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def sample():
    """Texts of the small test table, if it is there."""
    import duckdb

    return duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
