import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, source]) with the columns of documents and one clashing extra column."""
    def _make(rows, extra="n_words"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra} string")
    return _make
