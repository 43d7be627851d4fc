"""Fixtures for the corpus operators."""

import pytest

from odweave.llm.common import arrow_ready


@pytest.fixture(autouse=True)
def _arrow(spark):
    arrow_ready(spark)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with the columns of the documents table."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
