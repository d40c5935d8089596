"""Small documents with nulls, empty texts, repeated rows and a column whose name clashes."""

import pytest

from samples import prose


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator has to bear."""
    rows = [(1, None, None, None, 0), (2, "", "en", "s", 1), (3, " \n\t ", "xx", "s", 2), (4, "one", "en", None, 3), (5, prose(5, 30_000), "en", "s", 4), (6, prose(6, 80), "fr", "s", 5), (7, prose(6, 80), "fr", "s", 6)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, spans int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
