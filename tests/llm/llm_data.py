"""Where the smallest test tables are, and tables made of (doc_id, text) rows."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def documents(spark):
    """Makes a table of (doc_id, text, source, n_chars) rows."""
    def make(rows):
        return spark.createDataFrame([(i, t, f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)],
                                     "doc_id long, text string, source string, n_chars long")
    return make
