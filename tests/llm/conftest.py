import pytest


@pytest.fixture
def texts(spark):
    """Rows of (doc_id, text) with an extra column whose name clashes."""

    def make(rows):
        return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")

    return make
