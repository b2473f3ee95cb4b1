import pytest


@pytest.fixture(scope="session")
def tables():
    import oracle

    return oracle.connect("/root/testdata/sf0.001")


@pytest.fixture
def rows(spark):
    """Documents from ``(doc_id, text, ...)`` tuples."""

    def make(values, schema="doc_id long, text string"):
        return spark.createDataFrame(values, schema)

    return make
