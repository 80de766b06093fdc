import pytest

from mailmill.llm.tables import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs."""
    ship(spark)

    def make(rows):
        whole = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(whole, SCHEMA)

    return make


