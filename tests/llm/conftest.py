import pytest


@pytest.fixture
def documents(spark):
    """Makes a table of documents from texts; extra columns clash with result columns."""

    def make(texts, langs=None, ids=None):
        rows = [(i if ids is None else ids[k], t, langs[k] if langs else "en", "s", 0, "x", True) for k, (i, t) in enumerate(enumerate(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept boolean")

    return make
