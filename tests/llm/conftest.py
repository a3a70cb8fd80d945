import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) with the columns of documents and a clashing extra one."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", fp string, n long" if extra else "")
        tail = ("x", 7) if extra else ()
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *tail) for i, t in rows], schema)

    return make
