import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with an extra column and one whose name operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.selectExpr("*", "'x' AS bucket", "1 AS length") if extra else df

    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "no id here"), (5, "a b c d e f g"), (6, "long " * 20000), (7, "x" * 50000), (8, "naïve café — 日本語 😀 ｱ"), (9, "a b c d e f g")]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
