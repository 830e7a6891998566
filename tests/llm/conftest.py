import pytest
from hypothesis import settings

# A first example loads a vocabulary; how long that takes says nothing of its result.
settings.register_profile("untimed", deadline=None)
settings.load_profile("untimed")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, extra=False):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:  # columns with the names of outputs and of what happens inside
            for c in ("kept", "fp", "part", "score", "n_words", "spans", "component_id", "blob", "sequence_id", "rep", "a"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty, blank, repeated rows, a long text, clashing columns."""
    long = "stop and go on with it then " * 20_000
    return make_docs([None, "", " \n\t ", "Some text here.", "Some text here.", "ünï ÇØDÉ 🎉 words", long, "x"], [1, 2, 3, 4, 4, None, 7, 8], extra=True)
