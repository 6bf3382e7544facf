import pytest

#: Columns that clash with names the operators use.
EXTRA = "lang string, source string, n_chars long, n_words string, kept string, score string, component_id string, ids string"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "q", "q", "q", "q", "q") for i, t in rows], f"doc_id long, text string, {EXTRA}")

    return make
