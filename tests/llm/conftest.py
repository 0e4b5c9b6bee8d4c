import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang, source)."""
    from drawseries.llm.common import short_batches
    short_batches(spark)

    def make(rows):
        full = [(r + (None,) * 4)[:4] for r in rows]
        return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in full],
                                     DOC_SCHEMA)
    return make


#: Texts every operator has to take: null, empty, white space, one word, repeats, other scripts, long.
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "word"), (4, "word"), (5, "Δοκιμή 試験 🙂 ẞ İ"),
       (6, "a b c d e f g " * 3000), (7, "x" * 20000), (None, "no id"), (8, "12 34 %% --")]
