import pytest

#: Columns that operators use inside, and other spellings of their inputs.
CLASHING = "doc_id long, text string, lang string, source string, n_chars int, TEXT string, id long, kept int, words int, row int, spans int, epoch int, domain int, score int, fp int, rk int, key int"


@pytest.fixture(scope="session")
def table(spark):
    """documents of (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def make(rows, parts=3):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "src0")), None if r[1] is None else len(r[1]), "x", 7, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10) for r in rows]
        return spark.createDataFrame(full, CLASHING).repartition(parts)

    return make
