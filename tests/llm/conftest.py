from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: What every operator must take: null and empty texts, blanks only, repeated rows,
#: a null id, a long text, and one without a blank.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "Same words here, twice."), (4, "Same words here, twice."), (None, "no id at all"), (None, None),
    (5, "word " * 5000), (6, "x" * 3000), (7, "Ünïcode ﬁ 漢字 🙂 ▁     end"), (8, "a\n\nb\n\n\nc"), (9, "A b C"),
]


@pytest.fixture
def docs(spark):
    def make(rows, schema=SCHEMA):
        rows = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])


@pytest.fixture
def clashing(spark):
    """A table whose other columns have the operators' names."""
    names = "n_words n_tokens row run digest held_out score fp symbols sid blob words h1 c key part label component_id kept n".split()
    return lambda rows: spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
