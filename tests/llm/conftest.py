from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "id string, score string, taken string, bands string, size string, turn string, row string, key string, held_out string, label string, n string, home string, component string"


@pytest.fixture
def docs(spark):
    """A function that makes documents from texts or (doc_id, text[, lang[, source]]) rows, with columns whose names clash."""

    def make(*rows):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            doc_id, text, lang, source = (*r, *("en", "s")[len(r) - 2 :])
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *(f"'x' as {c.split()[0]}" for c in CLASH.split(", ")))

    return make
