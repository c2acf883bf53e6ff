from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, rank int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with further columns whose names operators might use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 7) for i, t, s in ((*r, "src0")[:3] for r in rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make
