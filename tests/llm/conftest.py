from __future__ import annotations

import pytest

from prudentia.llm.common import let_workers_import

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, key int, size string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names operators use themselves."""
    let_workers_import(spark)

    def made(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y") for r in rows], SCHEMA)

    return made


@pytest.fixture
def odd(documents):
    """NULLs everywhere, empty and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat " * 20, "en", "a"), (1, "the cat sat on the mat " * 20, "en", "a"), (2, None, "en", "a"),
            (3, "", None, None), (None, "some text without a number", "xx", "b"), (4, long, "en", None), (5, " \n\t ", "de", "c")]
    return documents(rows), documents([])
