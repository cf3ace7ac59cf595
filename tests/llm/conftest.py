from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, __x int, host_rejected boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    prose = " ".join(f"word{i} and" for i in range(60))
    rows = [
        (1, prose, "en", "a", 5, "x", 1, True),
        (1, prose, "en", "a", 5, "x", 1, True),  # a repeated row
        (2, prose, "en", "b", 5, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "a", 0, "", 0, False),
        (5, " \n\t ", "de", "a", 3, "", 0, False),
        (6, "one", None, "a", 3, "", 0, False),
        (7, "spam spam " * 200, "en", None, 3, "", 0, False),
        (None, prose + " tail", "en", "b", 9, "", 0, False),
        (9, "lange wörter über straße " * 30000, "de", "a", 9, "", 0, False),
        (10, "x" * 300000, "fr", "a", 9, "", 0, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)
