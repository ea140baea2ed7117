import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew some very strange potion near an old stone bridge"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash."""
    rows = [(1, BASE), (2, BASE.upper()), (3, BASE + " tonight"), (4, None), (5, ""), (6, " \t\n"), (7, LONG), (8, LONG + " end"),
            (9, "short text"), (10, "short  text"), (11, BASE), (11, BASE), (None, BASE), (None, None), (12, "über naïve façade 日本語 text"), (13, "!!! ??? 123")]
    rows = [(d, t, None if d == 3 else "en", None, None, True, 7, "x", -1, "y", 0.5, 1, "z") for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id long, "
                                       "text_sha256 string, component_id long, rid string, score double, f int, body string")


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
