import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empties, ties, repeated rows, long texts, a null id, odd white space.
ROWS = [
    (1, "The same first line here\nAnother line of text", "en", "a", 1), (2, "The same first line here\nUnique words only in two", "en", "a", 2),
    (3, None, None, None, None), (4, "", "en", None, 0), (5, "   \t ", None, "b", 5), (6, "12345 !!! ???", "en", "b", 5),
    (2, "The same first line here\nUnique words only in two", "en", "a", 2), (None, "A text without any id at all", "en", "c", 9),
    (7, "Das ist ein deutscher Text über Grüße und schöne Häuser", "de", "c", 9), (8, "word " * 30_000, "en", "c", 9),
    (9, "\x0b the SAME first line here \r\nx\nx\n", "en", "a", 3), (2, "Another text under an id used before", "en", "a", 2),
]


@pytest.fixture()
def edge(spark):
    """Rows of every odd kind, with extra columns whose names clash with results' columns."""
    df = spark.createDataFrame(ROWS, DOCS)
    clash = ["lang_pred", "score", "fp", "fingerprint", "component_id", "keep", "kind", "pos", "size", "copies", "target", "n_words", "hit", "items", "term", "n", "doc"]
    for c in clash:
        df = df.selectExpr("*", f"'x' as {c}")
    return df


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)

