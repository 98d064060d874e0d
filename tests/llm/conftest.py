import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id long, rid long, node string, class_id long, _kept long, _n long, place int, salt int, score double, predicted int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    tail = ("src", 1, 2, 3, "n", 4, 5, 6, 7, 8, 0.5, 1)
    long = " ".join(f"word{i % 977} and some more text" for i in range(20_000))
    texts = [(1, "a plain sentence about rivers and hills", "en"), (1, "a plain sentence about rivers and hills", "en"), (2, None, None), (3, "", "en"), (None, "a document without a number", "en"), (None, None, None), (4, "12 34 !!", None), (5, long, "en"), (6, "😀 über 水 x".encode("utf-16", "surrogatepass").decode("utf-16"), "de"), (7, "short", "de")]
    return spark.createDataFrame([(i, t, lang, *tail) for i, t, lang in texts], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
