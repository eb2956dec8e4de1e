import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from critiq.session import get_spark  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own results.
CLASH = ("size", "fp", "component_id", "n_lines", "n_removed", "removed", "score", "lang_pred", "copy", "base",
         "all_spans", "target", "copies", "key", "a", "b", "h", "n", "r", "k", "w", "pos", "at", "rank", "source_size")


@pytest.fixture(scope="session")
def spark():
    return get_spark(cores="4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def long_text():
    return " ".join(f"word{k % 5000} other{k % 37}." if k % 11 else f"line{k}\nnext" for k in range(60_000))


@pytest.fixture(scope="session")
def messy(spark, long_text):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    passage = "One passage of ten words and more stands in here. It goes on for a second sentence. And a third one."
    rows = [
        (1, passage, "en", "a", 5), (2, passage, "en", "a", 5), (2, passage, "en", "a", 5),
        (3, "x " + passage + " tail of three", "en", "b", 5), (4, None, "en", "a", 0), (5, "", None, "b", 0),
        (None, "a text without an id but with words enough to count.", "en", None, None),
        (None, None, None, None, None), (6, " \n\t \n", "de", None, 1), (7, "12 34", "fr", "a", 1),
        (8, long_text, "en", "a", len(long_text)), (9, "same id, first text of these two", "en", "b", 1),
        (9, "same id, other text of these two", "en", "b", 1), (10, "Zwölf Boxkämpfer jagen Viktor quer über den Deich.", "de", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in CLASH:
        df = df.withColumn(name, df["text"])
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
