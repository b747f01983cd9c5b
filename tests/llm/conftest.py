import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: What every operator must take: nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [(1, "a b c d e f", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no id here at all", "en", None),
       (4, " \t\n ", "de", "s"), (5, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (6, "one two\n" * 5000, "fr", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use for their own columns.
CLASHES = ("score", "fp", "gram", "name", "doc", "node", "line", "words", "kept", "n", "spans", "root", "stratum", "_rank", "slot")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
