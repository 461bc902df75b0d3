import pytest

#: Columns that clash with names used inside operators, and a null, empty, repeated and long text.
ODD = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, " \t\n"), (5, "x" * 300_000), (None, "one two three four five six"), (6, "é ñ 日本 " * 40), (None, "another text without an id"), (3, "another text under one id")]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows and clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("lang", "source", "_id", "_row", "id", "line", "rep", "root", "h", "c", "n", "k", "bands", "_t", "_h", "key", "first", "toxic", "score", "ranges")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, int(i > 10 and i % 3 == 0)) for i in range(100)] + [(1, 0, None), (None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
