import pytest

#: Columns beside those of ``documents`` whose names the operators use themselves.
EXTRA = ["key", "n", "marks", "path", "row", "k", "d", "bucket", "good", "evidence", "host", "span", "score"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, near copies, extra columns."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    long = " ".join(f"x{i % 5000}" for i in range(12_000))
    rows = [
        (1, base), (2, base), (2, base), (3, base.replace("w30", "changed")), (4, None), (5, ""), (6, " \t\n"), (7, "one two three"), (8, "one two three"),
        (9, long), (None, base), (10, "Ünïcode ÄÖ ß " + base.upper()), (11, "the same word " * 40), (7, "one two three"),
    ]
    frame = spark.createDataFrame([(i, t, None if i in (3, None) else "en", None if i == 9 else "src1", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA:
        frame = frame.withColumn(name, F.lit(7))
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 1), (11, 0, 1), (None, 1, 1), (2, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
