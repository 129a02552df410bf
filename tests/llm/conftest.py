import pytest

#: Columns that operators use themselves, and that input tables may have as well.
CLASHING = ("size", "score", "label", "kept", "id", "copies", "n_lines", "_k", "_h", "rank", "text_crc32", "batch", "_id")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text, source), with columns whose names clash."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHING})

    return make
