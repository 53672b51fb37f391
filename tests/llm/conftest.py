import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(rows): documents of (doc_id, text[, source]) with extra columns whose names clash with others or with results."""

    def build(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for n in ("keep_id", "fingerprint", "size", "id", "score", "__fp", "bucket", "component_id", "taken", "TEXT2"):
                df = df.withColumn(n, F.lit("x"))
            df = df.toDF(*["TEXT" if c == "TEXT2" else c for c in df.columns])
        return df

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, repeated, tied, very long and non-ASCII texts."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(0, None, None), (1, "", "a"), (2, " \t\n", "b"), (3, "one two  three", "a"), (4, "one two three", "a"), (4, "one two three", "a"), (None, "one two three", None), (5, long, "b"), (6, "x" * 200_000, "b"), (7, "grün Straße 漢字 😀 mixed", None), (-8, "one\ttwo three", "c"), (9, "Alone.", "c")]
