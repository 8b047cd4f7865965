import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, ...) with hard cases: nulls, empty and long texts, repeated rows, extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return df
        return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars",
                             "1 as score", "'x' as key", "2 as size", "'y' as band", "'z' as spans", "3 as n", "4 as pattern")

    return make
