import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, source) tuples, with columns that could clash with an operator's own."""

    def make(*rows):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("key", "mark", "recipe", "size", "count", "score", "token", "kept", "_row", "n"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
