import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s", extra=False):
    rows = [(i, t, "en", source, len(t) if t else 0) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names the operators use themselves
        from pyspark.sql import functions as F

        for c in ("shard", "slot", "size", "rank", "piece", "sequence_id", "score", "n_removed", "kept_text", "rate", "tokens", "class_id", "h1", "sim", "spans", "part"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def docs(spark):
    return lambda *a, **k: documents(spark, *a, **k)


#: Nulls, empty and blank texts, one without spaces, repeated rows, equal texts.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "x" * 5000), (5, "a b"), (5, "a b"), (None, "a b"), (None, None), (6, "\n\n"), (7, "one two three four five six seven"), (8, "one two three four five six seven"), (9, "é　知识 <|endoftext|> \x00 z")]
