import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with columns whose names
    clash with those of results."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DDL)
        return df.withColumn("kept", F.lit("x")).withColumn("score", F.lit("y")).withColumn("shard", F.lit(0)).withColumn("tokens", F.lit("z"))

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, white space, ties, repeated rows, control characters, scripts,
    special strings, one very long word and one very long text."""
    words = "the quick brown fox, jumps over it's lazy dog’s 123 naïve 東京 🙂 tabs\tand\nlines  ".split(" ")
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "it's 'RE fine.\n\n  'tis  <|endoftext|> x"), (4, "it's 'RE fine.\n\n  'tis  <|endoftext|> x"), (5, "a" * 5000),
        (6, " ".join(words * 400)), (None, "no id here"), (7, "\x00\x1f  é ‍"), (8, "worthless | a | b ### $$$"),
    ]
