import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("score", "size", "component", "words", "key", "row", "label", "rank", "kept", "text_key", "language", "copies"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty cells, blanks, a very long text, repeated rows, ties."""
    long_text = " ".join(f"word{k % 977} of {k}" for k in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, long_text, "en", "b"), (5, same, "en", "b"),
        (6, same, "en", "b"), (6, same, "en", "b"), (7, "few words", None, "c"), (8, "12345 !!!", "de", None), (None, same, "de", "c"),
        (9, "a\x1cb \x0bc é ß 漢字 <|endoftext|>", "zz", "c"),
    ]
