"""Small tables with the cases that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} of the long text {i}" for i in range(4000))
ODD = [None, "", " \n\t ", "é", "One two three.", "One two three.", "a\x00b \x01", "日本語 テスト 🙂", LONG, "x" * 5000,
       "same line\nsame line\nother line", "\n\n"]


def documents(spark, texts, first_id=1, extra=""):
    """doc_id counts from ``first_id``; ``extra`` names one more column of type string."""
    schema = T.StructType(DOCS.fields + ([T.StructField(extra, T.StringType())] if extra else []))
    rows = [(first_id + i, t, "en", "s", len(t) if t else None) + (("kept",) if extra else ())
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def raw(spark, rows):
    """(doc_id, text) rows as they are, nulls and repeats included."""
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
