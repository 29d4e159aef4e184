"""Small tables with the cases that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, ids=None, lang="en", source="s"):
    rows = [(i if ids is None else ids[i], t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "word " * 30000
    rows = [(1, "same text here", "en", "a", 14), (1, "same text here", "en", "a", 14), (2, "same  text here", None, None, None), (3, None, "en", "a", 0), (4, "", "fr", "a", 0), (None, "null id", "en", "b", 7), (5, long, "en", "a", 1), (6, long + "x", "de", None, 1), (7, " \n\t ", "de", "a", 1), (8, "Ünï çødé ß 漢字 🙂", None, "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumn("size", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("items", F.lit(2)).withColumn("shard", F.lit(3)).withColumn("score", F.lit(0.5)).withColumn("len", F.lit(9))


def empty(spark):
    return spark.createDataFrame([], DOCS)
