"""Small tables for the text operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def docs_of(spark, texts, parts=3, **columns):
    """A documents table; texts are texts or (doc_id, text) pairs."""
    rows = []
    for i, t in enumerate(texts):
        doc, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc, text, columns.get("lang", "en"), columns.get("source", "s"), None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCS).repartition(parts)


#: NULLs in every column, empty, blank and long texts, ties and repeated rows.
def odd_docs(spark):
    long = "word " * 50_000
    rows = [(1, None, None, None, None), (None, "a text without an id of its own", None, "s", 3), (2, "", "en", None, 0), (3, " \n\t ", "en", "s", 4),
            (4, long, "en", "s", len(long)), (5, "one two three four five six seven", "en", "s", 33),
            (5, "one two three four five six seven", "en", "s", 33), (5, "other text of the same id", "en", "s", 25),
            (6, "\x00\x1c ﷽ 漢字かな交じり文 مرحبا é é", "xx", "s", 9), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """Extra columns that are called like results and helpers of the operators."""
    from pyspark.sql import functions as F
    names = ["n_words", "n_cut", "cut_id", "cut_places", "text_hash", "mark_a", "mark_b", "n_replaced", "pii_hits", "chunk_t",
             "n_cut_bytes", "spans", "items", "row", "key", "label", "t", "hit", "over", "go", "cut", "kept", "ids"]
    return df.withColumns({n: F.lit(n) for n in names})
