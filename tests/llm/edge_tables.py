"""Small tables with every odd case, and columns whose names clash with what operators use inside."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(120_000))
CLASHING = ("id", "text_sha256", "keep_id", "kept", "h", "head", "hot", "salt", "size", "taken", "target", "_draw", "_slice", "_rank", "n", "d1",
            "sigs", "node", "hub", "component", "score", "_score", "label", "features", "x", "unit", "rank", "a", "b", "start", "length", "ids",
            "file", "value", "key", "keeper", "bytes", "draw", "seq", "s", "m")

DOCS = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "One two three four five six.", "b"), (5, "One two three four five six.", "b"),
        (5, "One two three four five six.", "b"), (6, LONG, "a"), (7, LONG + " more", "a"), (None, "no id here", "b"), (None, None, None),
        (8, "one", None), (9, "ünï cödé %%% 日本 \U0001F600", "c"), (10, LONG, "c")]


def documents(spark, rows=None):
    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, source string")
    df = df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(7) for c in CLASHING})


def empty(df):
    return df.limit(0)
