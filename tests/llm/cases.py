"""Rows that every operator must bear: nulls anywhere, blank, long and repeated texts, and columns with names that clash."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (None, "a row without an id but with words in it", "en", None, 1),
    (901, None, None, None, None),
    (902, "", "en", "s", 0),
    (903, " \n\t ", "en", "s", 4),
    (904, "### $$$ %%%", "xx", "s", 11),
    (905, "word " * 40_000, "en", "s", 200_000),
    (906, "x" * 3_000, "de", "s", 3_000),
    (907, "twice the very same row of words", "en", "s", 1),
    (907, "twice the very same row of words", "en", "s", 1),
    (908, "日本語 текст עברית \U0001f600 \x00\x01 é", None, "s", 9),
]


def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("row", "sig", "grp", "id", "key", "bucket", "digest", "tokens", "__text", "__id", "n_tokens", "item_id", "family", "media")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
