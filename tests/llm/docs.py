"""Awkward documents that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, ids string, score double"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\n\nIt's  here, isn't it? \t", "en", "a", 1, 1, "x", 0.5),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, 1, "x", None),
    (4, "été 日本語 <|endoftext|> 12345 \U0001f600 fin ", "fr", "b", 3, 1, "x", 0.1),
    (5, "word " * 30_000, "en", "b", 3, 1, "x", 0.1),
    (6, "The quick brown fox jumps over the lazy dog.\n\nIt's  here, isn't it? \t", "en", "a", 1, 1, "x", 0.5),
    (6, "The quick brown fox jumps over the lazy dog.\n\nIt's  here, isn't it? \t", "en", "a", 1, 1, "x", 0.5),
    (None, "no id", "en", "a", 1, 1, "x", 0.5),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
