"""Documents with every awkward case, shared by the tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string"
LONG = "word of many " * 20_000


def documents(spark, more=()):
    texts = ["", None, " \n\t ", "One", "two words", "same text here and there", "same text here and there", "é ü ß ñ çaux 東京 \U0001f600", "12 345 6.7", "<|endoftext|> inside <|endoftext|>", LONG, "it's they'll  re'd\n\nlast  ", *more]
    rows = [(i, t, "en" if i % 2 else None, None, 1, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None, None, None), (3, "One", "en", None, None, None, None), (3, "One", "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
