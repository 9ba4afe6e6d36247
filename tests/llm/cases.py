"""Rows with nulls, empty and long texts, ties and repeats that every operator has to take."""

from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, h1 string, n_lines string"


def odd_docs(spark, texts=()):
    """The odd rows, with extra columns whose names clash with names the operators use, and ``texts`` from id 100 on."""
    rows = [
        (1, None, "en", "s1"), (2, "", None, None), (3, " \t\n ", "en", "s1"), (4, "one", "en", "s2"), (4, "one", "en", "s2"),
        (5, "one", None, "s3"), (None, "one two three four five", "en", "s1"), (6, "12 % $ éÉ \U0001f600 end\n\n\nend", "fr", "s1"),
        (7, "word " * 3000, "en", "s1"), (8, "x" * 5000, "de", "s1"), (9, "á \x85 \xa0 \x1c tail\r\nTAIL", "en", "s9"),
    ]
    rows += [(100 + i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame([(*r, 0, "clash", "clash") for r in rows], DDL)


def no_docs(spark):
    return spark.createDataFrame([], DDL)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect()), key=repr)
