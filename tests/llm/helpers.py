"""Small tables with awkward rows, and plain versions of what several operators share."""

import re

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 4000
ROWS = [
    (1, "The cat sat on the mat and looked at the dog in the yard.\nThe dog slept.", "en", "a", 1),
    (1, "The cat sat on the mat and looked at the dog in the yard.\nThe dog slept.", "en", "a", 1),  # a repeated row
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, " \t\n ", "en", "b", 4),
    (5, "one two three", None, "b", 13),
    (6, "Straße  über\tden\u00a0Fluß 日本語 \u3000 x́ <|endoftext|> ▁", "de", "c", 50),
    (7, LONG, "en", "a", len(LONG)),
    (None, "a document that has no number but a few words in it, and so it must not be lost", "en", None, 80),
    (8, "same line\nsame line\nsame line\nother line", "en", "c", 40),
    (9, "w " * 300, "en", "b", 600),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, extra=True):
    """The table; with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS size", "1 AS start", "2 AS id", "3 AS n_words", "4 AS _text", "5 AS `odd.name`", "6 AS key", "7 AS row")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
