"""Small tables for the tests of the training-data operators."""

DDL = "doc_id long, text string, lang string, source string, n_chars long"
# Columns with the names that operators give to columns of their own.
CLASHES = ["size", "copies", "target", "digest", "owner", "key", "cls", "sig", "component", "kept_id", "place", "n"]


def table(spark, rows, clash=False):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DDL)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES]) if clash else df


EDGES = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r", "en", "a"),
    (4, "one", None, "b"),
    (5, "one", "en", None),
    (5, "one", "en", None),
    (None, "one two three four five six", "en", "b"),
    (7, "word " * 60_000, "en", "a"),
    (8, "é" * 70_000, "fr", "a"),
    (9, "123 456 !!!", "en", "b"),
    (10, "a b c 日本語 😀 <|endoftext|> don't", "en", "b"),
]
