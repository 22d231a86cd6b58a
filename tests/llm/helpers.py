"""Small frames for the training-data tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang) as a documents table with a column that clashes with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).selectExpr("*", "'x' AS score", "'y' AS digest", "7 AS shard", "'z' AS fp")


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "a b c d e"), (6, "A B c d e"),
    (7, "…«é» 中文 ñandú ı İ ſ K"), (8, "x" * 40_000), (9, "word " * 20_000), (10, "end.\n\nNew  para   graph \n x"), (11, "<|endoftext|> it's <s> ▁ tab\there"),
]
