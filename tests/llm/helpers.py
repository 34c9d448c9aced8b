DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (None, "a null id with some words in it"), (4, long), (4, long), (5, "x" * 50_000), (6, None, None, None), (7, "one two three", None, "s")]
    df = docs_frame(spark, rows)
    for name in ("n_words", "kept", "lang_pred", "tkey", "label", "h", "node", "rate", "tokens", "item_id", "rows", "n", "known", "score"):
        df = df.withColumn(name, F.lit("extra"))
    return df
