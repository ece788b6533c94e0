import pytest



@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like operators' own."""
    rows = [
        (1, "plain text, Twice.", "a", "en"), (1, "plain text, Twice.", "a", "en"), (2, None, "a", None), (3, "", None, "de"),
        (4, "plain text, Twice.", "b", "en"), (None, "a text without a key", None, None), (5, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "b", "fr"),
        (6, "\n \n\t", "a", "en"), (7, "Ünïcödé 你好 😊 ​ \x00 end", "c", "xx"), (8, "x" * 50_000, "c", "xx"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    from pyspark.sql import functions as F

    clash = ["ids", "Decoded", "stats", "score", "spans", "base_spans", "n_lines", "n_dropped", "matches", "n_words", "key", "n", "sig", "payload", "feature", "digest", "place", "_bad", "rep", "label", "at", "seed", "hash"]
    return df.select("*", *[F.lit("extra").alias(c) for c in clash]).cache()


@pytest.fixture(scope="session")
def texts(messy):
    return [(r.doc_id, r.text, r.source) for r in messy.collect()]


def python_free(df):
    return not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
