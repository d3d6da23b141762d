import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and repeated rows, ties, a long text, and columns with clashing names."""
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    rows = [
        (1, base, "en"),
        (2, base + " extra", "en"),
        (3, base.upper(), "en"),
        (3, base.upper(), "en"),
        (4, None, "de"),
        (5, "", None),
        (6, "one two", "de"),
        (7, "ONE  two", "de"),
        (8, "x " * 30_000, "en"),
        (9, "\n\na\n\n\nb c ß 中文 don't <|endoftext|>\tz  ", "de"),
        (None, "no id here at all", "en"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    extra = [F.lit(i).alias(c) for i, c in enumerate(("n", "node", "found", "ids", "shard", "host", "key", "range", "draw", "spans"))]
    return table.select("*", F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), *extra)
