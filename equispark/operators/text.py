"""Symbol extraction, redaction, close names and report projections over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from equispark.functions.text import (
    capital_words,
    mask_tail,
    quoted_symbols,
    redact_connection,
    report_text,
    similarity,
)


def extract_symbols(frame: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct 2-5 letter capital word of a text; whole texts are read."""
    return frame.select(key, F.explode(capital_words(F.col(text), 2, 5)).alias("symbol"))


def extract_sql_symbols(frame: DataFrame, key: str, sql: str) -> DataFrame:
    return frame.select(key, F.explode(quoted_symbols(F.col(sql))).alias("symbol"))


def redact_credentials(frame: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """Text with connection passwords starred out, and a secret with its tail shown."""
    return frame.select(
        key, redact_connection(F.col(text)).alias("redacted"), mask_tail(F.col(secret)).alias("masked")
    )


def close_names(frame: DataFrame, name: str, vocabulary: Sequence[str], top: int = 3, floor: float = 0.5) -> DataFrame:
    """The best known names for each distinct given name, by similarity.

    The vocabulary is a short fixed list, so it travels inside the projection;
    names are made distinct before anything is compared.
    """
    given = frame.select(F.col(name).alias("given")).filter("given IS NOT NULL").distinct()
    known = F.explode(F.array(*[F.lit(v) for v in vocabulary]))
    scored = given.select("given", known.alias("candidate")).withColumn(
        "score", similarity(F.lower("given"), F.lower("candidate"))
    )
    order = W.partitionBy("given").orderBy(F.desc("score"), "candidate")
    return (
        scored.filter(F.col("score") >= floor)
        .withColumn("place", F.row_number().over(order).cast("bigint"))
        .filter(F.col("place") <= top)
    )


def close_pairs(given: DataFrame, name: str, known: DataFrame, known_name: str, floor: float = 0.5) -> DataFrame:
    """(given, candidate, score): all pairs of distinct names whose similarity is at least `floor`, without case.

    Within similarity `floor`, a name of length n takes at most k = n (1 - floor)
    edits. Cut into k + 1 pieces, one of them stands unchanged in any shorter name
    that close, and so near to its place that the edits ahead of it and behind it
    suffice. The longer of two names is looked up by its pieces, the shorter one
    by its parts at such places; only names that meet there are compared.
    """
    if not 0 < floor <= 1:
        raise ValueError("a similarity above 0 is needed")
    names = lambda frame, column: frame.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct()
    edits = lambda n: F.floor((1 - floor) * n + 1e-9).cast("int")
    start = lambda i, n, k: F.floor(i * n / (k + 1)).cast("int")

    def pieces(frame: DataFrame) -> DataFrame:
        cut = frame.select("name", F.lower("name").alias("low")).withColumn("n", F.length("low")).withColumn("k", edits(F.col("n")))
        cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        at, end = start(F.col("i"), F.col("n"), F.col("k")), start(F.col("i") + 1, F.col("n"), F.col("k"))
        return cut.select("name", "n", "i", F.substr("low", at + 1, end - at).alias("piece"))

    def parts(frame: DataFrame) -> DataFrame:
        own = frame.select("name", F.lower("name").alias("low")).withColumn("m", F.length("low"))
        longest = F.floor(F.col("m") / floor + 1e-9).cast("int")
        long = own.select("*", F.explode(F.sequence("m", F.greatest("m", longest))).alias("n")).withColumn("k", edits(F.col("n")))
        long = long.filter("n - m <= k").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
        at, end = start(F.col("i"), F.col("n"), F.col("k")), start(F.col("i") + 1, F.col("n"), F.col("k"))
        gap, behind = F.col("n") - F.col("m"), F.col("k") - F.col("i")
        first = F.greatest(F.lit(0), at + F.greatest(-F.col("i"), -gap - behind))
        last = F.least(F.col("m") - (end - at), at + F.least(F.col("i"), -gap + behind))
        placed = long.select("name", "low", "n", "i", (end - at).alias("size"), first.alias("first"), last.alias("last")).filter("first <= last")
        placed = placed.select("*", F.explode(F.sequence("first", "last")).alias("at"))
        return placed.select("name", "n", "i", F.substr("low", F.col("at") + 1, F.col("size")).alias("piece")).distinct()

    asked, held = names(given, name), names(known, known_name)
    met = [
        pieces(asked).withColumnRenamed("name", "given").join(parts(held).withColumnRenamed("name", "candidate"), ["n", "i", "piece"]),
        pieces(held).withColumnRenamed("name", "candidate").join(parts(asked).withColumnRenamed("name", "given"), ["n", "i", "piece"]),
    ]
    pairs = met[0].select("given", "candidate").union(met[1].select("given", "candidate")).distinct()
    scored = pairs.withColumn("score", similarity(F.lower("given"), F.lower("candidate")))
    return scored.filter(F.col("score") >= floor)


def close_names_in(given: DataFrame, name: str, known: DataFrame, known_name: str, top: int = 3, floor: float = 0.5) -> DataFrame:
    """The best known names for each distinct given name out of a table of names."""
    order = W.partitionBy("given").orderBy(F.desc("score"), "candidate")
    placed = close_pairs(given, name, known, known_name, floor).withColumn("place", F.row_number().over(order).cast("bigint"))
    return placed.filter(F.col("place") <= top)


def fmt_report(frame: DataFrame) -> DataFrame:
    """Numbers as report text by their column names; other columns as they are."""
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, NumericType)}
    return frame.select(*[report_text(c, F.col(c)).alias(c) if c in numeric else F.col(c) for c in frame.columns])
