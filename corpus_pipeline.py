"""A training corpus from raw documents, in five stages that each write what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equispark.llm import decontamination, language, neardup, packing, pii
from equispark.llm.staging import batches_of, staged
from equispark.llm.tokens import vocabulary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language near enough to the learned ones.

    Null and empty texts have none and go. Repeated rows are judged alike, all
    columns stay as they are, and an empty table gives no rows.
    """
    return docs.filter(~language.judged(language.fit(docs), docs)["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, of its texts the first by sha256.

    Texts without words all stay. Of equal rows one stays, null ids come after all others.
    """
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark.

    Null and empty texts have none and stay, as do all rows if the benchmark is
    empty. Repeated rows are judged alike, all columns stay as they are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null, repeated rows repeat, further columns stay as they
    are. An empty table, or one without digits and @, learns nothing.
    """
    spans = pii.finder(docs, pii.fit(docs))
    text = pii.redacted(F.col("text").cast("string"), spans(F.col("text")))
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and token ids; a null text is its end id alone.

    Written in small batches: full ones of these rows would take 50 MB a task in the workers and again beside the heap.
    """
    with batches_of(spark, 1024):
        return staged(packing.pack(docs, vocabulary(), entries=100_000), "packed")  # beside the workers of the other stages


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", private),
    ("packing", packed),
]

# Learned models, near-duplicate sets and vocabularies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
