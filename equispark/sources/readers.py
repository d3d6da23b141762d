"""Readers for raw documents and symbol lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The shape of raw statement documents; sections stay JSON text
# because their fields differ from document to document.
STATEMENT_SCHEMA = "ticker string, date string, period string, currency string, income_statement string, " \
    "balance_sheet string, cash_flow string, fetched_at string"


def read_raw_documents(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    """Full scan of a raw collection with a declared schema, so nothing is read to infer one."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_statement_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested statement documents with the three payload sections as JSON text columns."""
    nested = "ticker string, date string, period string, currency string, fetched_at string, " \
        "payload struct<income_statement: string, balance_sheet: string, cash_flow: string>"
    documents = spark.read.schema(nested).json(path)
    return documents.select("ticker", "date", "period", "currency", "payload.*", "fetched_at")


def read_symbols_file(spark: SparkSession, path: str) -> DataFrame:
    """First column of a CSV of symbols, trimmed, with its position.

    The first row of each file is a header if its first cell says `ticker`. The
    position is (file, block, place): sortable, whatever tasks read the files.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = spark.read.csv(path, header=False).select(F.trim("_c0").alias("symbol"), place.alias("position"))
    heads = rows.filter(F.lower("symbol") == "ticker").select(F.col("position").alias("head"))
    firsts = rows.groupBy(F.col("position.file").alias("file")).agg(F.min("position").alias("head"))
    titles = heads.join(firsts, "head", "left_semi")
    return rows.join(titles, F.col("position") == F.col("head"), "left_anti")


def read_chunked(spark: SparkSession, path: str, schema: str | StructType, files_per_chunk: int, fmt: str = "parquet") -> DataFrame:
    """The same scan as a stream of bounded chunks; the last one may be short."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_chunk).load(path)
