"""Structured Streaming jobs. Each drains its source once (`availableNow`) and ends.

Rows may arrive in any order and none is dropped: bars and duplicates are
written as partial results of each batch, numbered by `foreachBatch`, and folded
on reading. Other batches are upserts of stored tables. Either way a replayed
batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equispark.functions.dates import utc_date
from equispark.session import checkpoint_dir
from equispark.sources import store


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain_into(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    mode: str = "append",
    prepare: Callable[[DataFrame], DataFrame] = lambda f: f,
) -> None:
    """Runs a stream to the end of its source; each batch is one upsert of the table.

    A batch that runs again finds its own keys and replaces them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert_table(prepare(batch), table, keys)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_upsert(
    documents: DataFrame,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("ticker", "date"),
) -> None:
    """Chunks of raw documents: prepare, then upsert. Running it again changes nothing."""
    drain_into(documents, table, checkpoint, keys, "append", prepare)


def drain_partials(stream: DataFrame, path: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame]) -> None:
    """Runs a stream to its end; each batch writes its own partial rows to one folder.

    No state and no watermark, so rows may come in any order. A replayed batch
    replaces its folder. An empty folder of the right shape stands for a source
    without rows.
    """
    empty = partial(stream.sparkSession.createDataFrame([], stream.schema))
    empty.coalesce(1).write.mode("ignore").parquet(f"{path}/batch=-1")
    query = (
        stream.writeStream.foreachBatch(lambda rows, number: partial(rows).write.mode("overwrite").parquet(f"{path}/batch={number}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def partial_bars(ticks: DataFrame) -> DataFrame:
    """Bars of (ticker, ts, price, size, seq) per key and UTC day, with the places of their first and last tick.

    Ticks combine before the shuffle, so a hot key costs one row per task.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.groupBy("ticker", F.window("ts", "1 day").alias("w"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.min(order).alias("opened"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.max(order).alias("closed"),
            F.sum("size").alias("volume"),
        )
        .select("ticker", utc_date(F.col("w.start")).alias("date"), "open", "opened", "high", "low", "close", "closed", "volume")
    )


def folded_bars(parts: DataFrame) -> DataFrame:
    """One bar per key and day out of partial ones, in whatever order they were written."""
    return parts.groupBy("ticker", "date").agg(
        F.min_by("open", "opened").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "closed").alias("close"),
        F.sum("volume").alias("volume"),
    )


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close and volume per key and UTC day."""
    return folded_bars(partial_bars(ticks))


def stream_daily_bars(ticks: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains the ticks and returns all bars of the folder; late ticks change their day's bar."""
    drain_partials(ticks, path, checkpoint, partial_bars)
    return folded_bars(ticks.sparkSession.read.parquet(path).drop("batch"))


def dedupe_arrivals(rows: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """The earliest arrival of each key."""
    return rows.groupBy(*keys).agg(F.min("ts").alias("ts"))


def stream_dedupe(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Drains the rows and returns the earliest arrival of each key of the folder."""
    drain_partials(rows, path, checkpoint, lambda batch: dedupe_arrivals(batch, keys))
    return dedupe_arrivals(rows.sparkSession.read.parquet(path).drop("batch"), keys)


def last_seen(log: DataFrame) -> DataFrame:
    return log.groupBy("ticker", "data_type").agg(
        F.max("last_fetched").alias("last_fetched"), F.count("*").alias("fetches")
    )


def stream_freshness(log: DataFrame, table: str, checkpoint: str) -> None:
    drain_into(last_seen(log), table, checkpoint, ("ticker", "data_type"), "update")
