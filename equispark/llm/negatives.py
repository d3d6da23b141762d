"""Hard negatives by a secondary-sort shuffle over packed (anchor, descending score, id) keys.

Anchors are a stated query set. They are taken in groups of bounded size, each
scored against all rows in blocks inside the tasks. A task sends on what may
still count: per anchor its best rows of the same label, then, once the
positives are known, its best rows of other labels in each positive's window.
What a task holds back is behind enough of its own rows, so nothing is lost.
The keys are sorted by the shuffle; an iterator reads them as a stream, opens a
window at each positive and emits the negatives that fall into it.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equispark.llm.staging import scratch_path, staged
from equispark.llm.vectors import gridded, matrix

KEY = np.dtype([("anchor", ">u4"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
UNPACK = struct.Struct(">IQBQ")
TOP, HALF = (1 << 63) - 1, 1 << 63
NO_ID = TOP  # stands for null, behind all other ids
POSITIVE, NEGATIVE = 0, 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is anchor, falling score, positives first, rising id."""
    out = np.empty(len(anchor), KEY)
    out["anchor"], out["kind"] = anchor, kind
    out["score"] = np.uint64(TOP) - score.astype(np.int64).view(np.uint64)
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(HALF)
    raw = out.tobytes()
    return [raw[at : at + KEY.itemsize] for at in range(0, len(raw), KEY.itemsize)]


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, kind, id) of a key."""
    anchor, score, kind, own = UNPACK.unpack(key)
    rest = TOP - score  # from TOP down to -2^63
    return anchor, rest, kind, own - HALF


@dataclass(frozen=True)
class Anchors:
    """A group of anchors; `low`, `high` bound the scores of each one's windows once its positives are known."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact inner products, a row for each row of x."""
        most = int(np.abs(x).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * x.shape[1]
        if most < 1 << 53:
            return x.astype(np.float64) @ self.x.T.astype(np.float64)
        if most >= TOP // 100:
            raise OverflowError("scores of these vectors do not fit a long")
        return x @ self.x.T


class Best:
    """The first `most` (score, id) of each anchor among the rows seen so far."""

    def __init__(self, anchors: int, most: int):
        self.most, self.bar = most, np.full(anchors, -HALF, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4  # anchor, score, id, row

    def offer(self, mask: np.ndarray, scores: np.ndarray, ids: np.ndarray, first_row: int) -> None:
        row, anchor = np.nonzero(mask & (scores >= self.bar))
        if not len(row):
            return
        fresh = (anchor, scores[row, anchor].astype(np.int64), ids[row], row + first_row)
        anchor, score, own, number = (np.concatenate(p) for p in zip(self.held, fresh))
        order = np.lexsort((number, own, -score, anchor))
        sorted_anchor = anchor[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_anchor, sorted_anchor)
        order, place = order[place < self.most], place[place < self.most]
        self.held = [part[order] for part in (anchor, score, own, number)]
        full = place == self.most - 1
        self.bar[self.held[0][full]] = self.held[1][full]


def _blocks(batches, anchors: Anchors, entries: int = 1 << 21):
    """(ids, labels, scores, number of the first row) of the rows of a task, in blocks of bounded size."""
    size, seen = max(1, entries // max(len(anchors.ids), 1)), 0
    for batch in batches:
        ids = batch["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
        labels = batch["label"].to_numpy(zero_copy_only=False)
        for at in range(0, batch.num_rows, size):
            x = matrix(batch["x"].slice(at, size))
            yield ids[at : at + size], labels[at : at + size], anchors.scores(x), seen + at
        seen += batch.num_rows


def _keys(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(packed(*columns), pa.binary())], names=["key"])


def sorted_keys(keys: RDD, partitions: int) -> RDD:
    """The keys as sorted streams; one anchor's keys stand together in one of them."""
    anchor = lambda key: int.from_bytes(key[:4], "big")
    return keys.map(lambda key: (key, None)).repartitionAndSortWithinPartitions(partitions, anchor).keys()


def first_positives(keys: Iterable[bytes], most: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, id) of the first `most` keys of each anchor in a sorted stream."""
    for _, own in itertools.groupby(keys, key=lambda key: key[:4]):
        for key in itertools.islice(own, most):
            anchor, score, _, number = unpacked(key)
            yield anchor, score, number


def windowed(keys: Iterable[bytes], most: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) of a sorted stream.

    A positive opens its window, which closes after `most` negatives or below
    `low` % of its score. As `high` is at most 100, a positive comes ahead of
    all negatives of its window. Only the open windows are held.
    """
    at, windows = -1, []
    for key in keys:
        anchor, score, kind, own = unpacked(key)
        if anchor != at:
            at, windows = anchor, []
        if kind == POSITIVE:
            windows.append([score, own, 0])
            continue
        windows = [w for w in windows if w[2] < most and low * w[0] <= 100 * score]
        for window in windows:
            if 100 * score <= high * window[0]:
                window[2] += 1
                yield anchor, window[1], window[2], own, window[0], score


def _mined(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    partitions, count = int(spark.conf.get("spark.sql.shuffle.partitions")), len(anchors.ids)
    group = spark.sparkContext.broadcast(anchors)

    def same_label(batches):
        own, best = group.value, Best(count, positives)
        for ids, labels, scores, first in _blocks(batches, own):
            best.offer((labels[:, None] == own.labels) & (ids[:, None] != own.ids), scores, ids, first)
        anchor, score, number, _ = best.held
        yield _keys(anchor, score, POSITIVE, number)

    def key_of(frame: DataFrame) -> RDD:
        return frame.rdd.map(lambda row: bytes(row[0]))

    streams = sorted_keys(key_of(rows.mapInArrow(same_label, "key binary")), partitions)
    found = streams.mapPartitions(lambda keys: first_positives(keys, positives)).collect()
    bounds = np.full((2, positives, count), TOP, np.int64)
    bounds[1] = -HALF
    place = dict.fromkeys(range(count), 0)
    for anchor, score, _ in found:
        bounds[:, place[anchor], anchor] = -(-low * score // 100), high * score // 100
        place[anchor] += 1
    known = spark.sparkContext.broadcast(Anchors(anchors.ids, anchors.labels, anchors.x, *bounds))

    def other_label(batches):
        own = known.value
        best = [Best(count, negatives) for _ in range(positives)]
        for ids, labels, scores, first in _blocks(batches, own):
            other = labels[:, None] != own.labels
            for window, (least, most) in zip(best, zip(own.low, own.high)):
                window.offer(other & (scores >= least) & (scores <= most), scores, ids, first)
        held = np.concatenate([np.array(window.held) for window in best], axis=1)
        _, once = np.unique(held[[0, 3]], axis=1, return_index=True)
        anchor, score, number, _ = held[:, once]
        yield _keys(anchor, score, NEGATIVE, number)

    opening = [packed(np.array([a]), np.array([s]), POSITIVE, np.array([i]))[0] for a, s, i in found]
    keys = key_of(rows.mapInArrow(other_label, "key binary"))
    keys = keys.union(spark.sparkContext.parallelize(opening, 1)) if opening else keys
    names = spark.sparkContext.broadcast(anchors.ids.tolist())
    named = lambda number: None if number == NO_ID else number
    out = sorted_keys(keys, partitions).mapPartitions(lambda keys: windowed(keys, negatives, low, high))
    out = out.map(lambda r: (names.value[r[0]], named(r[1]), r[2], named(r[3]), r[4], r[5]))
    return spark.createDataFrame(out, OUT, verifySchema=False)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    vector: str = "embedding",
    group_rows: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`. A score is the
    inner product of floor(scale * entry) vectors; rows are ordered by falling
    score, then by vec_id, null ids last. Positives are an anchor's first rows
    of its label with another vec_id; of each positive the first rows of other
    labels with `low` to `high` % of its score are returned.

    Rows with a null label take no part, nor those without a whole vector
    (vectors.gridded). Labels are whole numbers. Rows that repeat are each
    counted, as anchors too; the largest long is read as a null id. An empty
    table, or one without anchors, gives no rows; further columns are not read.
    Each group of `group_rows` anchors reads the table twice and is written.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows lie between 0 and 100 % of the positive's score")
    spark = vectors.sparkSession
    rows = vectors.filter("label IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector)
    rows = gridded(rows, scale, 0, vector).select("vec_id", "label", "x")
    asked = staged(rows.filter(F.col("vec_id") % every == 0), "anchors")
    numbered = asked.rdd.zipWithIndex().map(lambda r: (r[1], *r[0]))
    asked = staged(spark.createDataFrame(numbered, "number long, vec_id long, label long, x array<bigint>", verifySchema=False), "numbered")
    path, count = scratch_path(spark, "negatives"), asked.count()
    for start in range(0, count, group_rows):
        own = asked.filter((F.col("number") >= start) & (F.col("number") < start + group_rows)).collect()
        group = Anchors(*(np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label", "x")))
        _mined(rows, group, positives, negatives, low, high).write.mode("append").parquet(path)
    return _read(spark, path) if count else spark.createDataFrame([], OUT)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(path)
