"""Packing by sum of squares: documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.llm.tokens import encoded, typed

ENTRIES = 600_000  # about 180 MB a worker when full
PIECES = "doc_id long, piece int, start long, length long, ids binary"
ROWS = 512  # of pieces in a batch that a task makes


def narrow(ids: np.ndarray) -> np.ndarray:
    """32-bit ids as 16-bit ones if all of them fit, else as they are."""
    return ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids


def wide(held: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Id lists of `lengths` ids each, of 16 or 32 bits, as lists of 32 bits."""
    held = held.cast(pa.binary())
    bounds = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, 4 * held.offset)
    sizes = np.diff(bounds)
    if (sizes == 4 * lengths).all():
        return held
    data = memoryview(held.buffers()[2])
    if (sizes == 2 * lengths).all():
        flat = np.frombuffer(data[bounds[0] : bounds[-1]], "<u2").astype("<u4")
        return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(2 * (bounds - bounds[0])), pa.py_buffer(flat)])
    lists = [np.frombuffer(data[a:b], "<u2" if b - a == 2 * n else "<u4").astype("<u4") for a, b, n in zip(bounds, bounds[1:], lengths)]
    return pa.array([x.tobytes() for x in lists], pa.binary())


def pieces(documents: DataFrame, tokenizer: str, room: int = 2048, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, piece, start, length, ids, held). Only longer documents are cut; the first piece takes the rest.

    Encoded and cut by one Python worker a task, which remembers pieces of text as in `tokenized`.
    `held` has the ids again, in 16 bits where those of a batch fit, for `wide`.
    """

    def cut(batches):
        for batch in encoded(batches, tokenizer, entries=entries):
            bounds = np.frombuffer(batch["ids"].buffers()[1], np.int32)[batch["ids"].offset :][: batch.num_rows + 1] // 4
            n = np.diff(bounds)
            count = np.maximum(-(-n // room), 1)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * room
            starts = np.where(piece, head[doc] + (piece - 1) * room, 0)
            lengths = np.where(piece, room, head[doc])
            places = np.append(bounds[doc] + starts, bounds[-1]).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(places), batch["ids"].buffers()[2]])
            flat = narrow(np.frombuffer(batch["ids"].buffers()[2], "<u4", bounds[-1] - bounds[0], 4 * bounds[0]))
            places = (places // 4 - bounds[0]) * np.int32(flat.itemsize)
            held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(places), pa.py_buffer(flat)])
            out = pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids, held],
                names=["doc_id", "piece", "start", "length", "ids", "held"],
            )
            for at in range(0, len(doc), ROWS):
                yield out.slice(at, ROWS)

    return typed(documents).mapInArrow(cut, f"{PIECES}, held binary")


class SumOfSquares:
    """Open sequences by their gap. Only their counts decide, so a step costs one pass over the gaps."""

    def __init__(self, room: int):
        self.room, self.made = room, 0
        self.count = np.zeros(room + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset). Takes the place that leaves the least sum of squared counts.

        Moving a sequence from gap g to gap g - size changes that sum by
        -2 count[g] + 1 and, unless it is then full, by 2 count[g - size] + 1.
        Among equals an open sequence goes before a new one and the smaller
        gap before the larger.
        """
        gap = self.room
        if size < self.room:
            at = self.count[size : self.room]
            change = 2 * (self.count[: self.room - size] - at) + 2
            change[0] -= 1 + 2 * self.count[0]
            change[at == 0] = np.iinfo(np.int64).max
            best = int(change.argmin()) if len(change) else 0
            if len(change) and change[best] <= 2 * self.count[self.room - size] + 1:
                gap = size + best
        if gap == self.room:
            sequence, self.made = self.made, self.made + 1
        else:
            sequence = self.open[gap].pop()
            self.count[gap] -= 1
        left = gap - size
        if left:
            self.count[left] += 1
            self.open.setdefault(left, []).append(sequence)
        return sequence, self.room - gap


def pack(documents: DataFrame, tokenizer: str, room: int = 2048, group_rows: int = 4096, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every document.

    Documents are dealt by hash into groups of about `group_rows`, each packed
    by itself from long to short, so no task sees more than its group and the
    loss is below two sequences a group. A row's hash covers its ids too: many
    rows of one doc_id still spread. Equal rows get places of their own. Null
    text: the end id alone. Null doc_id: kept. Extra columns: not read. An empty
    table gives no rows. Ids are shuffled in 16 bits where they fit.
    """
    groups = max(1, -(-documents.count() // group_rows))
    cut = pieces(documents, tokenizer, room, entries).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(groups)).cast("int")
    ).drop("ids")
    dealt = cut.repartitionById(groups, F.col("group")).sortWithinPartitions(
        "group", F.desc("length"), "doc_id", "piece", "held"
    )

    def placed(batches):
        group, state = None, None
        for batch in batches:
            for rows in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                sequences, offsets = [], []
                for own, size in zip(rows["group"].to_pylist(), rows["length"].to_pylist()):
                    if own != group:
                        group, state = own, SumOfSquares(room)
                    sequence, offset = state.place(size)
                    sequences.append((own << 32) + sequence)
                    offsets.append(offset)
                ids = wide(rows["held"], rows["length"].to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*(rows[c] for c in ("doc_id", "piece", "start", "length")), ids, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return dealt.mapInArrow(placed, f"{PIECES}, sequence_id long, offset long")
