"""Benchmark passages in documents, by an Aho-Corasick automaton over normalised words.

One automaton scans each text once. It costs about 800 bytes a window, so it
has at most MAX_WINDOWS of them. A larger benchmark is dealt over several
automata; each pass then takes up the hit words that the one before wrote.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.llm.staging import staged
from equispark.llm.text import filled, word_ends, word_starts, words_of
from equispark.llm.worker import alone

RESULT = "n_words long, n_hit long, items array<{}>, spans array<struct<start: long, end: long>>, runs array<struct<first: long, stop: long>>"
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")
MAX_BENCHMARK_BYTES = 64 << 20
MAX_WINDOWS = 100_000


class Windows:
    """The automaton: its letters are benchmark words, its words the windows of `size` words.

    An item of fewer words is one window of its own. Words that no item has are
    letter 0, which leads back to the root.
    """

    def __init__(self, items: tuple[tuple[int, bytes], ...], size: int):
        self.letters: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            word_ids = [self.letters.setdefault(w, len(self.letters) + 1) for w in words_of(text)]
            for at in range(max(len(word_ids) - size, 0) + 1 if word_ids else 0):
                owners.setdefault(tuple(word_ids[at : at + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, own in owners.items():
            self.automaton.add_word(window, (len(window), own))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes, before: list[tuple[int, int]] = ()) -> tuple[int, int, list[int], list[dict], list[dict]]:
        """(words, hit words, items found, spans in code points of the text, the same in words), in one pass.

        `before` has the runs of words that other windows hit; they count as hit, too.
        """
        words = words_of(text)
        found, items = list(before), set()
        if words and not self.empty:
            for last, (length, own) in self.automaton.iter(tuple(map(self.letters.get, words, repeat(0)))):
                found.append((last + 1 - length, last + 1))
                items |= own
        if not found:
            return len(words), 0, [], [], []
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, [s for s, _ in found], 1)
        np.add.at(change, [e for _, e in found], -1)
        hit = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
        lowered = text.lower()
        starts, ends = word_starts(lowered), word_ends(lowered)
        spans, at, points = [], 0, 0
        for first, stop in edges.tolist():
            span = {}
            for side, place in (("start", starts[first]), ("end", ends[stop - 1])):
                points += len(text[at:place].decode("utf-8"))
                at = span[side] = int(place)
                span[side] = points
            spans.append(span)
        return len(words), int(hit.sum()), sorted(items), spans, [{"first": a, "stop": b} for a, b in edges.tolist()]


def windows(items: tuple[tuple[int, bytes], ...], size: int) -> Windows:
    return alone(("windows", items, size), lambda: Windows(items, size))


def _typed(benchmark: DataFrame) -> tuple[str, DataFrame]:
    """The type that item ids are carried as, and (item_id, text)."""
    kind = "long" if dict(benchmark.dtypes)["item_id"] in WHOLE_NUMBERS else "string"
    return kind, benchmark.select(F.col("item_id").cast(kind).alias("item_id"), F.col("text").cast("string").alias("text"))


def scanner(benchmark: DataFrame, size: int = 10, max_bytes: int = MAX_BENCHMARK_BYTES):
    """A function from a text column to a struct (n_words, n_hit, items, spans, runs).

    The benchmark goes to every task, so its size is checked first; a larger
    one is refused, never cut (`parted` makes small ones of it). Null texts, in
    either table, have no words. Repeated items count once, null item ids are
    left out of `items` but their words still hit. Ids are longs if the
    benchmark has whole numbers, else text. A second column, the struct of
    another scan of the same text, is added to what this one finds.
    """
    kind, rows = _typed(benchmark)
    held = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    if held > max_bytes:
        raise ValueError(f"the benchmark has {held} bytes of text, {max_bytes} may be sent to each task")
    texts = {(r.item_id is None, r.item_id, r.text.encode()) for r in rows.filter("text IS NOT NULL").collect()}
    known = [*sorted(t for t in texts if not t[0]), *sorted((t for t in texts if t[0]), key=lambda t: t[2])]
    # The automaton knows items by their number here.
    names, items = tuple(t[1] for t in known), tuple((n, t[2]) for n, t in enumerate(known))
    shared = rows.sparkSession.sparkContext.broadcast((names, items))
    ids_type = pa.int64() if kind == "long" else pa.string()
    run_type = lambda *ends: pa.list_(pa.struct([(end, pa.int64()) for end in ends]))

    def scanned(column: pa.Array, before: list[dict]) -> pa.Array:
        ids, lookup = shared.value[0], windows(shared.value[1], size)
        found, own = [], []
        for text, other in zip(filled(column), before):
            row = lookup.scan(text.as_buffer().to_pybytes(), [(r["first"], r["stop"]) for r in other["runs"]])
            found.append(row)
            own.append(sorted({ids[n] for n in row[2] if ids[n] is not None}.union(other["items"])))
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array(own, pa.list_(ids_type)),
                pa.array([f[3] for f in found], run_type("start", "end")),
                pa.array([f[4] for f in found], run_type("first", "stop")),
            ],
            names=["n_words", "n_hit", "items", "spans", "runs"],
        )

    @F.arrow_udf(RESULT.format(kind))
    def scan(column: pa.Array) -> pa.Array:
        return scanned(column, [{"runs": (), "items": ()}] * len(column))

    @F.arrow_udf(RESULT.format(kind))
    def scan_on(column: pa.Array, before: pa.Array) -> pa.Array:
        return scanned(column, before.to_pylist())

    return lambda text, before=None: scan(text) if before is None else scan_on(text, before)


def parted(benchmark: DataFrame, size: int = 10, most: int = MAX_WINDOWS, max_bytes: int = MAX_BENCHMARK_BYTES) -> list[DataFrame]:
    """The benchmark as tables (item_id, text) of at most `most` windows and `max_bytes` bytes each.

    Long items are cut into runs of windows, which overlap by the words that
    two windows share, so that no window is lost or made. Runs are dealt by
    hash over more and more parts until the largest part is within both bounds;
    only one run of words beyond `max_bytes` is refused. An empty benchmark is one part.
    """
    kind, rows = _typed(benchmark)
    step = max(most // 8, 1)

    def runs(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"].to_pylist(), filled(batch["text"])):
                words = words_of(text.as_buffer().to_pybytes())
                n = max(len(words) - size, 0) + 1 if words else 0
                for at in range(0, n, step):
                    stop = min(n, at + step)
                    out.append((item, b" ".join(words[at : stop + size - 1]).decode("utf-8"), stop - at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64() if kind == "long" else pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())],
                names=["item_id", "text", "windows"],
            )

    held = staged(rows.filter("text IS NOT NULL").mapInArrow(runs, f"item_id {kind}, text string, windows long").distinct(), "passages")
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        size_of = held.groupBy(part.alias("part")).agg(
            F.sum("windows").alias("w"), F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text")).alias("longest")
        )
        largest = size_of.agg(F.max("w").alias("w"), F.max("b").alias("b"), F.max("longest").alias("longest")).first()
        if (largest.longest or 0) > max_bytes:
            raise ValueError(f"a run of {step} windows has {largest.longest} bytes, {max_bytes} may be sent to each task")
        if (largest.w or 0) <= most and (largest.b or 0) <= max_bytes:
            return [held.filter(part == p).select("item_id", "text") for p in range(parts)]
        parts *= max(2, -(-2 * largest.w // most), -(-2 * largest.b // max_bytes))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated), one row for each row of documents.

    Narrow: texts are read where they lie, and written between the passes if
    the benchmark has several parts, so that a worker holds one automaton.
    Empty documents, empty tables and a benchmark without words give no hits;
    repeated rows repeat; further columns are not read.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    for place, part in enumerate(parted(benchmark, size, most)):
        rows = staged(rows, "scanned") if place else rows
        found = scanner(part, size)("text", "found" if place else None)
        rows = rows.select("doc_id", "text", found.alias("found"))
    return rows.select("doc_id", "found.*").drop("runs").withColumn("contaminated", F.col("n_hit") > 0)


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MAX_WINDOWS) -> DataFrame:
    """The rows of documents without any benchmark passage, columns as they are; one pass a part, as `contamination`."""
    text = F.col("text").cast("string")
    for place, part in enumerate(parted(benchmark, size, most)):
        documents = staged(documents, "scanned") if place else documents
        documents = documents.filter(scanner(part, size)(text)["n_hit"] == 0)
    return documents


def items_digest(items: Column) -> Column:
    """sha256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda i: i.cast("string")))), 256)
