"""Repeated passages by difference-cover anchors.

The positions 0, 1 and 3 modulo 7 are a difference cover: for any two positions
i and j some shift below 7 takes both onto it. So two equal runs of 13 words
hold an equal anchor, 7 words that start on the cover in both, and only 3 of 7
positions are hashed and shuffled. Where an anchor stands in more than one
document, the runs around it are extended to 13 words and compared: those whose
words also start in a smaller doc_id go.

No occurrences meet. An anchor is reduced to its smallest and largest doc_id,
a run to its smallest one, both on the map side first. A run that is nowhere
else, or first here, is reported back to its first document, so each distinct
run makes one row however many copies it has; all other extended runs go.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.llm.staging import staged
from equispark.llm.text import filled, slices

WINDOW, PERIOD = 13, 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
MAX_BITS = 1 << 26

_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = [np.uint64(pow(_BASE, p + 1, 1 << 64)) for p in range(ANCHOR)]
_PROBES = tuple(np.uint64(p) for p in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x27D4EB2F165667C5))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
SPAN, LONG_WORD, SLICE = 1 << 18, 1 << 12, 1 << 19


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of an odd base and of its inverse modulo 2^64."""
    draw = np.random.default_rng(20_240_713)

    def powers(base: int) -> np.ndarray:
        out = np.full(SPAN, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return draw.integers(0, 1 << 64, 256, np.uint64), powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], which only its bytes decide.

    A word's sum of byte numbers times powers of a base is a difference of
    running sums. These are taken over spans of bounded size; words above 4 KB
    are hashed by themselves.
    """
    numbers, up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    at = 0
    for stop in [*long.tolist(), len(starts)]:
        while at < stop:
            upto = min(stop, max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN - 1, side="right"))))
            low = starts[at]
            span = data[low : ends[upto - 1]]
            sums = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(numbers[span] * up[: len(span)], out=sums[1:])
            first = starts[at:upto] - low
            out[at:upto] = (sums[ends[at:upto] - low] - sums[first]) * down[first]
            at = upto
        if stop < len(starts):
            out[stop] = xxhash.xxh64_intdigest(data[starts[stop] : ends[stop]].tobytes())
            at = stop + 1
    return mixed(out)


class Texts:
    """The words of some texts, numbered through, and the hashes of the runs of ANCHOR words that start at them."""

    def __init__(self, raw: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        inside = _IS_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        heads = np.cumsum([1, *[len(text) + 1 for text in raw]])
        self.bounds = np.searchsorted(starts, heads)  # of the texts, in words
        self.size = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(raw)), self.size)  # of each word
        self.place = np.arange(len(starts)) - self.bounds[self.text]  # of each word in its text
        hashes = word_hashes(data, starts, ends)
        total = np.zeros(len(starts), np.uint64)
        for place, by in enumerate(_MULTIPLIERS):
            total[: max(len(total) - place, 0)] += hashes[place:] * by
        self.runs = mixed(total)
        self.rest = self.size[self.text] - self.place  # words from here to the end

    def anchors(self) -> np.ndarray:
        """The words on the cover from which ANCHOR words follow, in texts that have a window."""
        on = np.isin(self.place % PERIOD, COVER) & (self.rest >= ANCHOR) & (self.size[self.text] >= WINDOW)
        return np.flatnonzero(on)

    def extended(self, shared: np.ndarray) -> np.ndarray:
        """The starts of all windows that hold one of the given anchors."""
        low = shared - np.minimum(self.place[shared], WINDOW - ANCHOR)
        high = shared - np.maximum(WINDOW - self.rest[shared], 0) + 1
        n = len(self.runs) + 1
        inside = np.bincount(low, minlength=n) - np.bincount(high, minlength=n)
        return np.flatnonzero(np.cumsum(inside)[:-1] > 0)

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window: those of its first and its last ANCHOR words, which hold all 13."""
        return self.runs[starts], self.runs[starts + WINDOW - ANCHOR]

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """Whether each word lies in one of the windows."""
        n = len(self.runs) + WINDOW + 1
        inside = np.bincount(starts, minlength=n) - np.bincount(starts + WINDOW, minlength=n)
        return np.cumsum(inside)[: len(self.runs)] > 0


def run_name(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number of the two of a window, which tells it apart within a document."""
    return first ^ ((last << np.uint64(21)) | (last >> np.uint64(43)))


class Filter:
    """A Bloom filter over anchor hashes; what it wrongly passes is extended and compared like all else."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)

    @staticmethod
    def places(hashes: np.ndarray, shift: np.uint64):
        return ((hashes * probe) >> shift for probe in _PROBES)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.shift):
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(keys: DataFrame, count: int, max_bits: int) -> Filter | None:
    """A filter of at most `max_bits` bits over `keys` (anchor), 8 to 16 bits a key; None if that does not suffice."""
    size = 1 << max(10, (8 * count - 1).bit_length())
    if size > max_bits:
        return None
    shift = np.uint64(64 - size.bit_length() + 1)

    def words(batches):
        for batch in batches:
            place = np.concatenate(list(Filter.places(batch["anchor"].to_numpy().view(np.uint64), shift)))
            at, inverse = np.unique(place >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.view(np.int64))], names=["at", "word"])

    bits = np.zeros(size // 64, np.int64)
    found = keys.mapInArrow(words, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits[found["at"].to_numpy()] = found["word"].to_numpy()
    return Filter(bits.view(np.uint64))


class Passages:
    """The texts of a table, and which of their anchors stand in several documents."""

    def __init__(self, documents: DataFrame, max_bits: int):
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        ends = self.anchors(False).groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        self.shared = staged(ends.filter("least < most").select("anchor"), "anchors")
        held = bloom(self.shared, self.shared.count(), max_bits)
        self.filter = None if held is None else documents.sparkSession.sparkContext.broadcast(held)
        self.texts = self.marked() if held is None else self.texts.withColumn("marks", F.lit(None).cast("array<int>"))

    def anchors(self, places: bool) -> DataFrame:
        """(anchor, doc_id), with its place `at` if asked for, of every position on the cover; null ids have none."""

        def hashed(batches):
            for batch in batches:
                for rows in slices(batch, size=SLICE):
                    texts = Texts([t.as_buffer().to_pybytes() for t in filled(rows["text"])])
                    on = texts.anchors()
                    columns = [pa.array(texts.runs[on].view(np.int64)), rows["doc_id"].take(pa.array(texts.text[on]))]
                    columns += [pa.array(texts.place[on].astype(np.int32))] * places
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "at"][: len(columns)])

        schema = "anchor long, doc_id long" + ", at int" * places
        return self.texts.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(hashed, schema)

    def marked(self) -> DataFrame:
        """The texts with the places of their shared anchors, by joins, where no filter of bounded size holds these."""
        at = self.anchors(True).join(self.shared, "anchor").groupBy("doc_id").agg(F.collect_set("at").alias("marks"))
        return self.texts.join(staged(at, "marks"), "doc_id", "left")

    def finder(self):
        """A function from the rows of a slice to their texts, words, and the starts of the windows to be compared."""
        held = self.filter

        def of(rows: pa.RecordBatch) -> tuple[list[bytes], Texts, np.ndarray]:
            raw = [t.as_buffer().to_pybytes() for t in filled(rows["text"])]
            texts = Texts(raw)
            shared = texts.anchors()
            if held is not None:
                shared = shared[held.value.holds(texts.runs[shared])]
            else:
                lists = rows["marks"].fill_null([])
                row = np.repeat(np.arange(len(raw)), np.asarray(lists.value_lengths()))
                marks = np.zeros(len(texts.runs) + 1, bool)
                marks[np.minimum(texts.bounds[row] + np.asarray(lists.flatten(), np.int64), len(texts.runs))] = True
                shared = shared[marks[shared]]
            named = ~np.asarray(rows["doc_id"].is_null())
            return raw, texts, texts.extended(shared[named[texts.text[shared]]])

        return of

    def firsts(self) -> DataFrame:
        """(doc_id, runs): the names of the compared windows that no smaller doc_id holds."""
        find = self.finder()

        def compared(batches):
            for batch in batches:
                for rows in slices(batch, size=SLICE):
                    _, texts, starts = find(rows)
                    hashes = [pa.array(part.view(np.int64)) for part in texts.windows(starts)]
                    yield pa.RecordBatch.from_arrays([*hashes, rows["doc_id"].take(pa.array(texts.text[starts]))], names=["first", "last", "doc_id"])

        found = self.texts.mapInArrow(compared, "first long, last long, doc_id long")
        least = found.groupBy("first", "last").agg(F.min("doc_id").alias("doc_id"))
        turned = F.shiftleft("last", 21).bitwiseOR(F.shiftrightunsigned("last", 43))
        names = least.select("doc_id", F.col("first").bitwiseXOR(turned).alias("run"))
        return staged(names.groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "firsts")

    def stripped(self) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) of every row."""
        find = self.finder()

        def judged(batches):
            for batch in batches:
                for rows in slices(batch, size=SLICE):
                    raw, texts, starts = find(rows)
                    lists = rows["runs"].fill_null([])
                    row = np.repeat(np.arange(len(raw)), np.asarray(lists.value_lengths())).astype(np.uint64)
                    own = np.asarray(lists.flatten(), np.int64).view(np.uint64) + row * np.uint64(_BASE)
                    names = run_name(*texts.windows(starts)) + texts.text[starts].astype(np.uint64) * np.uint64(_BASE)
                    gone = texts.removed(starts[~np.isin(names, own)])
                    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[texts.bounds])
                    kept = []
                    for i, text in enumerate(raw):
                        words = text.split()
                        kept.append(b" ".join(compress(words, (~gone[texts.bounds[i] : texts.bounds[i + 1]]).tolist()) if lost[i] else words))
                    yield pa.RecordBatch.from_arrays(
                        [rows["doc_id"], pa.array(texts.size), pa.array(lost), pa.array(kept, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept"],
                    )

        rows = self.texts.join(self.firsts(), "doc_id", "left").select("doc_id", "text", "marks", "runs")
        return rows.mapInArrow(judged, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(documents: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row for each row of documents.

    Words are what white space parts, unchanged. Each word in a run of 13 whose
    words also start in a document with a smaller doc_id goes; `kept` joins the
    rest by blanks. All runs are judged on the input. A null text has no words.
    Rows with a null doc_id keep all words and take none from others. Rows that
    share a doc_id take nothing from each other and are each judged by their own
    text. An empty table gives no rows; further columns are not read.

    Runs are compared by two 64-bit hashes, of their first and last 7 words.
    The anchors that several documents share are sent to the tasks as a Bloom
    filter of at most `max_bits` bits; where that has not 8 bits for each, the
    places are found by joins instead, with the same rows.
    """
    return Passages(documents, max_bits).stripped()
