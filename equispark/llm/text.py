"""Whole texts of an Arrow batch as bytes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

# ASCII bytes that are no part of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after
# lower-casing; bytes from 0x80 on belong to words.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False
WORD_BYTES = bytes(b if _IS_WORD[b] else 0x20 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; only A-Z change case, everything else in ASCII but digits parts words."""
    return text.translate(WORD_BYTES).split()


def word_starts(lowered: bytes) -> np.ndarray:
    """Byte positions where words start, in the order of words_of."""
    inside = _IS_WORD[np.frombuffer(lowered, dtype=np.uint8)]
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    return np.flatnonzero(inside & ~before)


def word_ends(lowered: bytes) -> np.ndarray:
    """Byte positions just behind each word."""
    inside = _IS_WORD[np.frombuffer(lowered, dtype=np.uint8)]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    return np.flatnonzero(inside & ~after) + 1


def code_point(text: bytes, at: int) -> int:
    """The code points before a byte position."""
    return len(text[:at].decode("utf-8", "replace"))


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Null texts as empty ones, in one chunk."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def slices(rows: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `size` bytes together, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(rows[column]), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < rows.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield rows.slice(start, stop - start)
        start = stop
