"""Token ids of whole texts by a given vocabulary file of the tokenizers library."""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.llm.text import filled, slices
from equispark.llm.worker import alone

END_ID = 0
SLICE = 1 << 22

# A text may be parted where the vocabulary's own splitting rule always parts it:
# at the beginning of a run of white space, before the last sign of such a run
# where more text follows, and between an ASCII letter or digit and the ASCII
# punctuation behind it. White space beyond ASCII is not looked for; texts that
# hold any are given to the library in one go.
_SPACE, _SIGN, _ALNUM = (np.zeros(256, bool) for _ in range(3))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Pieces that the splitting rule never parts further nor joins with another such piece.
_SINGLE = re.compile(" [A-Za-zÀ-ÖØ-öø-ɏ]+| [0-9]+")
# Pieces that it never joins with a line break before or behind them; one that they begin with stands by itself.
_LINE = re.compile(r"[\n ]?\S+")


def parted(texts: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of all texts, sharing their bytes, and the number of pieces of each text."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
    low = int(bounds[0])
    own = data[low:]
    space = _SPACE[own]
    cut = np.zeros(len(own) + 1, bool)
    cut[1:-1] = _SIGN[own[1:]] & _ALNUM[own[:-1]] | space[1:] & ~space[:-1]
    last = space[:-1] & ~space[1:] if len(own) else space
    inner = bounds[1:-1] - low
    last[inner[(inner > 0) & (inner < len(own))] - 1] = False  # a space that ends a text
    cut[: len(last)] |= last
    cut[bounds - low] = True
    at = np.flatnonzero(cut)
    starts = (at + low).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), texts.buffers()[2] or pa.py_buffer(b"")])
    return pieces, np.diff(np.searchsorted(at, bounds - low))


class Memory:
    """Values of keys in two generations of at most `entries`; what is asked for again survives."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def known(self, keys: list[bytes]) -> list[bytes | None]:
        """The values of the keys, None for unknown ones."""
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = value
        return found


class Encoder:
    """Ids by the tokenizers library, which is asked once for a piece of text.

    The pieces of a slice of texts are numbered first, so that each different
    one is looked up once. `memory` is bounded, which changes no result.
    """

    def __init__(self, path: str, entries: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = Memory(entries)
        self.line = self._ask(["\n"])[0]

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _ask_joined(self, pieces: list[str], run: int = 256) -> list[bytes]:
        """The ids of single pieces, many asked for in one text and parted by the library's own word numbers."""
        out: list[bytes] = []
        for at in range(0, len(pieces), run):
            own = pieces[at : at + run]
            found = self.library.encode("".join(own), add_special_tokens=False)
            ids, words = np.asarray(found.ids, "<u4"), np.asarray(found.word_ids)
            ends = [0, *(4 * np.flatnonzero(words[1:] != words[:-1]) + 4).tolist(), 4 * len(ids)]
            if len(ends) != len(own) + 1:  # another splitting rule than the one known here
                return out + self._ask(pieces[at:])
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in itertools.pairwise(ends)]
        return out

    def _ask_lines(self, pieces: list[str], run: int = 256) -> list[bytes]:
        """As `_ask_joined`, each piece on a line of its own, where the id of the line break parts them."""
        out: list[bytes] = []
        for at in range(0, len(pieces), run):
            own = pieces[at : at + run]
            bare = [piece[0] != "\n" for piece in own]
            found = self.library.encode_batch_fast(["".join(["\n" + x if b else x for x, b in zip(own, bare)])], add_special_tokens=False)
            ids = np.asarray(found[0].ids, "<u4")
            starts = 4 * np.flatnonzero(ids == int.from_bytes(self.line, "little"))
            if len(self.line) != 4 or len(starts) != len(own) or starts[0]:  # another splitting rule than the one known here
                return out + self._ask(pieces[at:])
            raw = ids.tobytes()
            ends = [*starts[1:].tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip((starts + 4 * np.asarray(bare)).tolist(), ends)]
        return out

    def _pieces(self, wanted: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        found = self.memory.known(wanted)
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        texts: tuple[list[str], list[str], list[str]] = [], [], []
        for i, ids in enumerate(found):
            if ids is None:
                text = wanted[i].decode()
                kind = 0 if _SINGLE.fullmatch(text) else 1 if _LINE.fullmatch(text) else 2
                kinds[kind].append(i)
                texts[kind].append(text)
        young = self.memory.young
        for own, ask, of in zip(kinds, (self._ask_joined, self._ask_lines, self._ask), texts):
            for i, ids in zip(own, ask(of)):
                found[i] = young[wanted[i]] = ids
        return found

    def ids_of(self, texts: pa.LargeStringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one behind the other, and their number in each text; `end` is put behind each text."""
        whole = pc.match_substring_regex(texts, _OTHER_SPACE)
        for mark in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        at_once = np.asarray(whole)
        pieces, counts = parted(texts.filter(pc.invert(whole)) if at_once.any() else texts)
        pieces = pieces.dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = [*self._pieces(different), *self._ask(texts.filter(whole).to_pylist()), end]
        # A text is its pieces, or one part of its own if it was asked for at once, and the end.
        per_text = np.full(len(texts), 2, np.int64)
        per_text[~at_once] = counts + 1
        ends = np.cumsum(per_text)
        order = np.full(int(per_text.sum()), len(parts) - 1, np.int32)
        inner = np.ones(len(order), bool)
        inner[ends - 1] = False
        if at_once.any():
            order[ends[at_once] - 2] = len(different) + np.arange(int(at_once.sum()))
            inner[ends[at_once] - 2] = False
        order[inner] = pieces.indices.to_numpy()
        out = pa.array(parts, pa.large_binary()).take(pa.array(order))
        bounds = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1] if len(out) else np.zeros(1, np.int64)
        bounds = bounds[np.concatenate([[0], ends])] // 4
        return np.frombuffer(out.buffers()[2] or b"", "<u4")[bounds[0] : bounds[-1]], np.diff(bounds)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, without an end id."""
        flat, sizes = self.ids_of(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(flat, np.cumsum(sizes)[:-1])]


def encoder(path: str, entries: int = 250_000) -> Encoder:
    """One encoder for a Python worker; its memory of pieces lasts over tasks."""
    return alone(("encoder", path, entries), lambda: Encoder(path, entries))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batches, path: str, text: str = "text", end_id: int = END_ID, width: str = "<u4", entries: int = 250_000):
    """Batches (doc_id, ids) of batches (doc_id, text), for use inside a task; each id list ends with the end id."""
    lookup = encoder(path, entries)
    end = np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for rows in slices(batch, text, SLICE):
            flat, sizes = lookup.ids_of(filled(rows[text]), end)
            ids = flat.astype(width, copy=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
            lists = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([rows["doc_id"], lists.cast(pa.binary())], names=["doc_id", "ids"])


def typed(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id as long and the text as string, nothing else."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))


def tokenized(
    documents: DataFrame, path: str, text: str = "text", end_id: int = END_ID, width: str = "<u4", entries: int = 250_000
) -> DataFrame:
    """(doc_id, ids): each row's ids with the end id behind them, little-endian, 32 bits unless `width` says less.

    A null text is empty, so it has the end id alone. Rows are kept as they
    are, repeated ones too. Narrow: no shuffle, one text in memory at a time
    beside its batch. `entries` bounds the pieces that a worker remembers in
    either of two generations (about 0.2 KB each).
    """
    return typed(documents, text).mapInArrow(lambda batches: encoded(batches, path, text, end_id, width, entries), "doc_id long, ids binary")
