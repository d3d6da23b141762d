"""Token ids in binary blocks: frequency-ranked, byte-aligned, with separate control bytes.

Format, version 1. A folder holds `codebook` (rank, id), `offsets` (shard,
offset) and `blocks`, rows (shard, first, payload) in ascending order of
document. A payload is, little-endian:

    4 bytes   magic "TKB1"
    u8        bits of a control code: 1 (one or two bytes an id) or 2 (one to four)
    u32 d     documents, then d x i64 doc_id, d x u8 null flag, d x i64 ids each
    u64 n     ids in all, then their control bytes, then their data bytes

An id is replaced by its rank in the whole table (0 the most frequent, ties by
id); a rank takes as many low bytes as it needs, and its control code is that
number less one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from equispark.llm.ordering import id_bounds, range_number
from equispark.llm.staging import staged
from equispark.llm.tokens import tokenized

MAGIC = b"TKB1"
BLOCK_IDS = 1 << 20
ENTRIES = 600_000  # about 180 MB a worker when full


def _lengths_table(bits: int) -> np.ndarray:
    """Byte lengths of the ids behind each control byte."""
    codes = np.arange(256)[:, None] >> (np.arange(8 // bits) * bits)
    return ((codes & ((1 << bits) - 1)) + 1).astype(np.uint8)


LENGTHS = {bits: _lengths_table(bits) for bits in (1, 2)}


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    if bits == 1:  # two byte places are all that may be used
        codes = ranks > 0xFF
        kept = np.ones((len(ranks), 2), bool)
        kept[:, 1] = codes
        return np.packbits(codes, bitorder="little").tobytes(), ranks.astype("<u2").view(np.uint8)[kept.ravel()].tobytes()
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    per = 8 // bits
    padded = np.zeros(-(-len(codes) // per) * per, dtype=np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * bits)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4) <= codes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ranks again: lengths by table lookup, then one gather for each byte place."""
    lengths = LENGTHS[bits][control].ravel()[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    ranks = np.zeros(n, dtype=np.uint32)
    for place in range(int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > place)
        ranks[longer] |= data[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return ranks


def encode_block(doc_ids: list[int | None], parts: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    bits = 1 if len(rank_of) <= 1 << 16 else 2
    ids = np.concatenate(parts)
    control, data = pack(rank_of[ids], bits)
    return b"".join(
        [
            MAGIC,
            struct.pack("<BI", bits, len(doc_ids)),
            np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray([d is None for d in doc_ids], np.uint8).tobytes(),
            np.asarray([len(p) for p in parts], "<i8").tobytes(),
            struct.pack("<Q", len(ids)),
            control,
            data,
        ]
    )


def decode_block(payload: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each, all ids one after another)."""
    if payload[:4] != MAGIC:
        raise ValueError("no token block")
    bits, d = struct.unpack_from("<BI", payload, 4)
    at = 9
    keys = np.frombuffer(payload, "<i8", d, at)
    nulls = np.frombuffer(payload, np.uint8, d, at + 8 * d)
    sizes = np.frombuffer(payload, "<i8", d, at + 9 * d)
    at += 17 * d
    (n,) = struct.unpack_from("<Q", payload, at)
    n_control = -(-n * bits // 8)
    control = np.frombuffer(payload, np.uint8, n_control, at + 8)
    data = np.frombuffer(payload, np.uint8, -1, at + 8 + n_control) if n else np.zeros(0, np.uint8)
    ids = id_of[unpack(control, data, n, bits)]
    return [None if gone else int(k) for k, gone in zip(keys, nulls)], sizes, ids


def _in_order(documents: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """Staged (shard, before, doc_id, n, ids): each shard a sorted range of documents.

    The ranges come from the id column beforehand, so texts are encoded once
    and moved once. `before` counts the shard's ids in front of the document.
    """
    bounds = id_bounds(documents, shards)
    rows = tokenized(documents, tokenizer, width="<u2", entries=ENTRIES).withColumn("shard", range_number(F.col("doc_id"), bounds))
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")

    def numbered(batches):
        shard, before = None, 0
        for batch in batches:
            starts, counts = [], []
            for own, ids in zip(batch["shard"].to_pylist(), batch["ids"]):
                before = before if own == shard else 0
                shard = own
                starts.append(before)
                counts.append(len(ids.as_buffer()) // 2)
                before += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch["shard"], pa.array(starts, pa.int64()), batch["doc_id"], pa.array(counts, pa.int64()), batch["ids"]],
                names=["shard", "before", "doc_id", "n", "ids"],
            )

    return staged(rows.mapInArrow(numbered, "shard int, before long, doc_id long, n long, ids binary"), "tokens")


def frequency_ranks(rows: DataFrame, size: int) -> np.ndarray:
    """The rank of each of `size` ids over all rows; the driver gets one number an id."""

    def counted(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch["ids"].to_pylist()), "<u2")
            for at in range(0, len(ids), BLOCK_IDS):  # many documents at once: each count passes over the vocabulary
                total += np.bincount(ids[at : at + BLOCK_IDS], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = rows.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    totals = np.zeros(size, dtype=np.int64)
    for row in counts.collect():
        totals[row.id] = row.n
    ranks = np.empty(size, dtype=np.uint32)
    ranks[np.lexsort((np.arange(size), -totals))] = np.arange(size, dtype=np.uint32)
    return ranks


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, vocabulary_size: int = 50_257, shards: int = 0) -> None:
    """Encodes every whole text and writes the blocks in ascending doc_id order.

    Null texts are empty and have the end id alone. Null ids come first,
    repeated ids in the order of their tokens. Extra columns are not read. An
    empty table writes empty folders. `shards` (by default the session's
    shuffle partitions) only sizes the work. Vocabularies hold at most 65,536
    ids here; the format itself allows more.
    """
    if vocabulary_size > 1 << 16:
        raise ValueError(f"a vocabulary of {vocabulary_size} ids, {1 << 16} may be written")
    spark = documents.sparkSession
    rows = _in_order(documents, tokenizer, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rank_of = frequency_ranks(rows, vocabulary_size)

    def blocks(batches):
        shard, first, keys, parts, held = None, 0, [], [], 0

        def done():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "first": [first], "payload": [encode_block(keys, parts, rank_of)]},
                schema=pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            for own, before, key, ids in zip(
                batch["shard"].to_pylist(), batch["before"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]
            ):
                if keys and (own != shard or held >= BLOCK_IDS or before != first + held):
                    yield done()
                    keys, parts, held = [], [], 0
                if not keys:
                    shard, first = own, before
                keys.append(key)
                parts.append(np.frombuffer(ids.as_buffer(), "<u2").copy())
                held += len(parts[-1])
        if keys:
            yield done()

    rows.mapInArrow(blocks, "shard int, first long, payload binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")
    sums = rows.groupBy("shard").agg(F.sum("n").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    offsets = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets.write.parquet(f"{folder}/offsets")
    code = [(int(rank), i) for i, rank in enumerate(rank_of)]
    spark.createDataFrame(code, "rank int, id int").coalesce(1).write.parquet(f"{folder}/codebook")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids are little-endian 32-bit integers."""
    codebook = spark.read.schema("rank int, id int").parquet(f"{folder}/codebook").collect()
    id_of = np.zeros(len(codebook), dtype="<u4")
    for row in codebook:
        id_of[row.rank] = row.id
    offsets = spark.read.schema("shard int, offset long").parquet(f"{folder}/offsets")
    blocks = spark.read.schema("shard int, first long, payload binary").parquet(f"{folder}/blocks")

    def decoded(batches):
        for batch in batches:
            for start, payload in zip(batch["start"].to_pylist(), batch["payload"]):
                keys, sizes, ids = decode_block(payload.as_buffer().to_pybytes(), id_of)
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.join(offsets, "shard").select((F.col("first") + F.col("offset")).alias("start"), "payload")
    return placed.mapInArrow(
        decoded,
        T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("start", T.LongType()),
                T.StructField("n_tokens", T.LongType()),
                T.StructField("ids", T.BinaryType()),
            ]
        ),
    )
