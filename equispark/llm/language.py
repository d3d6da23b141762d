"""Language of texts: the nearest of several TF-IDF centroids a language, by cosine."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.llm.sampling import place
from equispark.llm.text import filled, slices
from equispark.llm.worker import alone

SIZE = 1 << 13
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"
BLOCK_ROWS, BLOCK_BYTES = 64, 1 << 20
# Lengths in characters of the pieces cut from held-back texts; texts are told apart by the power of 2 of their distinct grams.
CUTS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
CLASSES, FOLDS, FEW = 14, 4, 8
LEAST = 1e-3  # below it a text shares nothing with its centroid

# Letters stay, any other ASCII byte is a blank; bytes from 0x80 on are parts of letters.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams of one to three bytes, a row a text; a very long text is counted in pieces."""
    parts = [b"  " + t.lower().encode("utf-8", "replace").translate(_LETTERS) + b" " for t in texts]
    if all(len(p) <= BLOCK_BYTES for p in parts):
        return _counted(parts)
    cut = lambda p: (p[at : at + BLOCK_BYTES + 2] for at in range(0, len(p) - 2, BLOCK_BYTES))
    return np.concatenate([sum(_counted([piece]) for piece in cut(p)) for p in parts])


def _counted(parts: list[bytes]) -> np.ndarray:
    """Counts of the n-grams that end behind the first two bytes of each part."""
    row = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])[2:] * SIZE
    text = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    one, two, three = text[2:], text[1:-1], text[:-2]
    counts = np.zeros(len(parts) * SIZE, dtype=np.float32)
    blank = one == 0x20
    for code, keep in (
        (one, ~blank),
        (one | two << 8 | np.uint32(1 << 24), ~(blank & (two == 0x20))),
        (one | two << 8 | three << 16 | np.uint32(2 << 24), ~(blank & (two == 0x20)) & ~((two == 0x20) & (three == 0x20) & blank)),
    ):
        mixed = code * np.uint32(2654435761)
        cell = row + ((mixed ^ mixed >> 15) * np.uint32(2246822519) >> np.uint32(32 - 13))
        counts += np.bincount(cell[keep], minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(parts), SIZE)


def blocks(rows: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with their counts, so many at a time that the matrix stays small."""
    for start in range(0, rows.num_rows, BLOCK_ROWS):
        for part in slices(rows.slice(start, BLOCK_ROWS), column, BLOCK_BYTES):
            yield part, gram_counts(filled(part[column]).to_pylist())


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; a row without grams stays 0."""
    weights = np.log1p(counts) * idf
    length = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(length > 0, length, 1)


def centroids_of(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from seeds that lie far apart; no random numbers."""
    seeds = [vectors.sum(axis=0)]
    near = vectors @ (seeds[0] / max(np.linalg.norm(seeds[0]), 1e-12))
    chosen = []
    for _ in range(min(clusters, len(vectors))):
        pick = int(near.argmin())
        chosen.append(vectors[pick])
        near = np.maximum(near, vectors @ vectors[pick])
    centres = np.array(chosen, dtype=np.float32)
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The power of 2 of each row's distinct grams."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(int)


def pieces(text: str) -> list[str]:
    """A text and one cut of it of each length in CUTS, those with a letter."""
    at = zlib.crc32(text.encode("utf-8", "replace"))
    cut = [text[at % (len(text) - n) :][:n] for n in CUTS if n < len(text)]
    return [t for t in [text, *cut] if any(c.isalpha() for c in t)]


def bounds_of(texts: list[str], vectors: np.ndarray, idf: np.ndarray, clusters: int, margin: float) -> np.ndarray:
    """The least likeness of each length class, from texts that the centroids have not seen.

    Each fold is compared with the centroids of the others, whole and in cuts,
    as short texts are less like any centroid than long ones. A class takes the
    likeness that 1 in 100 of its pieces fall short of, less the margin. A
    class of fewer than FEW pieces has the bound of the next shorter one, and a
    shorter class never asks for more than a longer one. If all classes have
    fewer, one bound is taken from all pieces.
    """
    likeness, kinds = [], []
    for fold in range(FOLDS):
        own = np.arange(len(texts)) % FOLDS == fold
        if own.any() and not own.all():
            centres = centroids_of(vectors[~own], clusters)
            for i in np.flatnonzero(own):
                parts = pieces(texts[i])
                if parts:
                    counts = gram_counts(parts)
                    likeness.append((unit(counts, idf) @ centres.T).max(axis=1))
                    kinds.append(classes_of(counts))
    if not likeness:
        return np.full(CLASSES, LEAST)
    likeness, kinds = np.concatenate(likeness), np.concatenate(kinds)
    many = [k for k in range(CLASSES) if (kinds == k).sum() >= FEW]
    if not many:
        return np.full(CLASSES, max(np.quantile(likeness, 0.01) * (1 - margin), LEAST))
    found = np.array([np.quantile(likeness[kinds == k], 0.01) for k in many]) * (1 - margin)
    found = np.minimum.accumulate(found[::-1])[::-1]
    return np.maximum([found[np.searchsorted(many, k, side="right") - 1] if k >= many[0] else LEAST for k in range(CLASSES)], LEAST)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray  # by centroid and length class; texts less like their centroid are rejected

    def judge(self, texts: list[str], counts: np.ndarray) -> tuple[list[str], list[float], list[bool]]:
        letters = [any(c.isalpha() for c in t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        likeness = unit(counts, self.idf) @ self.centroids.T
        best = likeness.argmax(axis=1)
        scores = np.clip(likeness[np.arange(len(best)), best], 0, 1).astype(float)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        scores[~np.array(letters, dtype=bool)] = 0.0
        far = scores < self.bounds[best, classes_of(counts)]
        return names, scores.tolist(), [not ok or bool(f) for ok, f in zip(letters, far)]


def fit(
    labelled: DataFrame, clusters: int = 4, sample_rows: int = 400, max_languages: int = 500, margin: float = 0.25
) -> LanguageModel:
    """Learns from (doc_id, text, lang) rows whose lang is not null.

    Document frequencies count every such row. The centroids are clustered from
    a bounded sample: the `sample_rows` different documents of each language whose
    hashes of id, then text, are smallest, each language in one task of its own. Texts are rejected
    that are less like their nearest centroid than that centroid's language
    allows at their length (`bounds_of`). A language with one distinct text only
    has nothing to hold back: there, only texts that share nothing with it are rejected.
    Null texts count as empty. Without a labelled row the model knows no language and rejects all.
    """
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "lang")
    rows = rows.filter(F.col("lang").isNotNull()).withColumn(
        "draw", F.struct(F.xxhash64(F.col("doc_id").cast("string")).alias("id"), F.xxhash64("text").alias("text"))
    )
    order = W.partitionBy("lang").orderBy("draw")
    # Counts by the place of the hash bound what is ranked, so no partition sends its own first rows.
    draws = rows.select("lang", "draw").distinct()
    at = place(F.col("draw.id"))
    counted = draws.groupBy("lang", at.alias("place")).count()
    before = F.sum("count").over(W.partitionBy("lang").orderBy("place")) - F.col("count")
    near = counted.withColumn("before", before).filter(F.col("before") < sample_rows)
    near = near.groupBy("lang").agg(F.max("place").alias("place")).limit(max_languages + 1).collect()
    if len(near) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if near:
        bound = F.create_map(*[F.lit(x) for row in near for x in (row.lang, row.place)])
        draws = draws.filter(at <= bound[F.col("lang")])
    ranked = draws.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_rows)
    last = ranked.groupBy("lang").agg(F.max("draw").alias("draw")).collect() if near else []
    if not last:
        return LanguageModel([], np.zeros((0, SIZE), np.float32), np.ones(SIZE, np.float32), np.ones((0, CLASSES)))

    def frequencies(batches):
        alone("language")
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for part, counts in blocks(batch):
                total += (counts > 0).sum(axis=0)
                n += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *total[used].tolist()], pa.int64())], names=["gram", "n"]
        )

    df = np.zeros(SIZE, dtype=np.float64)
    documents = 0
    for row in rows.select("text").mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        if row.gram < 0:
            documents = row.n
        else:
            df[row.gram] = row.n
    idf = (np.log((1 + documents) / (1 + df)) + 1).astype(np.float32)
    weights = spark.sparkContext.broadcast(idf)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "text"])
        vectors = np.concatenate([unit(gram_counts([t]), weights.value) for t in group["text"]])
        used = np.linalg.norm(vectors, axis=1) > 0
        first = used & ~group["text"].duplicated().to_numpy()  # copies held back would be met again
        bounds = bounds_of(group["text"][first].tolist(), vectors[first], weights.value, clusters, margin)
        vectors = vectors[used]
        centres = centroids_of(vectors, clusters) if len(vectors) else np.zeros((0, SIZE), np.float32)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in centres], "bounds": [bounds.tolist()] * len(centres)})

    until = lambda part: F.create_map(*[F.lit(x) for row in last for x in (row.lang, row.draw[part])])[F.col("lang")]
    sample = rows.filter(F.col("draw") <= F.struct(until("id").alias("id"), until("text").alias("text")))
    # One row of each draw, so that copies and rows without an id do not swell the one task of their language.
    sample = sample.dropDuplicates(["lang", "draw"]).select("lang", "text", F.col("draw.id").alias("draw"))
    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, bounds array<double>").collect()
    found = sorted(found, key=lambda r: (r.lang, r.centre))
    centres = np.array([np.frombuffer(r.centre, "<f4") for r in found]).reshape(-1, SIZE)
    bounds = np.array([r.bounds for r in found]).reshape(-1, CLASSES)
    return LanguageModel([r.lang for r in found], centres, idf, bounds)


def judged(model: LanguageModel, documents: DataFrame, text: str | Column = "text") -> Column:
    """A struct (lang_pred, score, rejected) of a text column, by a model of bounded size."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judge(column: pa.Array) -> pa.Array:
        alone("language")
        names, scores, out = [], [], []
        for part, counts in blocks(pa.RecordBatch.from_arrays([filled(column)], names=["text"])):
            for held, more in zip((names, scores, out), shared.value.judge(part["text"].to_pylist(), counts)):
                held += more
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())],
            names=["lang_pred", "score", "rejected"],
        )

    return judge((F.col(text) if isinstance(text, str) else text).cast("string"))


def held_out(doc_id: Column) -> Column:
    """The third of the documents that is kept from learning; null ids belong to it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(True))


def identify(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row.

    Learns from the documents that are not held out and have a lang. `und` with
    score 0 for null texts and texts without a letter; all others get a learned
    language, and `rejected` says whether they lie too far from it. Repeated
    rows repeat, an empty table gives none, further columns are not read.
    """
    outside = held_out(F.col("doc_id"))
    model = fit(documents.filter(~outside), **options)
    found = judged(model, documents)
    return documents.select("doc_id", outside.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")
