"""Text quality by hierarchical empirical Bayes: document evidence, host and path posteriors."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.llm.sampling import smallest
from equispark.llm.staging import staged
from equispark.llm.text import filled, words_of

SIZE = 1 << 16
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def features(text: bytes) -> np.ndarray:
    """Distinct hashed words of a text, and its shape as a few more of them."""
    words = words_of(text)
    distinct = set(words)
    raw = np.frombuffer(text, np.uint8)
    n, size = max(len(words), 1), max(len(raw), 1)
    letters = max(int(_LETTER[raw].sum()), 1)
    shape = (
        ("words", len(words).bit_length()),
        ("distinct", int(10 * len(distinct) / n)),
        ("upper", int(10 * _UPPER[raw].sum() / letters)),
        ("letters", int(20 * letters / size)),
        ("digits", min(int(50 * _DIGIT[raw].sum() / size), 9)),
        ("length", min(int(sum(map(len, words)) / n), 15)),
        ("lines", min(int(20 * text.count(b"\n") / n), 9)),
    )
    named = [f"#{k}={v}".encode() for k, v in shape]
    return np.unique(np.fromiter(map(zlib.crc32, [*distinct, *named]), np.uint32) % SIZE)


class Evidence:
    """Naive Bayes log odds over distinct features, calibrated to a probability."""

    def __init__(self, weights: np.ndarray, slope: float, base: float):
        self.weights, self.slope, self.base = weights, slope, base

    def raw(self, text: bytes) -> float:
        ids = features(text)
        return float(self.weights[ids].sum() / len(ids) ** 0.5)

    def probability(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.base + self.slope * self.raw(text), -30, 30))))


def calibrated(raw: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps; flat where a class is missing."""
    slope, base = 0.0, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(25 if 0 < label.sum() < len(label) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ [slope, base], -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (label - p) - ridge * np.array([slope, 0]))
        slope, base = slope + step[0], base + step[1]
    return slope, base


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 50_000) -> Evidence:
    """Learns from the `sample_rows` labels with the smallest hash of id and label; repeated labels count once.

    Word counts come from four fifths of them, the calibration from the rest.
    Labels other than 0 and 1 are left out; without any the evidence is even.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    known = smallest(known.filter("doc_id IS NOT NULL").withColumn("draw", F.xxhash64("doc_id", "y")), sample_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("text", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside"))

    def counted(batches):
        total, n = np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(filled(batch["text"]), batch["y"].to_pylist()):
                total[y, features(text.as_buffer().to_pybytes())] += 1
                n[y] += 1
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used.tolist()], pa.int32()), *(pa.array([n[y], *total[y, used].tolist()], pa.int64()) for y in (0, 1))],
            names=["feature", "n0", "n1"],
        )

    counts = rows.filter("NOT aside").select("text", "y").mapInArrow(counted, "feature int, n0 long, n1 long")
    table, n = np.zeros((2, SIZE)), np.zeros(2)
    for r in counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        if r.feature < 0:
            n[:] = r.n0, r.n1
        else:
            table[:, r.feature] = r.n0, r.n1
    rates = (table + 0.5) / (n[:, None] + 1)
    evidence = Evidence(np.where(table.sum(axis=0) > 1, np.log(rates[1] / rates[0]), 0.0), 0.0, 0.0)
    shared = spark.sparkContext.broadcast(evidence)

    def scored(batches):
        for batch in batches:
            raw = [shared.value.raw(t.as_buffer().to_pybytes()) for t in filled(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch["y"]], names=["raw", "y"])

    held = rows.filter("aside").select("text", "y").mapInArrow(scored, "raw double, y int").collect()
    if held:
        slope, base = calibrated(np.array([r.raw for r in held]), np.array([r.y for r in held], float))
        evidence = Evidence(evidence.weights, slope, base)
    return evidence


def _strength(mean: Column, spread: Column) -> Column:
    """Pseudo-documents of a beta prior with this mean and variance, at least 1."""
    room = mean * (1 - mean)
    return F.when(spread > 0, F.least(F.greatest(room / spread - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)


def _between(n: str, total: str, centre: Column) -> Column:
    """Variance of group means beyond what the sizes of the groups explain (method of moments)."""
    mean = F.col(total) / F.col(n)
    groups, rows = F.count("*"), F.sum(n)
    noise = F.sum(mean * (1 - mean))
    return F.greatest((F.sum(F.col(n) * (mean - centre) ** 2) - noise) / F.greatest(rows - groups, F.lit(1)), F.lit(0.0))


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def classify(documents: DataFrame, evidence: Evidence, host: Column, path: Column, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_doc, n_host, n_path, host_posterior, path_posterior, score, kept) of every row.

    Paths shrink towards their host and hosts towards the whole table, each by
    a prior whose strength is the spread between the groups, so sparse sites
    follow the global rate. A row's own evidence is taken out of its path's and
    host's sums. The score adds the log odds of the text and of its path
    relative to the global ones. Null hosts and paths are groups of their own,
    null texts empty; repeated rows repeat; empty tables give no rows; further
    columns are not read. Sums are taken per path, then per host, before any
    join; a host with a third of all rows is one row there.
    """
    shared = documents.sparkSession.sparkContext.broadcast(evidence)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.probability(t.as_buffer().to_pybytes()) for t in filled(texts)], pa.float64())

    rows = documents.select(
        "doc_id",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        probability(F.col("text").cast("string")).alias("p_doc"),
    )
    rows = staged(rows, "evidence")
    # Sums in whole millionths do not depend on the order of addition.
    whole = F.round(F.col("p_doc") * 1_000_000).cast("long")
    paths = staged(rows.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum(whole).alias("s")).select(
        "host", "path", "n_path", (F.col("s") / 1_000_000).alias("s_path")
    ), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    first = hosts.agg((F.sum("s_host") / F.sum("n_host")).alias("mean")).first()
    mean = F.lit(first.mean if first.mean is not None else 0.5)
    spread = hosts.agg(_between("n_host", "s_host", mean).alias("v")).first().v
    above = F.lit(mean)
    strong = _strength(mean, F.lit(spread or 0.0))
    hosts = hosts.withColumn("centre", (strong * above + F.col("s_host")) / (strong + F.col("n_host")))
    placed = paths.join(hosts, "host")
    inner = placed.agg(_between("n_path", "s_path", F.col("centre")).alias("v")).first().v
    inner_strong = _strength(mean, F.lit(inner or 0.0))
    own = F.col("p_doc")
    host_posterior = (strong * mean + F.col("s_host") - own) / (strong + F.col("n_host") - 1)
    joined = rows.join(placed.drop("centre"), ["host", "path"]).withColumn("host_posterior", host_posterior)
    path_posterior = (inner_strong * F.col("host_posterior") + F.col("s_path") - own) / (inner_strong + F.col("n_path") - 1)
    joined = joined.withColumn("path_posterior", path_posterior)
    score = 1 / (1 + F.exp(-(_logit(own) + _logit(F.col("path_posterior")) - _logit(mean))))
    return joined.withColumn("score", score).select(
        "doc_id", "p_doc", "n_host", "n_path", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept")
    )
