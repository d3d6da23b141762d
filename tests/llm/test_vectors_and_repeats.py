"""Whitening, hard negatives and repeated passages against brute force, and on odd tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from equispark.llm import negatives, queries, repeats, vectors, whitening

SMALL = "/root/testdata/sf0.001"
ODD = [(901, None, 1), (902, [1.0, None], 1), (903, [1.0, float("nan")], 1), (904, [float("inf"), 0.0], 1), (905, [], 1), (906, [1.0], 1)]
SCHEMA = "vec_id long, embedding array<float>, label int"


def clashing(frame):
    return frame.select("*", *[F.lit(7).alias(c) for c in ("x", "key", "n", "component", "number", "size", "anchor_id")])


def expected_whitening(rows, count=16):
    """By numpy's eigenvectors of the distinct rows: (n, sums, eigenvalues, components, trace)."""
    x = np.unique(np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000, axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:count], parts[:, ::-1][:, :count], values.sum()


def check_whitening(got, rows):
    n, sums, values, parts, trace = expected_whitening([v for _, v in rows])
    kept = int((values > 1e-20 * values[0]).sum())
    assert len(got) == len(rows) * kept
    first = {}
    for r in got:
        first.setdefault(r.component, r)
        assert r.n == n and abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    white = {key: [r.whitened for r in sorted(own, key=lambda r: r.component)] for key, own in by_id.items()}
    for key, vector in rows:
        moved = n * (np.floor(64 * np.array(vector, float)).astype(np.int64) + 1_000_000) - sums
        assert {int(r.deviation) for r in by_id[key]} == {int((moved.astype(object) ** 2).sum())}
    return white, n, sums, values[:kept], parts[:, :kept]


def test_whitening_matches_eigenvectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = queries.op11_whitening(spark, SMALL).collect()
    white, n, sums, values, parts = check_whitening(got, rows)
    moved = np.array([n * (np.floor(64 * np.array(v, float)) + 1_000_000) - sums for _, v in rows]) / n
    ours = np.array([white[key] for key, _ in rows])
    theirs = moved @ parts / np.sqrt(values)
    signs = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * signs - theirs).max() < 1e-9


def test_whitening_on_odd_rows(spark):
    """Repeated vectors count once, equal variances are all found, a flat direction makes no component."""
    rows = [(1, [1.0, 0.0, 0.0, 5.0]), (2, [-1.0, 0.0, 0.0, 5.0]), (3, [0.0, 1.0, 0.0, 5.0]), (4, [0.0, -1.0, 0.0, 5.0]), (5, [0.0, 0.0, 1.0, 5.0]), (6, [0.0, 0.0, -1.0, 5.0])]
    rows += [(10 + i, [1.0, 0.0, 0.0, 5.0]) for i in range(20)]
    odd = [(a, None if b is None else b * 2, c) for a, b, c in ODD]
    table = clashing(spark.createDataFrame([(a, b, None) for a, b in rows] + odd, SCHEMA).drop("label"))
    got = whitening.whitened(table).collect()
    _, n, _, values, _ = check_whitening(got, rows)
    assert n == 6 and len(values) == 3
    assert whitening.whitened(table.limit(0)).collect() == []
    assert whitening.whitened(table.filter("vec_id >= 10 AND vec_id < 900")).collect() == []  # no spread


def test_whitening_of_far_entries_is_exact(spark):
    """Sums beyond a double's and a long's reach; a null key keeps its rows."""
    rows = [(i, [float(2**45 + 3 * i), float(i * i)]) for i in range(40)]
    table = spark.createDataFrame([(a if a else None, b, 0) for a, b in rows], SCHEMA.replace("float", "double"))
    got = whitening.whitened(table).collect()
    n, sums, *_ = expected_whitening([v for _, v in rows])
    for r in got:
        i = r.vec_id or 0
        moved = [n * (int(64 * v) + 1_000_000) - int(s) for v, s in zip(rows[i][1], sums)]
        assert int(r.deviation) == sum(m * m for m in moved)
    assert len(got) == 80


def test_bidiagonalisation_is_orthonormal():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 20)) * np.geomspace(1, 1e-4, 20)
    product = lambda basis, w: np.concatenate([(x @ basis).T @ (x @ w), [(x @ w) @ (x @ w)], x.T @ (x @ w)])
    state = whitening.Bidiagonalisation(product, 20, float(np.linalg.norm(x)))
    for _ in range(20):
        state.step()
    v, u = np.array(state.v), x @ np.array(state.w).T
    assert np.abs(v @ v.T - np.eye(20)).max() < 1e-13 and np.abs(u.T @ u - np.eye(20)).max() < 1e-9
    assert np.allclose(state.solved()[0], np.linalg.svd(x, compute_uv=False), rtol=1e-10)


def brute_negatives(rows, every=100, low=30, high=90):
    """rows: (vec_id, vector, label) that take part."""
    x = [np.floor(256 * np.array(v, float)).astype(int) for _, v, _ in rows]
    out = []
    for a, (own, _, label) in enumerate(rows):
        if own is None or own % every:
            continue
        scores = [int(x[a] @ v) for v in x]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][0] is None, rows[i][0] or 0))
        for p in [i for i in order if rows[i][2] == label and rows[i][0] != own][:5]:
            fit = [i for i in order if rows[i][2] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]][:10]
            out += [(own, rows[p][0], rank, rows[i][0], scores[p], scores[i]) for rank, i in enumerate(fit, 1)]
    return sorted(out, key=str)


def test_hard_negatives_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_hard_negatives(spark, SMALL).collect()), key=str)
    assert got == brute_negatives(rows) and got


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_hard_negatives_on_odd_rows(spark, group_rows):
    """Ties, repeated rows, null ids, scores of zero, below zero; anchors in one group and in several."""
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in draw.integers(-2, 3, 2)], int(draw.integers(3))) for i in range(0, 900, 3)]
    rows += [(300, [1.0, 1.0], 0), (300, [1.0, 1.0], 0), (None, [1.0, 2.0], 1), (500, [0.0, 0.0], 2), (1200, [-1.0, -1.0], 0)]
    table = clashing(spark.createDataFrame([*rows, *ODD, (1300, [1.0, 1.0], None)], SCHEMA)).repartition(7)
    got = sorted((tuple(r) for r in negatives.hard_negatives(table, group_rows=group_rows).collect()), key=str)
    assert got == brute_negatives(rows) and {300, 500} & {r[0] for r in got}
    assert negatives.hard_negatives(table.limit(0)).collect() == []


def test_packed_keys_keep_their_order():
    score, ids = np.array([5, -7, 0, 1 << 40, -(1 << 40)]), np.array([0, -3, negatives.NO_ID, 9, 1 << 62])
    keys = negatives.packed(np.arange(5) % 2, score, negatives.NEGATIVE, ids)
    assert [negatives.unpacked(k) for k in keys] == [(i % 2, s, 1, n) for i, (s, n) in enumerate(zip(score.tolist(), ids.tolist()))]
    assert [negatives.unpacked(k)[:2] for k in sorted(keys)] == sorted(((i % 2, s) for i, s in enumerate(score.tolist())), key=lambda p: (p[0], -p[1]))


def test_gridded_keeps_the_most_frequent_length(spark):
    table = spark.createDataFrame([(1, [0.5, -0.01], 1), (2, [1e30, -1e30], 1), *ODD], SCHEMA)
    assert sorted(map(tuple, vectors.gridded(table, 64, 1).select("vec_id", "x").collect())) == [(1, [33, 0]), (2, [2**52 + 1, 1 - 2**52])]


WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_repeats(rows):
    """(doc_id, n_words, n_removed, sha256 of the kept words) of rows (doc_id, text)."""
    first, out = {}, []
    for own, text in rows:
        words = WORDS.findall(text or "")
        for i in range(len(words) - 12 if own is not None else 0):
            key = tuple(words[i : i + 13])
            first[key] = min(first.get(key, own), own)
    for own, text in rows:
        words = WORDS.findall(text or "")
        gone = set()
        for i in range(len(words) - 12 if own is not None else 0):
            if first[tuple(words[i : i + 13])] < own:
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((own, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def test_repeats_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_repeats(spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute_repeats(rows) and any(r[2] for r in got)


@pytest.mark.parametrize("max_bits", [repeats.MAX_BITS, 64])
def test_repeats_by_filter_and_by_joins(spark, max_bits):
    """Shared runs of 12 to 15 words at every pair of shifts, few different words, odd characters, long words."""
    draw = np.random.default_rng(2)
    rows = [(1000 + i, " ".join(draw.choice(["a", "b"], int(draw.integers(0, 60))))) for i in range(60)]
    passage = [f"p{i}" for i in range(40)]
    for shift in range(14):
        for length in (12, 13, 15):
            rows.append((len(rows), " ".join([f"u{shift}{length}{i}" for i in range(shift)] + passage[shift : shift + length] + ["end"])))
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (None, " ".join(passage)), (None, None)]
    rows += [(3003, " ".join(passage)), (3004, "\n".join(passage)), (3005, "x" * 9000 + " " + " ".join(passage)), (3006, "x" * 9000 + " " + " ".join(passage))]
    rows += [(3007, " ".join(passage)), (3007, " ".join(passage)), (3007, "Ä ß " * 20), (3008, "Ä ß " * 20), (-5, " ".join(passage[3:30]))]
    rows += [(4000, "long text of words " * 60_000), (4001, "of words long text " * 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("marks", "runs", "anchor", "at", "kept")])
    assert found(repeats.without_repeats(table, max_bits)) == brute_repeats(rows)
    assert found(repeats.without_repeats(table.limit(0), max_bits)) == []


def test_the_cover_meets_every_pair_of_positions():
    for i in range(repeats.PERIOD):
        for j in range(repeats.PERIOD):
            assert any((i + s) % repeats.PERIOD in repeats.COVER and (j + s) % repeats.PERIOD in repeats.COVER for s in range(repeats.PERIOD))
