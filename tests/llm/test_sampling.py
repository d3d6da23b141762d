import numpy as np
import pytest
from pyspark.sql import functions as F

from equispark.llm import language, pii, quality
from equispark.llm.sampling import place, smallest


@pytest.mark.parametrize("n", [1, 7, 500, 5000])
def test_smallest_hashes(spark, n):
    rows = spark.range(0, 3000, 1, 11).withColumn("draw", F.xxhash64("id"))
    copied = rows.union(rows.filter("id < 40")).union(rows.filter("id = 5").withColumn("many", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("many"))
    found = [r.draw for r in smallest(copied, n).collect()]
    assert found == sorted(r.draw for r in rows.collect())[:n]


def test_smallest_of_extremes_and_of_nothing(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 1]
    rows = spark.createDataFrame([(d,) for d in ends], "draw long")
    places = [r.p for r in rows.orderBy("draw").select(place(F.col("draw")).alias("p")).collect()]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 65_536
    assert [r.draw for r in smallest(rows, 4).collect()] == ends[:4]
    assert smallest(rows.limit(0), 4).count() == 0


def test_grams_of_a_very_long_text_are_counted_in_pieces(monkeypatch):
    texts = ["Ein Satz mit ü und 中文, noch einer. " * 40, "", "kurz", "x" * 257]
    whole = language.gram_counts(texts)
    for size in (1, 2, 3, 64, 257, 1000):
        monkeypatch.setattr(language, "BLOCK_BYTES", size)
        assert np.array_equal(language.gram_counts(texts), whole)


def test_copies_do_not_swell_the_sample_of_a_language(spark):
    """The copies have the smallest hash; had each its place in the sample, no other text of the language would be learnt."""
    words = "red green blue black white brown grey pink gold silver dark light cold warm old new".split()
    first = spark.range(100).orderBy(F.xxhash64(F.col("id").cast("string"))).first().id
    english = [(200 + i, f"the {a} house is near the {b} river", "en") for i, (a, b) in enumerate(zip(words, words[::-1]))]
    rows = [(first, "one and the same text again", "en")] * 400 + english
    rows += [(None, f"das haus {w} steht am fluss", "de") for w in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.fit(docs, sample_rows=20)
    english = [lang == "en" for lang in model.languages]
    assert len({c.tobytes() for c in model.centroids[english]}) > 1
    assert (model.bounds > language.LEAST).any(axis=1).all()


def test_models_learn_the_same_from_any_partitioning(spark):
    rows = [(i, f"call +1 (212) 555-0{i:03d} or write a{i}@b.org, number {i}") for i in range(60)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (pii.fit(docs.repartition(n), sample_rows=20, sample_windows=60, rounds=1, each=5) for n in (1, 13))
    texts = [t for _, t in rows[:10]]
    assert pii.spans_in(texts, one) == pii.spans_in(texts, many)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 4 + [(None, 1)], "doc_id long, quality int")
    one, many = (quality.fit(docs.repartition(n), labels.repartition(n), sample_rows=30) for n in (1, 13))
    assert np.array_equal(one.weights, many.weights) and one.slope == pytest.approx(many.slope)
