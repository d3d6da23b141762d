import inspect
import tracemalloc
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from equispark.llm import binary_tokens, neardup, packing, tokens, worker
from equispark.llm.staging import BATCH, CLEANUP, batches_of, scratch, staged
from equispark.session import checkpoint_dir


def tables(spark):
    return {re.sub("^llm-|-[0-9a-f]{32}$", "", p.name): p for p in Path(checkpoint_dir(spark)).iterdir()}


@scratch()
def inner(frame):
    staged(frame, "gone-inner")
    return staged(frame, "inner", lasting=True)


def test_scopes(spark):
    frame = spark.range(5)
    with scratch():
        assert inner(frame).count() == 5
        assert "inner" in tables(spark) and "gone-inner" not in tables(spark)
        kept = staged(frame, "outer", lasting=True)
    assert "inner" not in tables(spark) and kept.count() == 5
    with pytest.raises(ZeroDivisionError), scratch():
        staged(frame, "failed")
        1 / 0
    assert "failed" not in tables(spark)


def test_near_duplicates_leave_no_tables_but_those_they_read(spark, documents):
    before = set(Path(checkpoint_dir(spark)).iterdir())
    assert neardup.deduplicated(documents).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(checkpoint_dir(spark)).iterdir()) - before}
    assert left == {"llm-later", "llm-again"}


def test_a_write_leaves_no_shuffle(spark):
    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    out = staged(spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert out.count() == 1000 and spark.conf.get(CLEANUP) == "false"
    held = files() - before
    assert not [p for p in held if p.stat().st_size > 5_000]


def test_ids_are_counted_over_batches(spark, monkeypatch):
    monkeypatch.setattr(binary_tokens, "BLOCK_IDS", 3)
    lists = [[1, 2, 2], [], [5, 2, 1, 1, 1], [9]]
    rows = spark.createDataFrame([(bytearray(np.array(ids, "<u2").tobytes()),) for ids in lists], "ids binary")
    assert binary_tokens.frequency_ranks(rows, 10).tolist() == [4, 0, 1, 5, 6, 2, 7, 8, 9, 3]


def test_a_worker_keeps_one_helper():
    neardup.shingles(b"a b c")
    words = worker.alone("words")
    assert words and worker.alone("words") is words
    worker.alone("other")
    assert not neardup.word_hashes() and list(worker._held) == ["words"]


def test_two_byte_ranks_take_the_documented_bytes():
    control, data = binary_tokens.pack(np.array([0, 255, 256, 65_535, 1, 2, 3, 4, 300], "<u4"), 1)
    assert control == bytes([0b1100, 1]) and data == bytes([0, 255, 0, 1, 255, 255, 1, 2, 3, 4, 44, 1])


def test_small_tables_take_few_tasks(spark):
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        least = 2 * spark.sparkContext.defaultParallelism
        links = spark.createDataFrame([(b"%03d" % (i // 2), b"%03d" % (i + 1)) for i in range(200)], "a binary, b binary")
        with scratch():
            found = neardup.components(links)
            assert len(list(tables(spark)["components"].glob("part-*"))) <= least
            assert found.count() == 201 and {bytes(r.component) for r in found.collect()} == {b"000"}
        assert neardup.few(spark.range(10, numPartitions=500), 400 * neardup.TASK_ROWS).rdd.getNumPartitions() == max(400, least)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_further_links_join_components(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a binary, b binary")
    found = neardup.components(pairs([(b"a", b"b"), (b"c", b"d"), (b"e", b"f")]))
    assert neardup.joined(found, pairs([])) is found
    wider = neardup.joined(found, pairs([(b"d", b"f"), (b"b", b"x")]))
    assert sorted((bytes(r.node), bytes(r.component)) for r in wider.collect()) == [
        (b"a", b"a"), (b"b", b"a"), (b"c", b"c"), (b"d", b"c"), (b"e", b"c"), (b"f", b"c"), (b"x", b"a")
    ]


def test_batches_of_large_rows_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(BATCH)
    with batches_of(spark, 64):
        rows = staged(spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert spark.conf.get(BATCH) == before and {r.n for r in rows.collect()} == {64, 1000 % 64}


def test_packing_remembers_the_pieces_of_40_mb():
    """12,000 documents of check_l, 40 MB, have 514,418 different pieces."""
    memory = tokens.Memory(inspect.signature(packing.pack).parameters["entries"].default)
    keys = [str(i) for i in range(514_418)]
    for again in (False, True):
        for at in range(0, len(keys), 40_000):
            own = keys[at : at + 40_000]
            assert not again or None not in memory.known(own)
            memory.known(own)
            memory.young.update(dict.fromkeys(own, b""))


def shuffled(frame, column):
    """(rows, bytes) that the frame's run has sent through shuffles which carry the column."""
    frame.collect()
    todo, rows, size = [frame._jdf.queryExecution().executedPlan()], 0, 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "ShuffleExchangeExec" and f"{column}#" in plan.output().mkString(","):
            rows, size = rows + plan.longMetric("shuffleRecordsWritten").value(), size + plan.longMetric("dataSize").value()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            todo.append(plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, size


def test_only_texts_that_may_go_are_shuffled(spark):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(300)]
    table = spark.createDataFrame([*rows, (300, rows[0][1]), (301, rows[1][1]), (7, rows[7][1])], "doc_id int, text string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = neardup.deduplicated(table)
        assert 0 < shuffled(out, "text")[0] < 100
        assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    finally:
        spark.conf.set(limit, before)


def test_packing_shuffles_two_bytes_an_id(spark):
    out = packing.pack(spark.createDataFrame([(1, "ab, cd " * 20_000), (2, None)], "doc_id long, text string"), tokens.vocabulary())
    ids = out.agg(F.sum("length")).first()[0]
    assert 2 * ids < shuffled(out, "held")[1] < 2.5 * ids


def test_ids_beyond_16_bits_stay_whole():
    small, large = np.array([0, 65_535, 7], "<u4"), np.array([65_536, 3], "<u4")
    assert packing.narrow(small).itemsize == 2 and packing.narrow(large) is large
    want = [small.tobytes(), large.tobytes(), small[:1].tobytes()]
    for own in ([0, 2], [1], [0, 1, 2], [2, 0]):
        lists = [(small, large, small[:1])[i] for i in own]
        held = pa.array([b"....", *(packing.narrow(x).tobytes() for x in lists)], pa.binary()).slice(1)
        got = packing.wide(held, np.array([len(x) for x in lists]))
        assert got.to_pylist() == [want[i] for i in own]


def test_packing_stage_gets_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    monkeypatch.setattr(packing, "pack", lambda docs, *_, **__: docs.mapInArrow(sizes, "n long"))
    rows = corpus_pipeline.packed(spark, spark.range(0, 3000, 1, 1), "")
    assert [r.n for r in rows.collect()] == [1024, 1024, 952]


def test_pieces_are_asked_for_together(monkeypatch):
    words = [f"{a}{b}é{c}" for a in "ABCDEFGHIJ" for b in "abcdefghij" for c in "abcdefghij"]
    text = "\n".join(words) + " " + ", ".join(w.lower() for w in words) + "  x\t\ty"
    asked, ask = [], tokens.Encoder._ask
    monkeypatch.setattr(tokens.Encoder, "_ask", lambda self, texts: asked.extend(texts) or ask(self, texts))
    own = tokens.Encoder(tokens.vocabulary())
    assert own.encode([text]) == [np.asarray(own.library.encode(text).ids, "<u4").tobytes()]
    assert len(asked) < 10


def test_slices_take_little_memory():
    texts = pa.array(["ab cd ef gh ij kl " * 20_000] * 4, pa.large_string())
    own = tokens.Encoder(tokens.vocabulary())
    tracemalloc.start()
    try:
        flat, sizes = own.ids_of(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(flat) == sizes.sum() and len(set(sizes.tolist())) == 1
    assert peak < 14 * texts.nbytes, peak / texts.nbytes
