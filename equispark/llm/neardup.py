"""Near duplicates: MinHash with banding, exact confirmation, components by star contraction.

A node is a distinct set of shingles, so exact copies cost one node whatever
their number. Nodes that share a band meet in that band's bucket. A bucket of
n nodes gives n - 1 candidate pairs with its smallest node, not all pairs; of
these each node first tries one, then those whose ends are still apart.
Confirmed links are contracted. Buckets of near copies then hold one
component. Where a bucket still holds several, all its pairs of different
components are compared by bitmaps inside the tasks, block by block, and only
those that may be linked become rows; no link of a bucket is lost.

With 40 bands of 4 minima, two sets with similarity 0.75 miss every bucket with
probability 3e-7 and at 0.8 with 6e-10.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.llm.staging import batches_of, scratch, staged
from equispark.llm.text import filled
from equispark.llm.url_filter import bloom_level
from equispark.llm.worker import alone

WORDS, BANDS, ROWS = 5, 40, 4
TASK_ROWS, BATCH_ROWS = 1 << 13, 1 << 10
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered for at most 2^17 of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    return alone("words", WordHashes)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text.

    Words are what white space parts, A-Z lower-cased. Fewer than five words
    are one shingle together; no words give none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(len(words) - WORDS + 1, 1)
    total = np.full(n, min(len(words), WORDS), np.uint64)
    for place in range(min(WORDS, len(words))):
        total += mixed(hashes[place : place + n] ^ _PLACES[place]) * _PLACES[place]
    return np.unique(mixed(total))


@lru_cache(maxsize=1)
def universal(functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of the hash family (a x + b) mod 2^64, upper 32 bits kept."""
    draw = np.random.default_rng(20_240_117)
    limit = np.iinfo(np.uint64).max
    a = draw.integers(1, limit, functions, np.uint64, endpoint=True) | np.uint64(1)
    return a, draw.integers(0, limit, functions, np.uint64, endpoint=True)


def minima(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """The minimum of every hash function over every non-empty set, a row a set."""
    a, b = universal(functions)
    out = np.full((len(sets), functions), np.iinfo(np.uint32).max, np.uint32)
    start = 0
    while start < len(sets):
        stop, held = start, 0
        while stop < len(sets) and (stop == start or held + len(sets[stop]) <= 1 << 15):
            held += len(sets[stop])
            stop += 1
        block = np.concatenate(sets[start:stop])
        bounds = np.cumsum([0, *[len(s) for s in sets[start : stop - 1]]])
        for cut in range(0, len(block), 1 << 17) if stop == start + 1 else (0,):
            part = block[cut : cut + (1 << 17)] if stop == start + 1 else block
            scratch = np.empty_like(part)
            for f in range(functions):
                np.multiply(part, a[f], out=scratch)
                np.add(scratch, b[f], out=scratch)
                low = (np.minimum.reduceat(scratch, bounds) >> np.uint64(32)).astype(np.uint32)
                np.minimum(out[start:stop, f], low, out=out[start:stop, f])
        start = stop
    return out


def _summaries(batches):
    """(doc_id, digest, n, node, minima) of each row: the text's sha256, and the node names its set by 128 bits."""
    for batch in batches:
        texts = filled(batch["text"])
        for at in range(0, batch.num_rows, 128):
            raw = [t.as_buffer().to_pybytes() for t in texts.slice(at, 128)]
            sets = [shingles(t) for t in raw]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = dict(zip(full, minima([sets[i] for i in full], BANDS * ROWS))) if full else {}
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(at, 128),
                    pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([rows[i].tobytes() if i in rows else None for i in range(len(sets))], pa.binary()),
                ],
                names=["doc_id", "digest", "n", "node", "minima"],
            )


def node_of(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minima."""
    rows = rows.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _PLACES[1]
    for r in range(ROWS):
        keys = mixed(keys ^ rows[:, :, r])
    return keys.view(np.int64)


def _bands(batches):
    """(bucket, node): the key of each band of each node's minima; a task tells of each node once."""
    seen: set[bytes] = set()
    for batch in batches:
        new = [i for i, node in enumerate(batch["node"].to_pylist()) if node not in seen and not seen.add(node)]
        if not new:
            continue
        batch = batch.take(pa.array(new, pa.int64()))
        keys = band_keys(np.frombuffer(b"".join(batch["minima"].to_pylist()), np.uint32))
        nodes = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch["node"].take(pa.array(nodes))], names=["bucket", "node"]
        )


def _similar(one: bytes, two: bytes, percent: int) -> bool:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def maybe_in(value: Column, keys: DataFrame, key: str, max_bits: int = 1 << 26, written: bool = True) -> Column:
    """True where the value is in the column `key` of `keys` (staged) or null, and for a few others.

    A Bloom filter ahead of an exact join, so that the join moves few rows. It
    has 8 MB at most; for more keys all rows go to the join.
    """
    n = keys.count()
    if 8 * n > max_bits:
        return F.lit(True)
    held = bloom_level(keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")), n, 0.05, 0, max_bits, written)
    return value.isNull() | held.holds(value)


def among(rows: DataFrame, key: str, keys: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """The rows whose key is in `keys` (staged) or null, with a few others."""
    return rows.filter(maybe_in(F.col(key), keys, key, max_bits))


def few(frame: DataFrame, rows: int) -> DataFrame:
    """The frame in tasks of about TASK_ROWS of its `rows` rows, two a core at least, and never more than it has.

    Shuffles of small tables may have many more partitions than rows to fill
    them. Partitions are read one behind the other, so a task holds no more.
    """
    return frame.coalesce(max(2 * frame.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


class Graph:
    """The nodes of a table and what confirms a pair of them."""

    def __init__(self, documents: DataFrame, percent: int):
        self.percent = percent
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = staged(self.texts.mapInArrow(_summaries, "doc_id long, digest binary, n long, node binary, minima binary"), "minima")
        self.size = self.rows.count()
        self.filled = self.rows.filter("node IS NOT NULL")
        self.nodes = self.filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))

    @scratch()
    def buckets(self) -> DataFrame:
        """Staged (bucket, node, centre) of the buckets with at least two nodes; a node may stand there more than once.

        Bucket minima are aggregated before the shuffle and written. The join
        then has a plain shuffle on either side and only a write behind it, so
        that AQE may split a bucket of a third of all nodes.
        """
        keys = self.filled.select("node", "minima").mapInArrow(_bands, "bucket long, node binary")
        ends = keys.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
        shared = staged(few(ends.filter("centre <> last").drop("last"), self.size), "shared")
        return staged(few(keys.join(shared, "bucket"), BANDS * self.size), "buckets", lasting=True)

    @scratch()
    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """Staged (node, held): the sorted shingle set of each node of `nodes` (node, doc_id)."""

        def own_sets(batches):
            for batch in batches:
                keep, sets = [], []
                for i, (node, text) in enumerate(zip(batch["node"].to_pylist(), filled(batch["text"]))):
                    held = shingles(text.as_buffer().to_pybytes())
                    if node_of(held) == node:  # another row of this doc_id may have another text
                        keep.append(i)
                        sets.append(held.tobytes())
                yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["node", "held"])

        nodes = staged(few(nodes, self.size), "needed")
        texts = among(self.texts, "doc_id", nodes)
        matched = texts.join(nodes, texts.doc_id.eqNullSafe(nodes.doc_id)).select("node", "text")
        sets = few(matched, self.size).mapInArrow(own_sets, "node binary, held binary").dropDuplicates(["node"])
        return staged(few(sets, self.size), "sets", lasting=True)

    @scratch()
    def confirmed(self, pairs: DataFrame, most: int) -> DataFrame:
        """Staged pairs (a, b) of nodes whose full sets are similar enough; there are at most `most` of them.

        Sizes and minima rule out most others first: pairs at the limit agree in
        75 % of their minima; five standard deviations below that, a pair is
        taken for unlike. The rest fetch their texts and compare whole sets.
        """
        percent = self.percent
        share, many = percent / 100, BANDS * ROWS
        least = many * share - 5 * (many * share * (1 - share)) ** 0.5
        a = self.nodes.select(F.col("node").alias("a"), F.col("doc_id").alias("doc_id_a"), F.col("n").alias("n_a"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("doc_id").alias("doc_id_b"), F.col("n").alias("n_b"))
        sized = few(few(pairs, most).join(a, "a"), most).join(b, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        sized = staged(few(sized.drop("n_a", "n_b"), most), "sized")
        most = sized.count()
        used = staged(few(sized.select(F.col("a").alias("node")).union(sized.select("b")).distinct(), self.size), "used")
        signatures = among(self.filled.select("node", "minima"), "node", used).join(used, "node", "left_semi").dropDuplicates(["node"])
        signatures = staged(few(signatures, self.size), "signatures")

        def likely(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                one, two = (
                    np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("minima_a", "minima_b")
                )
                kept = batch.filter(pa.array((one == two).sum(axis=1) >= least))
                yield pa.RecordBatch.from_arrays([kept[c] for c in ("a", "b", "doc_id_a", "doc_id_b")], names=["a", "b", "doc_id_a", "doc_id_b"])

        signed = few(sized.join(signatures.select(F.col("node").alias("a"), F.col("minima").alias("minima_a")), "a"), most).join(
            signatures.select(F.col("node").alias("b"), F.col("minima").alias("minima_b")), "b"
        )
        wanted = few(signed.select("a", "b", "doc_id_a", "doc_id_b", "minima_a", "minima_b"), most)
        wanted = staged(wanted.mapInArrow(likely, "a binary, b binary, doc_id_a long, doc_id_b long"), "pairs")
        needed = wanted.select(F.col("a").alias("node"), F.col("doc_id_a").alias("doc_id")).union(
            wanted.select("b", "doc_id_b")
        ).distinct()
        sets = self.sets_of(needed)
        most = wanted.count()
        held = few(wanted.join(sets.select(F.col("node").alias("a"), F.col("held").alias("set_a")), "a"), most).join(
            sets.select(F.col("node").alias("b"), F.col("held").alias("set_b")), "b"
        )

        def compared(batches):
            for batch in batches:
                good = [
                    i
                    for i, (x, y) in enumerate(zip(batch["set_a"], batch["set_b"]))
                    if _similar(x.as_buffer(), y.as_buffer(), percent)
                ]
                kept = batch.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], names=["a", "b"])

        return staged(few(held.select("a", "b", "set_a", "set_b"), most).mapInArrow(compared, "a binary, b binary"), "links", lasting=True)

    @scratch()
    def across(self, members: DataFrame, block: int = 1024) -> DataFrame:
        """Staged pairs (a, b) of two components in one bucket that may be linked.

        `members` has (bucket, node, component). Every pair of a bucket is
        looked at, in blocks of at most `block` by `block` nodes inside a task,
        by bitmaps of 16-bit shingle marks, which bound the intersection from
        above. Only pairs within that bound become rows. A pair that shares
        several buckets is compared in that of its first common band alone;
        its ends differ in component there as anywhere. A large bucket is many
        blocks, so no task holds all of it.
        """
        percent = self.percent

        def marks(batches):
            for batch in batches:
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch["held"]]
                found = [np.unique(own.astype(np.uint16)).tobytes() for own in sets]
                keys = [own.tobytes() for own in band_keys(minima(sets, BANDS * ROWS))]
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.array([len(own) for own in sets], pa.int64()), pa.array(found, pa.binary()), pa.array(keys, pa.binary())],
                    names=["node", "n", "mark", "keys"],
                )

        members = staged(few(members, BANDS * self.size), "in-buckets")
        ends = members.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"))
        open_ones = staged(few(ends.filter("least <> most").select("bucket", "size"), self.size), "open")
        rows = staged(few(members.join(open_ones, "bucket"), BANDS * self.size), "members").distinct()
        used = rows.select("node").distinct().join(self.nodes, "node").select("node", "doc_id")
        rows = rows.join(staged(self.sets_of(used).mapInArrow(marks, "node binary, n long, mark binary, keys binary"), "marks"), "node")
        parts = F.ceil(F.col("size") / block).cast("int")
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "mark", "keys")
        dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "node")

        def compared(batches):
            held: list[tuple] = []
            key = None
            for batch in batches:
                columns = [batch[c].to_pylist() for c in ("bucket", "i", "j", "own", "node", "component", "n", "mark", "keys")]
                for bucket, i, j, own, *row in zip(*columns):
                    if (bucket, i, j) != key and held:
                        yield from _met(held, key, percent)
                        held = []
                    key = (bucket, i, j)
                    held.append((own, *row))
            if held:
                yield from _met(held, key, percent)

        return staged(dealt.mapInArrow(compared, "a binary, b binary"), "across", lasting=True)


def _met(rows: list[tuple], key: tuple[int, int, int], percent: int):
    """The pairs of one block that differ in component and may have enough in common.

    Only pairs whose first common band is this bucket's are looked at.
    Marks are folded into bitmaps. Common shingles set common bits; two of one
    set may share a bit, so what a set lost that way is added to the count.
    """
    own = np.array([r[0] for r in rows])
    names, numbers = {}, np.empty(len(rows), np.int64)
    for at, r in enumerate(rows):
        numbers[at] = names.setdefault(r[2], len(names))
    if len(names) < 2:
        return
    sizes = np.array([r[3] for r in rows])
    width = 1 << min(16, max(10, (16 * int(sizes.max())).bit_length()))
    bitmaps = np.empty((len(rows), width // 64), np.uint64)
    for at, r in enumerate(rows):
        row = np.zeros(width, bool)
        row[np.frombuffer(r[4], np.uint16) & (width - 1)] = True
        bitmaps[at] = np.packbits(row).view(np.uint64)
    lost = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
    keys = np.stack([np.frombuffer(r[5], np.int64) for r in rows])
    pairs = []
    for x in range(len(rows)):
        later = np.arange(x + 1, len(rows)) if key[1] == key[2] else np.flatnonzero(own > own[x])
        later = later[(numbers[later] != numbers[x]) & (np.minimum(sizes[later], sizes[x]) * 100 >= np.maximum(sizes[later], sizes[x]) * percent)]
        common = keys[later] == keys[x]
        later = later[common.any(axis=1) & (keys[x][common.argmax(axis=1)] == key[0])]
        if len(later):
            both = np.bitwise_count(bitmaps[later] & bitmaps[x]).sum(axis=1, dtype=np.int64) + np.minimum(lost[later], lost[x])
            pairs += [(rows[x][1], rows[y][1]) for y in later[100 * both >= percent * (sizes[later] + sizes[x] - both)]]
    if pairs:
        ordered = [(min(p), max(p)) for p in pairs]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in ordered], pa.binary()) for k in (0, 1)], names=["a", "b"])


@scratch()
def components(links: DataFrame) -> DataFrame:
    """Staged (node, component) of all nodes in links (a, b); the component is its smallest node.

    Alternates large-star (a node's larger neighbours are tied to its smallest)
    and small-star (its smaller neighbours too) until nothing changes. Every
    round is a written table; minima are taken by partial aggregation and
    joined back, so no neighbourhood is gathered.
    """

    def with_least(edges: DataFrame, other: str, key: str) -> DataFrame:
        return edges.groupBy(key).agg(F.least(F.min(other), F.first(key)).alias("least"))

    most = links.count()
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    edges = staged(few(edges.distinct(), most), "edges")
    while True:
        most = 2 * edges.count()
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).union(edges.select("low", "high"))
        least = staged(few(with_least(both, "near", "node"), most), "least")  # joined as a table, so a hot node's neighbours may be split
        large = both.filter("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low"))
        large = staged(few(few(large, most).distinct(), most), "large-star")
        least = staged(few(large.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("lower")), most), "lowest")
        # Done when every node has one smaller neighbour and no such neighbour has one itself.
        if least.filter("lower > 1").isEmpty() and large.join(least.select(F.col("high").alias("low")), "low", "left_semi").isEmpty():
            edges = large
            break
        small = large.join(least, "high")
        small = small.select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high <> low").union(
            least.select("high", F.col("least").alias("low"))
        )
        edges = staged(few(few(small, most).distinct(), most), "small-star")
    found = edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        edges.select(F.col("low"), F.col("low")).distinct()
    )
    return staged(few(found, most), "components", lasting=True)


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found` (node, component) with further links (a, b); a component's own links are those to its smallest node."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


@scratch()
def classed(documents: DataFrame, percent: int = 75) -> DataFrame:
    """Staged (doc_id, digest, n, component) of every row; the component is null for texts without words.

    Rows with two whole sets are large, so few of them make an Arrow batch.
    """
    with batches_of(documents.sparkSession, BATCH_ROWS):
        return _classed(documents, percent)


def _classed(documents: DataFrame, percent: int) -> DataFrame:
    graph = Graph(documents, percent)
    buckets = graph.buckets()
    stars = buckets.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    stars = staged(few(stars.distinct(), BANDS * graph.size), "stars")
    found = components(graph.confirmed(stars.groupBy("b").agg(F.min("a").alias("a")), graph.size))

    # Stars whose ends are still apart.
    most = stars.count()
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    apart = few(stars.join(of_a, "a", "left"), most).join(of_b, "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    found = joined(found, graph.confirmed(apart.select("a", "b"), most))

    # Buckets in which more than one component is left.
    members = buckets.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    across = graph.across(members)
    found = joined(found, graph.confirmed(across, across.count()))

    named = graph.rows.select("doc_id", "digest", "n", "node").join(found, "node", "left")
    named = named.select("doc_id", "digest", "n", F.coalesce("component", "node").alias("component"))
    return staged(few(named, graph.size), "classed", lasting=True)


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of documents.

    Documents are linked when their sets of five-word shingles have at least
    `percent` % of their union in common; a component is named by its smallest
    doc_id and only that one is kept. Null and empty texts are linked with
    nothing. Rows that repeat a doc_id each join the component of their own
    text, and all rows with the component's smallest doc_id are kept. Null ids
    never name a component that has others, and are kept only where it has
    none. Empty tables give no rows; further columns are not read.
    """
    named = classed(documents, percent)
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = staged(few(least, named.count()), "least")
    out = named.join(least, "component", "left")
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


@scratch()
def deduplicated(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of documents, one row of each component; rows without words all stay.

    The row that stays has the smallest doc_id (null ids after all others), of
    several with that id the smallest sha256 of its text, of equal rows any one.
    A row is told by doc_id and text together, so rows that share a doc_id, or
    have none, are each judged by their own text. Columns stay as they are.
    Only rows whose doc_id may be one of those that lose a row are shuffled.
    """
    rows = classed(documents, percent).filter("component IS NOT NULL")
    most = rows.count()
    rows = staged(few(rows.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("copies")), most), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest", "copies")
    first = rows.groupBy("component").agg(F.min(place).alias("first")).select("first.*")
    later = rows.join(first, rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["digest"] == first["digest"]), "left_anti").select("doc_id", "digest")
    later = staged(few(later, most), "later", lasting=True)
    again = staged(few(first.filter("copies > 1").select("doc_id", "digest"), most), "again", lasting=True)
    asked = maybe_in(documents["doc_id"].cast("long"), later.union(again), "doc_id", written=False)
    others, documents = documents.filter(~asked), documents.filter(asked)
    same = lambda other: documents["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (digest == other["digest"])
    digest = F.unhex(F.sha2(F.coalesce(documents["text"].cast("string"), F.lit("")), 256))
    kept = documents.join(later, same(later), "left_anti")
    if again.isEmpty():
        return others.unionByName(kept)
    single = kept.join(again, same(again), "left_anti")
    twice = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return others.unionByName(single).unionByName(twice)
