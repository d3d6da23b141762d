"""Url lists as a cascade of Bloom filters: exact membership without joins.

Level 0 holds the listed keys. The keys of the universe that are not listed but
pass it go into level 1, the listed ones that pass level 1 into level 2, and so
on until nothing passes wrongly. The first level that a key of the universe
fails tells whether it is listed. Everything is built-in column work; a level
is one array of 64-bit words, sent to the tasks as a scalar subquery.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row, one column `bits`: array<bigint>
    size: int  # bits, a multiple of 64
    hashes: int
    number: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 64 + i)), F.lit(self.size)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        bits, out = self.words.scalar(), F.lit(True)
        for place in self.places(key):
            word = F.get(bits, (place / 64).cast("int"))
            out = out & (F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return out


@dataclass(frozen=True)
class Cascade:
    """The levels, the listed keys first."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """True for listed keys, False for all others of the universe; false for null."""
        if not self.levels:
            return F.lit(False)
        out = F.when(key.isNull(), False)
        for level in self.levels:
            out = out.when(~level.holds(key), level.number % 2 == 1)
        return out.otherwise(len(self.levels) % 2 == 1)


def bloom_level(keys: DataFrame, count: int, rate: float, number: int, max_bits: int, written: bool = True) -> Level:
    """A Bloom filter of `count` keys with about the false-positive rate asked for; made by each query that asks it unless it is written."""
    hashes = max(1, round(math.log2(1 / rate)))
    size = max(64, -(-int(count * hashes / math.log(2)) // 64) * 64)
    if size > max_bits:
        raise ValueError(f"a level needs {size} bits, {max_bits} may be sent to each task")
    level = Level(keys, size, hashes, number)
    place = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("place"))
    words = place.select((F.col("place") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))").alias("bit"))
    filled = words.groupBy("at").agg(F.bit_or("bit").alias("word"))
    dense = keys.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("word")).union(filled)
    dense = dense.groupBy("at").agg(F.bit_or("word").alias("word"))
    row = dense.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("all")).select(F.col("all.word").alias("bits"))
    return Level(staged(row, "bloom") if written else row, size, hashes, number)


def build(universe: DataFrame, later_rate: float = 0.05, max_bits: int = 1 << 28, max_levels: int = 64) -> Cascade:
    """A cascade over `universe` (key, listed): distinct keys, `listed` boolean.

    The first level's rate balances the two sides. The sets shrink with every
    level by that level's rate, so there are few; each is a written table.
    """
    held = staged(universe.filter("key IS NOT NULL").select("key", "listed"), "universe")
    sizes = {r.listed: r.n for r in held.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = held.filter("listed"), held.filter("NOT listed")
    n_in, n_out = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level] = []
    rate = min(0.5, max(2.0**-20, n_in / max(n_out, 1) / 2))
    while n_in:
        if len(levels) == max_levels:
            raise RuntimeError("the universe holds a key twice, listed and not")
        levels.append(bloom_level(inside, n_in, rate, len(levels), max_bits))
        wrong = staged(outside.filter(levels[-1].holds(F.col("key"))), "passed")
        inside, outside, n_in, n_out, rate = wrong, inside, wrong.count(), n_in, later_rate
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host behind the first `://`, A-Z lower-cased; both empty for null or without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def universe_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed): every distinct key of both, marked where `listed` has it. No join."""
    both = keys.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True)))
    return both.groupBy("key").agg(F.max("listed").alias("listed"))


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of pages.

    `rules` are (verdict, rule) with rule like `example.net/en/`: they fit their
    host and its subdomains where the path starts with the rule's; the longest
    wins, at equal length the greater string, `block` before `allow` for the
    same rule. Other urls are blocked if their key (host and path) is in
    `listed` (key), else allowed. All membership is asked of cascades over the
    keys that these pages have. Null urls and those without `://` have empty
    parts; repeated rows repeat; an empty table gives no rows; further columns
    are not read.
    """
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = F.concat("host", "path")
    site = build(universe_of(rows.select(own.alias("key")), listed))

    shapes = sorted({(rule.split("/", 1)[0].count(".") + 1, len(rule) - rule.index("/")) for _, rule in rules})
    keys = [
        F.when(F.length("path") >= n, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, n)))
        for labels, n in shapes
    ]
    spark = pages.sparkSession
    asked = rows.select(F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL").distinct() if keys else rows.select(own.alias("key"))
    lists = {
        verdict: build(universe_of(asked, spark.createDataFrame([(r,) for v, r in rules if v == verdict], "key string")))
        for verdict in ("allow", "block")
    }
    fits = []
    for key in keys:
        verdict = F.when(lists["block"].listed(key), "block").when(lists["allow"].listed(key), "allow")
        fits.append(F.when(verdict.isNotNull(), F.struct(F.length(key).alias("size"), key.alias("rule"), verdict.alias("verdict"))))
    nothing = F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    best = F.greatest(nothing, *fits) if fits else nothing
    judged = rows.select("*", best.alias("best"), site.listed(own).alias("listed"))
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", other).alias("verdict"), "listed"
    )


def copied_pages(pages: DataFrame) -> DataFrame:
    """(key): the url keys whose html also stands under another key."""
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.filter("html IS NOT NULL").select(F.concat(host, path).alias("key"), F.sha2("html", 256).alias("html")).distinct()
    again = rows.groupBy("html").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("html")
    return rows.join(again, "html", "left_semi").select("key").distinct()
