"""Merkle fingerprints of texts: blocks, paragraphs, sections, root. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.llm.ordering import id_bounds, range_number

BLOCK = 64


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes.

    Empty lines part sections, line ends paragraphs, and a paragraph's leaves
    are its blocks of 64 code points, so long paragraphs have a likeness too.
    """
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda b: F.substring(F.md5(b), 1, 8))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def fingerprint(branches: Column) -> Column:
    """`root;section|section`, a section `hash=paragraph/paragraph`, a paragraph `hash:leaf,leaf`.

    A paragraph's hash covers its leaves, a section's its paragraphs, the root
    its sections, so differing branches say where texts differ. Leaves are 32
    bits and all else covers only leaves: two texts that differ in one block
    have equal roots with a chance of 2^-32, so equal roots mean equal texts but for that.
    """
    paragraph = lambda p: F.concat(F.substring(F.md5(F.array_join(p, ",")), 1, 16), F.lit(":"), F.array_join(p, ","))
    section = lambda s: F.concat(F.substring(F.md5(s), 1, 16), F.lit("="), s)
    sections = F.transform(F.transform(branches, lambda s: F.array_join(F.transform(s, paragraph), "/")), section)
    body = F.array_join(sections, "|")
    return F.concat(F.md5(body), F.lit(";"), body)


def leaves_of(print_: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("(?<=[:,])[0-9a-f]{8}"), F.lit(0)))


def likeness(print_a: Column, print_b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else the Dice share of the leaves that both have."""
    both = F.array_size(F.array_intersect(leaves_a, leaves_b))
    share = 2.0 * both / F.greatest(F.array_size(leaves_a) + F.array_size(leaves_b), F.lit(1))
    return F.when(print_a == print_b, 1.0).otherwise(share)


def changed_paragraphs(print_a: Column, print_b: Column) -> Column:
    """(section, paragraph) numbers from 0 where two fingerprints differ, descending only into differing sections."""
    parts = lambda p: F.split(F.substring_index(p, ";", -1), "\\|")
    sections = F.transform(F.arrays_zip(parts(print_a).alias("a"), parts(print_b).alias("b")), lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b")))
    differing = F.filter(sections, lambda s: ~s["a"].eqNullSafe(s["b"]))
    inside = lambda s: F.filter(
        F.transform(
            F.arrays_zip(F.split(F.substring_index(s["a"], "=", -1), "/").alias("a"), F.split(F.substring_index(s["b"], "=", -1), "/").alias("b")),
            lambda p, j: F.struct(s["i"].alias("section"), j.alias("paragraph"), p["a"].eqNullSafe(p["b"]).alias("same")),
        ),
        lambda p: ~p["same"],
    )
    return F.transform(F.flatten(F.transform(differing, inside)), lambda p: F.struct(p["section"], p["paragraph"]))


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, print, leaves, next_*) with the next document by descending doc_id, the first behind the last.

    Ranges of doc_id are dealt out once; each also gets the greatest document
    of the range below, so that no row needs another range. Rows of one doc_id
    follow each other by text; null ids come last.
    """
    bounds = id_bounds(documents, ranges)
    top = documents.agg(F.max("doc_id").alias("top")).first().top
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = range_number(F.col("doc_id"), bounds)
    copy = lambda range_, guest, wrap: F.struct(range_.cast("int").alias("range"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
    places = [copy(own, False, False)]
    if bounds:
        places.append(F.when(F.col("doc_id").isin(bounds), copy(own + 1, True, False)))
    first = F.col("doc_id").eqNullSafe(F.lit(top))
    places.append(F.when(first, copy(F.lit(0), True, True)))
    dealt = rows.select("*", F.explode(F.array_compact(F.array(*places))).alias("at")).select("doc_id", "text", "at.*")
    dealt = dealt.repartition(max(len(bounds) + 1, ranges), "range")
    printed = dealt.withColumn("print", fingerprint(tree(F.col("text")))).withColumn("leaves", leaves_of(F.col("print")))
    order = W.partitionBy("range").orderBy("wrap", F.desc_nulls_last("doc_id"), "text")
    following = {f"next_{c}": F.lead(c).over(order) for c in ("text", "print", "leaves")}
    return printed.select("*", *[c.alias(name) for name, c in following.items()]).filter("NOT guest")


def edits(documents: DataFrame, ranges: int = 0) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed).

    The edited text has its last third replaced by the beginning of the next
    document. Null texts are empty. An empty table gives no rows, a single
    document is its own next one; rows of one doc_id follow each other by text;
    further columns are not read. `ranges` only sizes the work.
    """
    ranges = ranges or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(documents, ranges)
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_print", fingerprint(tree(F.col("edited")))).withColumn("edited_leaves", leaves_of(F.col("edited_print")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        changed_paragraphs(F.col("print"), F.col("edited_print")).alias("changed"),
    )
