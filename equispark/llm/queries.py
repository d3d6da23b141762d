"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from equispark.llm import binary_tokens, decontamination, fingerprints, language, licenses, neardup, negatives, packing, pii, quality, repeats, url_filter, whitening
from equispark.llm.staging import scratch_path
from equispark.llm.tokens import vocabulary


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list of the method: url keys whose html also stands under another key."""
    pages = table(spark, folder, "pages")
    return url_filter.filtered(pages, URL_RULES, url_filter.copied_pages(pages))


BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_scan(table(spark, folder, "documents"), BASE_PHRASES)
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Documents carry no url: their source is the host, its part in one language the path."""
    documents = table(spark, folder, "documents")
    evidence = quality.fit(documents, table(spark, folder, "labels"))
    return quality.classify(documents, evidence, F.col("source"), F.col("lang"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.array_size("items").cast("long").alias("n_items"),
        decontamination.items_digest(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edits(table(spark, folder, "documents")).drop("changed")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op8_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    binary_tokens.write_tokens(table(spark, folder, "documents"), path, vocabulary())
    read = binary_tokens.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.array_size(base) - F.array_size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.as_text(base), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans")
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary())
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Deviations as longs, null where a long does not hold one."""
    found = whitening.whitened(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))


def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_licenses, op3_quality, op4_language, op5_decontamination, op6_fingerprints, op7_near_duplicates, op8_token_ids, op9_personal_data, op10_packing, op11_whitening, op12_hard_negatives, op13_repeats)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TREE = (
    "list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), "
    "lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,64}}'), lambda b: substr(md5(b), 1, 8))))"
)
_BODY = (
    "array_to_string(list_transform({0}, lambda s: substr(md5({1}), 1, 16) || '=' || {1}), '|')".replace(
        "{1}", "array_to_string(list_transform(s, lambda p: substr(md5(array_to_string(p, ',')), 1, 16) || ':' || array_to_string(p, ',')), '/')"
    )
)
_LIKE = (
    "CASE WHEN {0} = {1} THEN 1.0 ELSE 2.0 * len(list_intersect({2}, {3})) / greatest(len({2}) + len({3}), 1) END"
)

QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {
    "op1_url_filter": """
        WITH rest AS (
                 SELECT *, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
             p AS (
                 SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
             copied AS (SELECT html FROM p WHERE html IS NOT NULL GROUP BY html HAVING count(DISTINCT host || path) > 1),
             listed AS (SELECT DISTINCT host || path AS key FROM p WHERE html IN (SELECT html FROM copied)),
             ruled AS (
                 SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
                        host || path IN (SELECT key FROM listed) AS listed FROM p)
        SELECT page_id, host, path, rule, listed,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN listed THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op6_fingerprints": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             n AS (
                 SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
                 FROM d WINDOW w AS (ORDER BY doc_id DESC, text)),
             e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM n),
             t AS (SELECT *, {_TREE.format("text")} AS tree, {_TREE.format("edited")} AS edited_tree, {_TREE.format("next_text")} AS next_tree FROM e),
             b AS (
                 SELECT *, {_BODY.format("tree")} AS body, {_BODY.format("edited_tree")} AS edited_body, {_BODY.format("next_tree")} AS next_body,
                        list_distinct(flatten(flatten(tree))) AS l, list_distinct(flatten(flatten(edited_tree))) AS el,
                        list_distinct(flatten(flatten(next_tree))) AS nl FROM t)
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, md5(body) || ';' || body AS fingerprint,
               md5(edited_body) || ';' || edited_body AS edited_fingerprint,
               {_LIKE.format("body", "edited_body", "l", "el")} AS near_edited, {_LIKE.format("body", "next_body", "l", "nl")} AS near_next
        FROM b""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
             windows AS (
                 SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT size FROM windows),
             places AS (
                 SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
                 FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
             hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.words = p.words),
             hit_words AS (
                 SELECT doc_id, count(DISTINCT word) AS n_hit
                 FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id),
             found AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
               sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
