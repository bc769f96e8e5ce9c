"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (
    exact_dedup,
    license_scan,
    line_dedup,
    packing,
    piece_sampling,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    warc,
)
from tablewright.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def drop_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of operator 10 that reads in full only what shares length and prefix: the documents that stay."""
    return exact_dedup.drop_duplicate_texts(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_license_scan, op3_best_fit_packing, op4_warc_archive, op5_simhash_golay,
        op6_line_dedup, op7_sharding, op8_piece_sampling, op9_quality_classifier, op10_exact_dedup,
        drop_duplicate_documents,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), m AS (
  SELECT r, doc_id, host, text, words, lines, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines
  FROM w
), g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM m, unnest(range(1, greatest(1, n_words - 1))) t(i)
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g
), rep AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r
), l AS (
  SELECT r, host, text, array_to_string(regexp_extract_all({_LOWER.format("line")}, '[^\x20\x09-\x0D]+'), ' ') AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT r, host, text, unnest(lines) AS line FROM m)
), hosts AS (
  SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host
), frequent AS (
  SELECT l.host, line FROM l JOIN hosts USING (host) GROUP BY l.host, line, docs
  HAVING count(DISTINCT text) > {quality_rules.MIN_DOCS} AND count(DISTINCT text) > least(docs * {quality_rules.MAX_SHARE}::DOUBLE, {quality_rules.MAX_DOCS})
), lost AS (
  SELECT r, count(DISTINCT line)::BIGINT AS frequent_lines, sum(words)::BIGINT AS frequent_words
  FROM l JOIN frequent USING (host, line) GROUP BY r
), v AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    n_words - coalesce(frequent_words, 0) AS words_left
  FROM m LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND words_left >= n_words * {quality_rules.MIN_LEFT}::DOUBLE AS kept,
  coalesce(frequent_lines, 0)::BIGINT AS frequent_lines, coalesce(frequent_words, 0)::BIGINT AS frequent_words
FROM v
""",
    "op4_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html),
j AS (
  SELECT page_id, html, CASE WHEN strlen(html) >= {warc.MIN_REVISIT} AND keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
  FROM p JOIN k USING (html)
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j
""",
    "op6_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, text, k - 1 AS pos, trim(lines[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT r, doc_id, text, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) t(k)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos) AS nth FROM l WHERE line <> ''
), w AS (
  SELECT r, doc_id, text, pos AS a1, lead(pos, 1) OVER s AS a2, lead(pos, 2) OVER s AS a3,
    line || chr(10) || lead(line, 1) OVER s || chr(10) || lead(line, 2) OVER s AS win
  FROM n WINDOW s AS (PARTITION BY r ORDER BY nth)
), f AS (
  SELECT *, min({'d': coalesce(doc_id, -9223372036854775808), 'pos': a1, 't': text}) OVER (PARTITION BY win) AS first FROM w WHERE win IS NOT NULL
), c AS (
  SELECT r, list(DISTINCT pos) AS covered FROM (
    SELECT r, unnest([a1, a2, a3]) AS pos FROM f WHERE first <> {'d': coalesce(doc_id, -9223372036854775808), 'pos': a1, 't': text}
  ) GROUP BY r
)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(covered), 0)::BIGINT AS n_removed,
  CASE WHEN covered IS NULL THEN text
    ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(covered, i - 1)), chr(10)) END AS text
FROM d LEFT JOIN c USING (r)
""",
    "drop_duplicate_documents": f"""
SELECT * EXCLUDE (keep_id) FROM (SELECT *, max(doc_id) OVER (PARTITION BY {_LOWER.format("coalesce(text, '')")}) AS keep_id FROM documents)
WHERE doc_id IS NOT DISTINCT FROM keep_id OR keep_id IS NULL
""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM d JOIN g USING (text)
""",
}
