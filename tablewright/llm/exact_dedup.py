"""Exact dedup by progressive refinement.

Method. Texts are equal if identical after lower-casing A-Z. Rows are grouped by length, those that share it by a hash of the
first `PREFIX` characters, those that share that too by SHA-256 of the whole text; a row that is alone at a step
leaves. Of equal texts the row with the largest doc_id stays. Length and prefix are made by Spark's own functions.

Scale. The steps move narrow rows, sum before their shuffles, and store the groups that go on, so a group that a third of all
rows share is split in the join. `drop_duplicate_texts` reads in full only rows that share length and prefix, dealt by
these two. `exact_duplicates` owes a SHA-256 for every row by its query's contract, so it reads all texts in full
once, in a scan without a shuffle of texts; a second read of the surviving groups would only repeat that. Which
rows are grouped by it is still decided by length and prefix.

Cases. Null text counts as empty. Of rows that repeat the largest doc_id of a group all have it as keep_id, and
`kept` is true for each. A null doc_id sorts below all others; in a group of only such rows each is kept. A long text is
hashed whole, a slice of its batch at a time. An empty table gives an empty result. Extra columns, whatever their
names, are ignored by `exact_duplicates` and kept by `drop_duplicate_texts`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, boxed, each_text, materialize, text_key, unboxed
from tablewright.sources.scratch import discard

PREFIX = 256


def _full_digest(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x).digest() for x in each_text(pc.ascii_lower(texts))], pa.binary())


def _digest(text: Column) -> Column:
    return F.arrow_udf(_full_digest, "binary").asNondeterministic()(text)  # evaluated once


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what the first two steps compare: bytes of the text, hash of its first characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).alias("size"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("prefix"),
    )


def _shared(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys that two rows or more have."""
    return materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), label)


def suspects(docs: DataFrame) -> DataFrame:
    """(size, prefix) that two rows or more share: length first, then, where it is shared, the prefix."""
    rows = materialize(_texts(docs).select("size", "prefix"), "exact-signatures")
    sizes = _shared(rows, ["size"], "exact-sizes")
    found = _shared(rows.join(sizes, "size", "left_semi"), ["size", "prefix"], "exact-prefixes")
    discard(rows, sizes)
    return found


def _groups(rows: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) of the texts that two of `rows` or more have."""
    found = rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return materialize(found.where("group_size > 1"), "exact-groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: the row that stays for its text, the group's size, and the text's SHA-256."""
    shared = suspects(docs)
    rows = _texts(docs).select("doc_id", "size", "prefix", _digest(F.col("text")).alias("sha"))
    rows = materialize(rows, "exact-digests")
    groups = _groups(rows.join(shared, ["size", "prefix"], "left_semi"))
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(groups, "sha", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicate_texts(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that another row stays for; only rows that share length and prefix are read in full."""
    k1, k2 = text_key(F.col("text"))  # a doc_id may stand for several texts
    read = _texts(docs).join(suspects(docs).hint("merge"), ["size", "prefix"], "left_semi")
    read = materialize(read.select("doc_id", k1.alias("k1"), k2.alias("k2"), _digest(F.col("text")).alias("sha")), "exact-survivors")
    lost = read.join(_groups(read), "sha").where("keep_id IS NOT NULL").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = materialize(lost.select(F.col("doc_id").alias("lost"), "k1", "k2").distinct(), "exact-lost")
    t1, t2 = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = boxed(docs, id=F.col("doc_id").cast("long"), t1=t1, t2=t2)
    same = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("id").eqNullSafe(F.col("lost"))
    return unboxed(rows.join(lost.hint("merge"), same, "left_anti"), docs)
