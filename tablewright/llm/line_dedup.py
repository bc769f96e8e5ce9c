"""Line dedup over overlapping windows of three consecutive lines; DataFrame functions only.

Method. A document's lines that hold a word are trimmed and hashed; every three consecutive ones form a window
(lines without a word neither count nor part others). A window found in more than one place of the corpus
stays where it comes first, by (doc_id, line number); at every later place its three lines are covered. Covered
positions are merged and removed. A window may overlap the first place of its like: of `z z z z` the second window
covers lines two to four, so one `z` is left. Documents of fewer than three such lines have no window and stay whole.

Scale. Lines travel as hashes. Places of a window are summed before the shuffle; the join that finds later places
meets a stored table of repeated windows, so a window that a third of all documents hold is split. Only positions
travel back to the texts, and only documents that lose lines are rebuilt. Both joins are sort-merge joins at every
size: the tables that they meet grow with the corpus and are no candidates for a broadcast.

Cases. Null text stays null and loses nothing. Repeated rows (same doc_id and text) are one place, so they do not
remove each other's lines; all rows are returned. Null doc_ids come before all others; of places that tie in doc_id and
line, that of the text with the smaller hash is first. A long text's work grows with its lines, its memory with
its length. An empty table gives an empty result. Extra columns, whatever their names, are kept by `dedup_lines` and
left out of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BLANKS, boxed, materialize, text_key, unboxed
from tablewright.sources.scratch import discard

WINDOW = 3


def _lines(text: Column) -> Column:
    """All lines: trimmed, with their places from 0."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("l"), i.alias("at")))


def _windows(lines: Column) -> Column:
    """Two hashes and the three line places of each window over `lines` (struct of h, g, at)."""
    pick = lambda i, k: F.get(lines, i + k)
    return F.transform(
        F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(*(pick(i, k)["h"] for k in range(WINDOW))).alias("w1"),
            F.xxhash64(*(pick(i, k)["g"] for k in range(WINDOW))).alias("w2"),
            F.array(*(pick(i, k)["at"] for k in range(WINDOW))).alias("at"),
        ),
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, covered): the line places that each document loses, sorted; others are left out."""
    k1, k2 = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.filter(_lines(F.col("text")), lambda x: x["l"] != "").alias("lines"))
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x["l"]).alias("h"), F.xxhash64(F.lit(1), x["l"]).alias("g"), x["at"].alias("at")))
    rows = rows.where(F.size("lines") >= WINDOW).withColumn("lines", hashed)
    places = rows.select("doc_id", "k1", "k2", F.inline(_windows(F.col("lines"))))
    places = materialize(places, "lines-windows")
    n = places.count()
    place = F.struct(F.col("doc_id"), F.col("at")[0].alias("line"), F.col("k1"), F.col("k2"))
    groups = places.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(groups.where("first <> last").select("w1", "w2", "first"), "lines-repeated", n // 2)
    later = places.join(repeated.hint("merge"), ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("covered"))
    gone = materialize(gone, "lines-covered", n)
    discard(places, repeated)
    return gone


def _with_covered(docs: DataFrame) -> DataFrame:
    """`row`, all columns of `docs`, `covered`, the places to remove (null: none), and the `lines` of a text that loses some."""
    k1, k2 = text_key(F.col("text"))
    rows = boxed(docs, id=F.col("doc_id").cast("long"), t1=k1, t2=k2)
    same = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("id").eqNullSafe(F.col("doc_id"))
    rows = rows.join(covered_lines(docs).hint("merge"), same, "left").select("row", "covered")
    return rows.withColumn("lines", F.when(F.col("covered").isNotNull(), F.split(F.col("row")["text"], "\n", -1)))


def _left(text: Column) -> Column:
    """The text without the covered lines: places that are left, in order, then their lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")
    return F.when(F.col("covered").isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))


def _count(found: Column) -> Column:
    """Members of an array, 0 for null in any dialect."""
    return F.coalesce(F.when(found.isNotNull(), F.size(found)), F.lit(0)).cast("long")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages removed from `text`; all rows and columns stay."""
    rows = _with_covered(docs)
    return unboxed(rows.select(F.col("row"), _left(F.col("row")["text"]).alias("left")), docs, F.col("left"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """One row for each document: lines, lines removed, and the text that is left."""
    text = F.col("row")["text"]
    return _with_covered(docs.select("doc_id", "text")).select(
        F.col("row")["doc_id"].cast("long").alias("doc_id"),
        _count(F.split(text, "\n", -1)).alias("n_lines"),
        _count(F.col("covered")).alias("n_removed"),
        _left(text).alias("text"),
    )
