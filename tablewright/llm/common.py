"""What the corpus operators share: reading tables, text classes, written intermediate tables."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.scratch import store

T = TypeVar("T")

#: Narrow rows that one task writes, where a table's size is known.
ROWS_A_TASK = 250_000

#: ASCII blanks; words of the quality and near-duplicate operators are runs of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that outlives lost executors, and makes the reader a plain scan, so that a join
    above it gets its own exchange, whose skewed partitions adaptive execution can split.

    `rows` is how many narrow rows to expect at most: a table that is small for the shuffle's partitions is dealt
    to fewer tasks before it is written, instead of as very many tiny files. The work that makes the rows
    keeps all its tasks, and no result changes.
    """
    spark = df.sparkSession
    if rows is not None and (tasks := rows // ROWS_A_TASK + 2) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(tasks)
    return store(df, label)


_cached: dict = {}


def worker_cache(key: object = None, make: Callable[[], T] | None = None) -> T | None:
    """What a Python worker keeps between tasks, one thing at a time: asking for another frees the last."""
    if key not in _cached:
        _cached.clear()
        if make is not None:
            _cached[key] = make()
    return _cached.get(key)


def each_text(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The texts of an Arrow column as bytes; only a slice of the batch is held as Python objects."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).cast(pa.binary()).to_pylist()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two XXH64 values with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """`row`, all columns of `docs` as one struct, and `keys` beside it: no name of a user's column can clash with them."""
    columns = (F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)
    return docs.select(F.struct(*columns).alias("row"), *(v.alias(k) for k, v in keys.items()))


def unboxed(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of `docs` again; with `text`, that is the new text, and `n_chars` is counted anew if there is such a column."""
    if text is None:
        return rows.select("row.*")
    new = F.col("row").withField("text", text)
    rows = rows.select(new.alias("row"))
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("row").withField("n_chars", F.length(F.col("row")["text"]).cast(docs.schema["n_chars"].dataType)).alias("row"))
    return rows.select("row.*")
