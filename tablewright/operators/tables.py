"""Keyed edits, lookups, ranks, set algebra and positional operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.scratch import store


def toggle(rows: DataFrame, flag: str, chosen: Column) -> DataFrame:
    return rows.withColumn(flag, F.when(chosen, ~F.col(flag)).otherwise(F.col(flag)))


def partial_update(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-blank values of `edits` replace those of `rows`."""
    new = edits.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return rows.join(new, key, "left").select(
        *(F.coalesce(blank(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns)
    )


def delete_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def insert(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new)


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left lookup with a default for keys that the table lacks."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def join_ci(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str) -> DataFrame:
    """Equal keys whatever their case; of right rows with one key, the first by `order`."""
    k = F.lower(F.col(right_key))
    first = right.groupBy(k.alias("_k")).agg(F.min_by(F.struct(*right.columns), order).alias("_r")).select("_k", "_r.*")
    return left.join(first, F.lower(F.col(left_key)) == F.col("_k")).drop("_k")


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether each row's key is in a key table."""
    return rows.join(keys.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn(flag, F.col("_in").isNotNull()).drop("_in")


def numbered(rows: DataFrame, order: list[Column], name: str, partition: list[str] | None = None, start: int = 1) -> DataFrame:
    """Place of each row in an order, as the column `name`, which replaces one of that name. Ties get any places.

    Without a partition, places come from a range sort and per-block counts: a window without a partition would
    bring all rows to one task. Ranges are sampled anew whenever a plan is evaluated, so the dealt rows are stored once, and
    both the counts and the places come from what is stored. One count for each block meets on the driver.
    """
    if partition:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1 + start)
    spark = rows.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = store(dealt.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")
    block, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for number, size in sorted(dealt.groupBy(block.alias("block")).count().collect()):  # one row for each block
        before.append((number, total))
        total += size
    offsets = spark.createDataFrame(before, "block LONG, before LONG")
    placed = dealt.join(F.broadcast(offsets), block == F.col("block"))
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), (F.col("before") + nth + start).alias(name))


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows side by side by place, as many as the shorter has."""
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n").drop("_n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every row of `a` is in `b`."""
    return a.subtract(b).agg((F.count("*") == 0).alias("is_subset"))


def running_total(rows: DataFrame, value: str, partition: list[str], order: list[Column], name: str) -> DataFrame:
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(frame))


def last_n(rows: DataFrame, n: int, partition: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each partition in `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` as often as they are left when those of `b` are taken away one by one."""
    return a.exceptAll(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, as often as in the one that has fewer."""
    return a.intersectAll(b)


def low_stock(listed: DataFrame, stock: DataFrame, key: str, amount: str, limit: float) -> DataFrame:
    """The listed keys of which less than `limit` is in stock; keys that the stock lacks are left out."""
    return listed.select(key).distinct().join(stock.select(key, amount), key).where(F.col(amount) < limit)
