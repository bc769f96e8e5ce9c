"""Writers. A write replaces or adds to a folder; tables that are read are never overwritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, column: str = "value", append: bool = False) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def append_lines(rows: DataFrame, path: str, number: int, column: str = "value") -> None:
    """Lines added under a number of the caller's: an append that is run again replaces itself. Read `path/*`."""
    write_lines(rows, f"{path}/append-{number:06d}", column)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def pretty_array(rows: DataFrame, order: str, limit: int = 100_000) -> DataFrame:
    """All rows as one indented JSON array, sorted. For reports only: the array is one value, and more than `limit` rows fail."""
    many = F.raise_error(F.lit(f"more than {limit} rows for one JSON value; use write_json_lines")).cast("string")
    rows = rows.limit(limit + 1)
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_k"), F.struct(*rows.columns).alias("r")))), lambda x: x["r"])
    text = F.to_json(items, {"pretty": "true", "ignoreNullFields": "false"})
    return rows.agg(F.when(F.count("*") > limit, many).otherwise(text).alias("value"))


def write_store(rows: DataFrame, path: str, version: int = 2) -> None:
    """The pipe-delimited prompt store, quoted where needed, so that delimiters and line breaks survive."""
    tags = F.array_join("tags", ",").alias("tags")
    if version == 1:
        cells = rows.select("title", "category", "prompt", tags, F.when(F.col("favorite"), "True").otherwise("False").alias("favorite"))
    else:
        cells = rows.select("title", "prompt", "category", tags, F.when(F.col("favorite"), "1").otherwise("0").alias("favorite"))
    cells.write.mode("overwrite").csv(path, sep="|", header=version == 2, escape='"', emptyValue="")


def labelled_block(fields: dict[str, Column], width: int = 20) -> Column:
    """`Label: value` lines closed by a line of dashes."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()), F.lit("-" * width))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` rows replace those of `old` with the same key; write the result to another place, then swap."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def bill_summary(subtotal: Column, tip: Column, people: Column | None = None) -> Column:
    """Subtotal, tip and total, and what each of the people pays, a line each."""
    lines = {"Subtotal": subtotal, "Tip": tip, "Total": subtotal + tip} | ({} if people is None else {"Per person": F.try_divide(subtotal + tip, people)})
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v.cast("decimal(38,2)").cast("string")) for k, v in lines.items()))


def write_version(rows: DataFrame, path: str) -> int:
    """Write a new version of a stored table beside the others; it is current once its mark is written. Returns its number."""
    spark = rows.sparkSession
    number = max(_versions(spark, path), default=-1) + 1
    rows.write.mode("overwrite").parquet(f"{path}/version-{number:06d}")  # its _SUCCESS file is the mark
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current version of a stored table, or that of a number."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version-{max(known) if number is None else number:06d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose write has ended."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return [int(x.getPath().getParent().getName().rpartition("-")[2]) for x in found or []]
