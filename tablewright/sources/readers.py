"""Readers. Every schema is explicit; nothing is inferred and no input is collected."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r"

STORE_SCHEMA = "title STRING, category STRING, prompt STRING, tags ARRAY<STRING>, favorite BOOLEAN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file."""
    return spark.read.text(path, wholetext=True)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed row for each line."""
    return spark.read.text(path).select(F.btrim("value", F.lit(BLANKS)).alias("value"))


def setting_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Trimmed lines but for blank ones and comments."""
    return text_lines(spark, path).where((F.col("value") != "") & ~F.startswith(F.col("value"), F.lit(comment)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the file, from 0; a DataFrame itself has no order."""
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)
    return whole_text(spark, path).select(F.posexplode(lines).alias("line_no", "value"))


def csv_records(spark: SparkSession, path: str, schema: str, header: bool = True, strict: bool = False) -> DataFrame:
    """Trimmed, typed records. Strict: a malformed row fails the read; else its bad fields are null."""
    return spark.read.csv(
        path, schema=schema, header=header, mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=True,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def csv_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records of a file without a header, and the raw text of the others."""
    full = f"{schema}, _corrupt STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    rows = text_lines(spark, path).where("value <> ''").select(F.from_csv("value", full, options).alias("r")).select("r.*")
    return rows.where("_corrupt IS NULL").drop("_corrupt"), rows.where("_corrupt IS NOT NULL").select("_corrupt")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON objects; a missing or unreadable file gives an empty table of the schema."""
    try:
        rows = spark.read.json(path, schema=schema, multiLine=True, mode="DROPMALFORMED")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows


def json_keyed(spark: SparkSession, path: str, value_schema: str, key: str = "tx_id") -> DataFrame:
    """An object of records by key, as rows with the key as a column."""
    rows = whole_text(spark, path).select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{value_schema}>>")).alias(key, "r"))
    return rows.select(key, "r.*")


def _flag(text: Column) -> Column:
    return F.lower(F.btrim(text)).isin("true", "1", "yes")


def _tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.btrim(x)), lambda x: x != "")


def prompt_store(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """The pipe-delimited store. Version 1: no header, title|category|prompt; version 2: header, title|prompt|category.

    A missing file is an empty store.
    """
    if version not in (1, 2):
        raise ValueError("the store has versions 1 and 2")
    names = ["title", "category", "prompt"] if version == 1 else ["title", "prompt", "category"]
    schema = ", ".join(f"{x} STRING" for x in [*names, "tags", "favorite"])
    try:
        rows = spark.read.csv(path, schema=schema, sep="|", header=version == 2, mode="DROPMALFORMED", escape='"', multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_SCHEMA)
    tags = F.coalesce(_tags(F.col("tags")), F.array().cast("array<string>"))
    return rows.select("title", "category", "prompt", tags.alias("tags"), F.coalesce(_flag(F.col("favorite")), F.lit(False)).alias("favorite"))


def delimited_lines(lines: DataFrame, column: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text in a column, as typed columns; fields that do not parse are null."""
    fields = T.StructType.fromDDL(schema).fields
    parts = F.split(F.col(column), f"\\Q{sep}\\E", -1)
    cell = lambda i, f: _flag(F.get(parts, i)) if f.dataType == T.BooleanType() else F.btrim(F.get(parts, i)).try_cast(f.dataType)
    return lines.select(*(cell(F.lit(i), f).alias(f.name) for i, f in enumerate(fields)))


def number_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end)
