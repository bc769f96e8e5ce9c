"""Predicates and validators as Columns: never null, so that they combine as plain booleans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def equals_ci(column: str, value: object) -> Column:
    """Equal as text, whatever the case; null equals the text none."""
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("none"))) == F.lower(F.lit(str(value)))


def search_any(needle: str, texts: Iterable[str], tags: str | None = None) -> Column:
    """The trimmed needle stands, whatever the case, in a text or in a tag."""
    want = F.lit(needle.strip().lower())
    found = reduce(lambda a, b: a | b, (_sure(F.lower(F.col(x)).contains(want)) for x in texts), F.lit(False))
    return found if tags is None else found | _sure(F.exists(tags, lambda t: F.lower(t).contains(want)))


def truthy(value: Column, kind: str) -> Column:
    """What an `if` would take: not null, not zero, not empty."""
    empty = {"number": lambda c: c == 0, "string": lambda c: c == "", "array": lambda c: F.size(c) == 0, "boolean": lambda c: ~c}
    return _sure(~empty[kind](value))


def at_least(column: str, limit: float):
    """A predicate with its limit inside."""
    return _sure(F.col(column) >= limit)


def in_range(column: str, low: float, high: float) -> Column:
    return _sure(F.col(column).between(low, high))


def max_length(column: str, limit: int) -> Column:
    return _sure(F.length(F.col(column).cast("string")) <= limit)


def required(*columns: str) -> Column:
    return validate(F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns)


def one_of(column: str, *values: object) -> Column:
    return _sure(F.col(column).isin(*values))


def email_like(value: Column) -> Column:
    return _sure(value.contains("@"))


def username_like(value: Column) -> Column:
    return _sure((F.length(value) >= 3) & value.rlike(r"^[A-Za-z0-9]+\z"))


def password_like(value: Column) -> Column:
    """Eight characters or more."""
    return _sure(F.length(value) >= 8)


def positive_number(text: Column) -> Column:
    """The number that a text holds if it is above zero, else null."""
    number = F.when(text.rlike(r"^[ ]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[ ]*\z"), text).try_cast("double")
    return F.when(number > 0, number)


def validate(checks: Iterable[Column]) -> Column:
    """All checks hold; without checks, true."""
    return reduce(and_, map(_sure, checks), F.lit(True))


def split_valid(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    return rows.where(ok), rows.where(~ok)


def report(rows: DataFrame, ok: Column) -> DataFrame:
    """total, passed and failed in one pass."""
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def checked(value: Column, ok: Column, message: str) -> Column:
    """`value`, or a failed query where the check does not hold."""
    return F.when(_sure(ok), value).otherwise(F.raise_error(F.lit(message)))


def typed(rows: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """Rows as records of a schema given as DDL: its fields alone, in its order, with its types.

    A missing column is null. A value that is not of its type fails the query (strict) or is null; NOT NULL fields
    that are null fail the query in either form.
    """
    out = []
    for field in StructType.fromDDL(schema).fields:
        raw = F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None)
        value = raw.try_cast(field.dataType)
        if strict:
            value = F.when(raw.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{field.name} is not {field.dataType.simpleString()}: "), raw.cast("string"))).cast(field.dataType)).otherwise(value)
        if not field.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{field.name} is required")).cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return rows.select(*out)
