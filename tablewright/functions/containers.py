"""Sets, lists and maps in a column; positions are from 0, negative ones from the end. Null containers give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def added(items: Column, value: Column) -> Column:
    """The set with `value` in it; a set that has it stays as it is."""
    return F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value))


def discarded(items: Column, value: Column) -> Column:
    """The set without `value`, whether or not it had it."""
    return F.array_remove(items, value)


def removed(items: Column, value: Column) -> Column:
    """The set without `value`; the query fails where the set lacks it."""
    lacks = F.raise_error(F.concat(F.lit("no such member: "), value.cast("string")))
    return F.when(F.array_contains(items, value), F.array_remove(items, value)).otherwise(F.when(items.isNotNull(), lacks).cast("array<string>"))


def inserted(items: Column, at: int, value: Column) -> Column:
    """`value` before position `at`; beyond either end it goes to that end."""
    n = F.size(items)
    place = F.least(F.lit(at), n) if at >= 0 else F.greatest(n + at, F.lit(0))
    return F.concat(F.slice(items, 1, place), F.array(value), F.slice(items, place + 1, n))


def without_first(items: Column, value: Column) -> Column:
    """The list without the first member that equals `value`."""
    at = F.array_position(items, value)
    return F.when(at == 0, items).otherwise(F.filter(items, lambda x, i: i != at - 1))


def popped(items: Column, at: int = -1) -> tuple[Column, Column]:
    """The member at a position and the list without it; beyond the ends: null and the whole list."""
    n = F.size(items)
    place = F.lit(at) if at >= 0 else n + at
    return F.get(items, place), F.filter(items, lambda x, i: i != place)


def popped_key(entries: Column, key: str, default: Column | None = None) -> tuple[Column, Column]:
    """The value of a key, or the default, and the map without the key."""
    value = F.try_element_at(entries, F.lit(key))
    return value if default is None else F.coalesce(value, default), F.map_filter(entries, lambda k, v: k != key)


def merged(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, the right one's value stays."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def map_first(pairs: Column) -> Column:
    """A map of (key, value) structs; of equal keys the first stays."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1))


def kind(value: Column) -> Column:
    """int, float, str, bool, list, dict, date or none: what a value is, by its column's type."""
    name = F.typeof(value)
    found = F.when(name.isin("tinyint", "smallint", "int", "bigint"), "int").when(name.isin("float", "double") | name.startswith("decimal"), "float")
    found = found.when(name == "string", "str").when(name == "boolean", "bool").when(name.startswith("array"), "list")
    found = found.when(name.startswith("map") | name.startswith("struct"), "dict").when(name.startswith("timestamp") | (name == "date"), "date")
    return F.when(value.isNull(), "none").otherwise(found)
