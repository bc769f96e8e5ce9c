"""Text scalars with documented semantics; positions are from 0 where a caller gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def strip(text: Column) -> Column:
    """Without blanks, tabs and line breaks at either end."""
    return F.btrim(text, F.lit(BLANKS))


def title_case(text: Column) -> Column:
    """A capital after anything but a letter (A-Z)."""
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.initcap(x)), "")


def words(text: Column) -> Column:
    """Runs of anything but blanks; an empty text has none."""
    return F.filter(F.split(strip(text), r"[ \t\n\r]+"), lambda x: x != "")


def split_literal(text: Column, sep: str) -> Column:
    return F.split(text, f"\\Q{sep}\\E", -1)


def find(text: Column, needle: str) -> Column:
    """Place of the first occurrence, -1 without one."""
    return F.instr(text, needle) - 1


def occurrences(text: Column, needle: str) -> Column:
    """Places that do not overlap."""
    return F.regexp_count(text, F.lit(f"\\Q{needle}\\E"))


def truncate(text: Column, limit: int, keep: int | None = None) -> Column:
    """Texts above the limit end in an ellipsis after `keep` characters."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit if keep is None else keep), F.lit("...")))


def slug(text: Column) -> Column:
    return F.array_join(words(F.lower(F.translate(text, "!?", ""))), "-")


def initials(text: Column, department: Column) -> Column:
    part = lambda i: F.upper(F.substring(F.coalesce(F.get(words(text), F.lit(i)), F.lit("")), 1, 1))
    return F.concat(part(0), part(1), F.lit("-"), F.replace(F.upper(department), F.lit(" "), F.lit("_")))


def list_phrase(names: Column) -> Column:
    """Names as a phrase: none, one, two with and, more with commas and a last comma before and."""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(names, n - 1)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def query_string(parameters: Column) -> Column:
    """k=v joined by &, in key order."""
    pairs = F.array_sort(F.map_entries(parameters))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")


def extension(name: Column) -> Column:
    return F.element_at(split_literal(name, "."), -1)


def fixed(number: Column, digits: int) -> Column:
    """A number with so many decimals, always."""
    return F.format_string(f"%.{digits}f", number.cast("double"))


def thousands(number: Column, digits: int = 0) -> Column:
    """A number with commas between thousands and so many decimals."""
    return F.format_string(f"%,.{digits}f", number.cast("double"))


def email_parts(address: Column) -> tuple[Column, Column]:
    """What stands before and behind the last @; both null without one."""
    whole = address.rlike(r"^.+@.+\z")
    return F.when(whole, F.regexp_extract(address, "^(.*)@", 1)), F.when(whole, F.substring_index(address, "@", -1))


def minutes_of_day(clock: Column) -> Column:
    """Minutes from midnight of a time of day as H:mm; anything else is null."""
    ok = clock.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]\z")
    part = lambda i: F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("int")
    return F.when(ok, part(1) * 60 + part(2))


def clock_time(minutes: Column) -> Column:
    """Minutes from midnight as H:mm, hours without a leading zero."""
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
