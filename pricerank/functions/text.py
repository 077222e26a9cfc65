"""Text of numbers, times and search patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at either end, the separators U+001C to U+001F included; trim() removes plain spaces only."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def ilike_pattern(query: str) -> str:
    """%query% with the backslashes that escape nothing taken out; % and _ stay wildcards."""
    pattern, out, at = f"%{query}%", [], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2] if pattern[at + 1 : at + 2] in ("%", "_", "\\") else pattern[at + 1 : at + 2])
            at += 2
        else:
            out.append(pattern[at])
            at += 1
    return "".join(out)


def contains(text: Column, query: str) -> Column:
    return text.ilike(ilike_pattern(query))


def collated(column: str | Column, collation: str | None = None) -> Column:
    """The column to order or compare by: as it is (by code points), or by one of Spark's collations (UNICODE, UNICODE_CI, UNICODE_CI_AI, UTF8_LCASE, es, ...)."""
    text = F.col(column) if isinstance(column, str) else column
    return text if collation is None else F.collate(text, collation)


def fixed(value: Column, places: int) -> Column:
    """Decimal text with so many places, halves to the even digit; null stays null."""
    return F.bround(value, places).cast(f"decimal(38,{places})").cast("string")


def fixed_double(value: Column, places: int) -> Column:
    """fixed() of a double: what is a half is told after the point has been moved, so that 0.23625000000000002, which moved by four digits is 2362.5, counts as one, as it does in SQL."""
    return (F.rint(value * 10.0**places) / 10.0**places).cast(f"decimal(38,{places})").cast("string")


def plain(value: Column) -> Column:
    """Decimal text at the value's own scale."""
    return value.cast("string")


def iso_time(time: Column) -> Column:
    """ISO 8601 with offset; microseconds only if there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_format(time, "SSSSSS") == "000000", whole).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def external_code(prefix: Column, suffix: Column) -> Column:
    return F.concat_ws("-", prefix, suffix)
