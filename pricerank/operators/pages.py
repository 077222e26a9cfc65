"""Deep pages: global row numbers without a window in one task, and seeking past a token.

page() of rows.py sorts, and reads past all rows before the page. Here rows are numbered once for all pages, or a page is found by the last row of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.sources.scratch import stored

#: monotonically_increasing_id() has the row's place in its partition in the lower bits.
PLACE_BITS = 33


def number_rows(df: DataFrame, order_by: list[str], column: str = "number") -> DataFrame:
    """Adds the row's number, from 1, in the order of the columns (a leading - is descending; nulls come first ascending, last descending, as in orderBy).

    Rows are dealt by ranges of that order and sorted within them, which is written once; then the ranges' sizes, a row each, are summed up and joined back, so that only
    those pass through one task. The order should be total, else equal rows fall as they come. Rows of an empty table, or an order without columns, get no or any numbers.
    """
    order = [_sorted(c) for c in order_by]
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    kept = stored(dealt.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.shiftright(place, PLACE_BITS).alias("part"), place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")))
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("row.*", (F.col("before") + F.col("place") + 1).alias(column))


def _sorted(column: str) -> Column:
    return F.col(column[1:]).desc() if column.startswith("-") else F.col(column).asc()


def _after(order_by: list[str], token: Mapping[str, object], types: Mapping[str, object]) -> Column:
    """Whether a row comes after the token, column by column."""
    out = F.lit(False)
    for name in reversed(order_by):
        column, down = name.removeprefix("-"), name.startswith("-")
        value = F.lit(token[column]).cast(types[column])
        here = F.col(column)
        if token[column] is None:
            later = F.lit(False) if down else here.isNotNull()  # null comes first ascending, last descending
        else:
            later = (here < value) | here.isNull() if down else here > value
        out = F.coalesce(later, F.lit(False)) | (here.eqNullSafe(value) & out)
    return out


def seek(df: DataFrame, order_by: list[str], token: Mapping[str, object] | None = None, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the `size` rows that follow the token in a total order, the token of the next page: the order's columns of the last of them, no row if the page is empty).

    The token's condition reaches the scan, and each task keeps its first `size` rows, so a page far behind costs what the first one does."""
    names = [c.removeprefix("-") for c in order_by]
    rows = df if token is None else df.where(_after(order_by, token, {c: df.schema[c].dataType for c in names}))
    found = rows.orderBy(*[_sorted(c) for c in order_by]).limit(size)
    return found, found.orderBy(*[_sorted(c[1:] if c.startswith("-") else f"-{c}") for c in order_by]).limit(1).select(*names)


def page_at(numbered: DataFrame, number: int, size: int = 20, column: str = "number") -> DataFrame:
    """A page, from 1, of rows of number_rows()."""
    if number < 1 or size < 1:
        raise ValueError("pages start at 1 and hold a row at least")
    return numbered.where(F.col(column).between((number - 1) * size + 1, number * size))


def page_starts(numbered: DataFrame, order_by: list[str], size: int = 20, column: str = "number") -> DataFrame:
    """page and the order's columns of its first row: tokens to jump to any page."""
    first = numbered.where((F.col(column) - 1) % size == 0)
    return first.select((F.floor((F.col(column) - 1) / size) + 1).alias("page"), *[c.removeprefix("-") for c in order_by])
