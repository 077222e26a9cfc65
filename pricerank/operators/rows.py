"""Row selection: keys, parents, optional filters, name search, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricerank.functions.text import collated, contains, strip


def lookup(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in `keys` (a column of the same name). Null keys find nothing."""
    return df.join(keys.select(key), key, "left_semi")


def get_by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def restrict(df: DataFrame, column: str, keys: DataFrame | list | None) -> DataFrame:
    """None: no filter. A list or one-column table: rows whose column is in it, so an empty one leaves none."""
    if keys is None:
        return df
    if isinstance(keys, list):
        return df.where(F.col(column).isin(keys)) if keys else df.where(F.lit(False))
    return df.join(keys.toDF(column), column, "left_semi")


def active(df: DataFrame) -> DataFrame:
    return df.where("activo")


def where_given(df: DataFrame, **equal) -> DataFrame:
    """ANDs column = value for every value that is not None."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def matching(df: DataFrame, column: str, query: str | None) -> DataFrame:
    """Case-insensitive contains; a blank query filters nothing. The query is stripped and holds 120 characters at most."""
    if query is not None and len(query) > 120:
        raise ValueError("a query holds 120 characters at most")
    stripped = (query or "").strip()
    return df.where(contains(F.col(column), stripped)) if stripped else df


def search_by_name(df: DataFrame, query: str, limit: int = 20, column: str = "nombre_normalizado", collation: str | None = None) -> DataFrame:
    """Case-insensitive contains, inactive rows too, the first `limit` by name (then id); names by code points, or by a collation."""
    return df.where(contains(F.col(column), query)).orderBy(collated(column, collation), column, "id").limit(limit)


def find_by_key(df: DataFrame, **key) -> DataFrame:
    """Rows with exactly this natural key, case-sensitive."""
    return where_given(df, **key)


def children(df: DataFrame, foreign_key: str, value, order: str = "nombre", collation: str | None = None) -> DataFrame:
    """Rows of a parent, active or not, by name (then id)."""
    return df.where(F.col(foreign_key) == F.lit(value)).orderBy(collated(order, collation), order, "id")


def listing(df: DataFrame, limit: int | None = None, offset: int = 0, order: str = "nombre", collation: str | None = None) -> DataFrame:
    """All rows by name (then id), or a slice of them; names by code points, or by a collation and then by code points."""
    ordered = df.orderBy(collated(order, collation), order, "id")
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def page(df: DataFrame, order_by: list[Column | str], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    """A page and the total. order_by must be a total order for pages that fit together."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 rows")
    return df.orderBy(*order_by).offset((number - 1) * size).limit(size), df.count()


def stripped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in columns})
