"""Normalised criteria over the rows of one group."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _share(value: str, by: str, flip: bool) -> Column:
    over = Window.partitionBy(by)
    x, low, high = F.col(value), F.min(value).over(over), F.max(value).over(over)
    # decimals are subtracted as such, so that equal shares are equal doubles
    part, whole = ((high - x) if flip else (x - low)).cast("double"), (high - low).cast("double")
    return F.when(low == high, F.lit(1.0)).otherwise(part / F.nullif(whole, F.lit(0.0)))


def cost_score(value: str, by: str) -> Column:
    """(max - x) / (max - min) within the group; 1 where all are equal."""
    return _share(value, by, flip=True)


def benefit_score(value: str, by: str) -> Column:
    """(x - min) / (max - min) within the group; 1 where all are equal."""
    return _share(value, by, flip=False)
