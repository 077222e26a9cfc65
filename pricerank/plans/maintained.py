"""The latest prices as a table that batches of changes maintain, so that no query windows the whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricerank.plans.prices import latest_prices

KEY = ["producto_fuente_id", "sucursal_id"]


def maintained_latest(latest: DataFrame, prices: DataFrame, changed: DataFrame) -> DataFrame:
    """latest_prices(prices) out of `latest`, which held before some rows were written, and `changed`, the ids of these (new rows, corrections; in prices as they are now).

    A key whose newest row isn't among the changed ones keeps it, or takes a newer one of those. Only for a key whose newest row was itself corrected (to another time, or away to another key) the
    history is read again. Ids must be whole and distinct in prices; prices are never deleted, rows are told unavailable instead."""
    columns, whole = latest.columns, " AND ".join(f"{k} IS NOT NULL" for k in KEY)
    ids = changed.select("id").where("id IS NOT NULL").distinct()
    rows = prices.join(ids, "id", "left_semi").select(*columns)
    lost = latest.where(whole).join(ids, "id", "left_semi").select(*KEY)
    # one dealing by key: what was the latest, what changed, and a mark for each key whose history is read again
    mark = lost.select(*[F.col(c) if c in KEY else F.lit(None).cast(latest.schema[c].dataType).alias(c) for c in columns], F.lit(True).alias("_lost"))
    met = latest.unionByName(rows).where(whole).withColumn("_lost", F.lit(False)).unionByName(mark)
    newest = latest_prices(met.withColumn("_lost", F.max("_lost").over(Window.partitionBy(*KEY)))).where("NOT _lost").drop("_lost")
    again = latest_prices(prices.where(whole).join(lost, KEY, "left_semi"))
    # no join finds keys with a null part, so their history is read whole
    unkeyed = latest_prices(prices.where(f"NOT ({whole})"))
    return newest.unionByName(again.select(*columns)).unionByName(unkeyed.select(*columns))
