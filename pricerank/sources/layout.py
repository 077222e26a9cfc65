"""Stored layouts that save work later: prices in buckets for ranking, sorted files with Bloom filters for lookups of a few keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricerank.sources.scratch import new_path

#: Keys that a lookup hands to the scan as conditions at most (Spark passes on lists of up to ten each); more are joined.
KEYS_AS_CONDITIONS, KEYS_OF_A_CONDITION = 200, 10


def save_bucketed(prices: DataFrame, listings: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """The prices with their listing's producto_id as the table `name`, in buckets by (producto_id, sucursal_id), each sorted by them. branch_product_prices() and all that rests on it take such a
    table as `precio` and deal none of its rows anew. Prices without a listing are left out, as they have no product. path is a folder that all executors share; by default one is made."""
    spark = prices.sparkSession
    rows = prices.join(listings.select(F.col("id").alias("producto_fuente_id"), "producto_id"), "producto_fuente_id").select(*prices.columns, "producto_id")
    keys = ["producto_id", "sucursal_id"]
    dealt = rows.repartition(buckets, *keys)  # so that each bucket is one file
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path or new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def save_for_lookups(df: DataFrame, path: str, keys: list[str], distinct: int = 1_000_000, group_bytes: int = 16 << 20) -> None:
    """Parquet sorted by the first key over all files, in row groups of about group_bytes, with a Bloom filter of each key for `distinct` values a row group: a scan for some keys skips the groups that can't hold
    them, by least and greatest value for the first key, by Bloom filter for all."""
    writer = df.repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct)
    writer.parquet(path)


def lookup_few(df: DataFrame, values: list, key: str = "id") -> DataFrame:
    """Rows whose key is one of the values; up to KEYS_AS_CONDITIONS of them reach the scan, and so the row groups' statistics and Bloom filters. Nulls find nothing, no values no rows."""
    wanted = sorted({v for v in values if v is not None})
    if not wanted:
        return df.where(F.lit(False))
    if len(wanted) > KEYS_AS_CONDITIONS:
        listed = df.sparkSession.createDataFrame([(v,) for v in wanted], f"{key} {df.schema[key].dataType.simpleString()}")
        return df.join(listed, key, "left_semi").select(*df.columns)
    parts = [wanted[at : at + KEYS_OF_A_CONDITION] for at in range(0, len(wanted), KEYS_OF_A_CONDITION)]
    return df.where(reduce(lambda a, b: a | b, [F.col(key).isin(part) for part in parts]))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
