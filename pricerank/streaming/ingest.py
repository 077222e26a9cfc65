"""Price rows from a stream into price tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricerank.operators.upsert import ingest_rows, upsert
from pricerank.sources.partitioned import PartitionedTable
from pricerank.sources.scratch import finished
from pricerank.sources.tables import with_defaults


def upsert_stream(updates: DataFrame, current: Callable[[], DataFrame], snapshot_path: Callable[[int], str], checkpoint: str, seq: str = "seq", table: str = "precio", tables: Callable[[], Mapping[str, DataFrame]] | None = None, rejected_path: Callable[[int], str] | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch is upserted into current() and written as the snapshot of its number, which is a whole table; current() must not read that snapshot. With tables (the others that rows refer to), a batch goes through
    the checks of ingest_rows() first, and what they reject is written to rejected_path. A batch that is run again after a failure does nothing if its snapshot was finished, and else
    replaces what is there of it. stream_into() writes only what changes."""

    def write(batch: DataFrame, number: int) -> None:
        path, base, spark = snapshot_path(number), current(), batch.sparkSession
        if finished(spark, path):
            return
        if tables is None:
            upsert(base, with_defaults(batch, table), seq=seq).write.mode("overwrite").parquet(path)
            return
        new, reasons = ingest_rows({**tables(), table: base}, table, batch, seq)
        if rejected_path is not None and not finished(spark, rejected_path(number)):
            reasons.write.mode("overwrite").parquet(rejected_path(number))
        new.write.mode("overwrite").parquet(path)

    return _started(updates, write, checkpoint, trigger)


def stream_into(target: PartitionedTable, updates: DataFrame, checkpoint: str, seq: str = "seq", table: str = "precio", **trigger) -> StreamingQuery:
    """Each micro-batch is a version of the target, in which only the partitions of its rows are written. The versions continue those that the target had when the stream
    first started, which is one version, written before; a batch that is run again finds its version finished, or writes it anew."""
    return _started(updates, lambda batch, number: target.upsert(with_defaults(batch, table), seq=seq, version=number + 2), checkpoint, trigger)


def _started(updates: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_listings(prices: DataFrame, listings: DataFrame, known: DataFrame, wait: str = "1 hour", time: str = "received_at") -> DataFrame:
    """The stream of prices with the column known_listing: true for those whose listing is in the table `known`, or comes in the stream `listings` up to `wait` before or after them; false for the others, orphans,
    which come out once the watermark says that no such listing can come any more.

    Both streams have an event time (`time`), after which rows may be up to `wait` late; later ones are dropped by the watermark. State holds what is younger than
    that and no more. A price whose listing comes several times comes out as often; prices without a listing id are orphans at once."""
    here = prices.join(known.select(F.col("id").alias("_known")).distinct(), F.col("producto_fuente_id") == F.col("_known"), "left")
    there = F.col("_known").isNotNull() | F.col("producto_fuente_id").isNull()
    settled = here.where(there).withColumn("known_listing", F.col("_known").isNotNull()).drop("_known")
    waiting = here.where(~there).drop("_known").withWatermark(time, wait)
    coming = listings.select(F.col("id").alias("_listing"), F.col(time).alias("_at")).withWatermark("_at", wait)
    within = F.expr(f"producto_fuente_id = _listing AND _at BETWEEN {time} - INTERVAL {wait} AND {time} + INTERVAL {wait}")
    joined = waiting.join(coming, within, "left_outer")
    return settled.unionByName(joined.withColumn("known_listing", F.col("_listing").isNotNull()).drop("_listing", "_at"))


def ingest_waiting(prices: DataFrame, listings: DataFrame, known: DataFrame, target: PartitionedTable, rejected_path: str, checkpoint: str, wait: str = "1 hour", time: str = "received_at", seq: str = "seq", **trigger) -> StreamingQuery:
    """Prices of with_listings() into the target; orphans as (table, row_key, rule) to a folder for each batch under rejected_path, as ingest() reports them."""

    def write(batch: DataFrame, number: int) -> None:
        columns = [*target.schema.names, seq]
        target.upsert(with_defaults(batch.where("known_listing").drop("known_listing"), "precio").select(*columns).distinct(), seq=seq, version=number + 2)
        orphans = batch.where("NOT known_listing").select(F.lit("precio").alias("table"), F.col("id").cast("string").alias("row_key"), F.lit("reference:producto_fuente_id").alias("rule"))
        orphans.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return _started(with_listings(prices, listings, known, wait, time), write, checkpoint, trigger)
