"""A table of which an upsert rewrites only the partitions that it touches.

`path/data/version=N/part=P` holds partition P as version N wrote it, `path/manifest/version=N` a row (part, folder) for each partition of version N. A version is there once its manifest is
finished, so readers see all of one version and nothing of another, and an unfinished version is written again by whoever tries next. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricerank.operators.upsert import upsert
from pricerank.sources.scratch import delete, exists, file_system, finished

MANIFEST = "part string, folder string"


@dataclass(frozen=True)
class PartitionedTable:
    """path: folder that driver and executors share. part: SQL expression of a row's partition, of a bounded number of values (a month, a day, `pmod(xxhash64(id), 64)`); by_key: whether it
    is one of the key alone, so that an update can't move a row to another partition."""

    spark: SparkSession
    path: str
    schema: T.StructType
    part: str
    key: str = "id"
    by_key: bool = False

    def versions(self) -> list[int]:
        """Finished versions, in order."""
        folder = f"{self.path}/manifest"
        return sorted(v for v in (int(name.split("=")[1]) for name in self._names(folder)) if finished(self.spark, f"{folder}/version={v}"))

    def _names(self, folder: str) -> list[str]:
        if not exists(self.spark, folder):
            return []
        fs, hadoop = file_system(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(hadoop) if "=" in s.getPath().getName()]

    def manifest(self, version: int | None = None) -> dict[str | None, str]:
        """Partition -> folder, of a version or the last one; empty if there is none."""
        known = self.versions()
        chosen = (known[-1] if known else None) if version is None else version
        if chosen is None:
            return {}
        return {r.part: r.folder for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={chosen}").collect()}

    def read(self, version: int | None = None, parts: Iterable[str | None] | None = None) -> DataFrame:
        """The rows of a version (the last one), of all partitions or those named."""
        folders = self.manifest(version)
        wanted = folders if parts is None else {p: folders[p] for p in parts if p in folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in wanted.values()])

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """A version that holds these rows and no others."""
        return self._publish(rows, {}, self._next() if version is None else version)

    def upsert(self, updates: DataFrame, seq: str | None = None, version: int | None = None) -> int:
        """A version with the updates merged in, as upsert() does; only partitions that have a row of theirs before or after are read and written. A version that is finished stays as it is."""
        number = self._next() if version is None else version
        if number in self.versions():
            return number
        before = {v: self.manifest(v) for v in self.versions()[-1:]}
        folders = next(iter(before.values()), {})
        touched = updates.select(F.expr(self.part).cast("string").alias("part"))
        if not self.by_key and folders:
            # where rows of these keys stand now: a scan of the key and what the partition's expression needs
            base = self.read().select(F.col(self.key), F.expr(self.part).cast("string").alias("part"))
            touched = touched.union(base.join(updates.select(self.key), self.key, "left_semi").select("part"))
        parts = {r.part for r in touched.distinct().collect()}  # a bounded number, as there is a folder for each
        merged = upsert(self.read(parts=parts), updates, key=self.key, seq=seq)
        return self._publish(merged, {p: f for p, f in folders.items() if p not in parts}, number)

    def _next(self) -> int:
        return max(self.versions(), default=0) + 1

    def _publish(self, rows: DataFrame, others: dict, version: int) -> int:
        data = f"data/version={version}"
        # rebalance: a partition's rows go to few files, and those of a large one to several tasks
        placed = rows.select([f.name for f in self.schema]).withColumn("part", F.expr(self.part).cast("string")).hint("rebalance", "part")
        placed.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{data}")
        written = [(_value(name), f"{data}/{name}") for name in self._names(f"{self.path}/{data}")]
        listed = self.spark.createDataFrame([*others.items(), *written], MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return version

    def expire(self, keep: int = 2) -> None:
        """Deletes the manifests but the last `keep`, and folders that none of these name."""
        known = self.versions()
        used = {folder for v in known[-keep:] for folder in self.manifest(v).values()}
        for v in known[:-keep]:
            delete(self.spark, f"{self.path}/manifest/version={v}")
        for name in self._names(f"{self.path}/data"):
            if int(name.split("=")[1]) <= known[-1]:
                for part in self._names(f"{self.path}/data/{name}"):
                    if f"data/{name}/{part}" not in used:
                        delete(self.spark, f"{self.path}/data/{name}/{part}")


def _value(folder: str) -> str | None:
    """The partition's value out of a folder's name, in which Spark writes some characters as %XX."""
    from urllib.parse import unquote

    value = folder.split("=", 1)[1]
    return None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)
