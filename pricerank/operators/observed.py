"""Checks and counts in the pass that writes, by observed metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from pricerank.operators.quality import rules_of
from pricerank.operators.upsert import stable_id


def observed_write(df: DataFrame, table: str, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Writes the rows of a table and returns rows, and the number of rows that break each of its row rules, which row_violations() would list in a pass of its own."""
    rules = rules_of(df, table)
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    counts = [F.count_if(broken).alias(name) for name, broken in rules.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode(mode).parquet(path)
    return {name: n for name, n in seen.get.items() if n or name == "rows"}


def observed_get_or_create(base: DataFrame, new: DataFrame, natural_key: tuple[str, ...], path: str, seq: str | None = None) -> dict[str, int]:
    """get_or_create(), written to a path, with its report (created, found) from the same pass: each new row is told created or found along one chain of a window and a join."""
    rows = new if "id" in new.columns else new.withColumn("id", stable_id(*natural_key))
    whole = " AND ".join(f"{k} IS NOT NULL" for k in natural_key)
    # rows without a whole key are all created, so they are dealt by their id
    spread = F.when(~F.expr(whole), F.col("id"))
    first = Window.partitionBy(*natural_key, spread).orderBy(F.col(seq) if seq else F.col("id"), F.struct(*rows.columns))
    held = base.select(*[F.col(k).alias(f"_{k}") for k in natural_key]).distinct().withColumn("_held", F.lit(True))
    told = rows.withColumn("_n", F.when(F.expr(whole), F.row_number().over(first)).otherwise(1))
    for k in natural_key:
        held = held.where(F.col(f"_{k}").isNotNull())
    equal = [told[k] == held[f"_{k}"] for k in natural_key]
    marked = told.join(held, equal, "left").withColumn("_created", (F.col("_n") == 1) & F.col("_held").isNull())
    seen = Observation(f"load-{uuid.uuid4().hex}")
    fresh = marked.observe(seen, F.count_if("_created").alias("created"), F.count_if(~F.col("_created")).alias("found")).where("_created").select(*base.columns)
    base.unionByName(fresh).write.parquet(path)
    return {"created": seen.get["created"], "found": seen.get["found"]}
