"""How often rows are dealt by what writes and maintains tables."""

from datetime import datetime

from pyspark.sql import functions as F

from pricerank.operators import upsert
from pricerank.plans.maintained import maintained_latest
from pricerank.plans.prices import latest_prices

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def under(spark, conf, f):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return f()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def price_rows(spark, n, listing):
    id = F.col("id").cast("string")
    now = F.lit(datetime(2024, 1, 1))
    return spark.range(n).select(id.alias("id"), listing.alias("producto_fuente_id"), F.lit("b").alias("sucursal_id"), F.lit(1).cast("decimal(14,2)").alias("precio"), F.lit("ARS").alias("moneda"), now.alias("fecha_relevamiento"), F.lit(True).alias("disponible"), F.lit(False).alias("promocion"), now.alias("created_at"))


def survey(spark, tmp_path):
    """Tables as files, so that Spark doesn't work on them while it plans."""
    price_rows(spark, 2000, F.col("id").cast("string")).write.parquet(f"{tmp_path}/precio")
    spark.range(2000).select(F.col("id").cast("string").alias("id")).write.parquet(f"{tmp_path}/producto_fuente")
    spark.createDataFrame([("b",)], "id string").write.parquet(f"{tmp_path}/sucursal")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("precio", "producto_fuente", "sucursal")}


def test_rows_of_one_unknown_key_are_split(spark, tmp_path):
    tables = survey(spark, tmp_path)
    price_rows(spark, 40000, F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("nothing")).repartition(8).withColumn("seq", F.lit(1)).write.parquet(f"{tmp_path}/new")
    skew = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1"}

    def run():
        reasons = upsert.ingest_rows(tables, "precio", spark.read.parquet(f"{tmp_path}/new"))[1]
        # an action on the frame's own plan, so that it is the one that ran
        return len(reasons.collect()), plan(reasons)

    n, ran = under(spark, skew, run)
    assert n == 40000 - 200 and "skew=true" in ran


def test_ingested_prices_are_dealt_by_reference_and_id_once(spark, tmp_path):
    tables = survey(spark, tmp_path)
    new = tables["precio"].withColumn("seq", F.lit(1))
    dealt = under(spark, PLAIN, lambda: plan(upsert.ingest_rows(tables, "precio", new)[0]))
    # listing and branch (rows and parents, parents grouped and plain), id (rows and base)
    assert dealt.count("Exchange hashpartitioning") == 8


def test_counting_a_load_deals_keys_alone(spark, tmp_path):
    base = survey(spark, tmp_path)["precio"]
    _, report = upsert.get_or_create(base, base.withColumn("id", F.concat(F.lit("N"), "id")), ("producto_fuente_id", "sucursal_id", "fecha_relevamiento"))
    shown = under(spark, PLAIN, lambda: plan(report))
    assert "moneda" not in shown and "precio#" not in shown
    assert [tuple(r) for r in report.collect()] == [("", 0, 2000)]


def test_maintained_rows_are_dealt_by_key_once(spark, tmp_path):
    prices = survey(spark, tmp_path)["precio"]
    latest = latest_prices(prices)
    latest.write.parquet(f"{tmp_path}/latest")
    shown = under(spark, PLAIN, lambda: plan(maintained_latest(spark.read.parquet(f"{tmp_path}/latest"), prices, prices.select("id"))))
    # all that meets by key, the history by key, the keys of which it is read, and keys with a null part
    assert shown.count("Exchange hashpartitioning(producto_fuente_id") + shown.count("Exchange hashpartitioning(sucursal_id") <= 4


def test_maintained_latest_of_keys_with_a_null_part(spark):
    def frame(rows):
        return spark.createDataFrame([(id, "f", branch, 1, "ARS", datetime(2024, 1, day), True, False, None) for id, branch, day in rows], "id string, producto_fuente_id string, sucursal_id string, precio int, moneda string, fecha_relevamiento timestamp, disponible boolean, promocion boolean, created_at timestamp")

    before = frame([("a", None, 5), ("b", None, 3), ("c", "x", 4)])
    for now in ([("a", None, 1), ("b", None, 3), ("c", "x", 4)], [("a", None, 5), ("b", None, 6), ("c", "x", 4)]):
        found = maintained_latest(latest_prices(before), frame(now), frame(now).where("id <> 'c'").select("id"))
        assert sorted(r.id for r in found.collect()) == ["b", "c"]


def test_last_rows_of_keys_that_are_equal_and_differ(spark):
    rows = spark.createDataFrame([(0.0, 1, "a"), (-0.0, 2, "b"), (1.0, 1, "c")], "k double, seq int, v string")
    found = sorted((repr(r.k), r.v) for r in upsert.latest_by(rows, ["k"], "seq").collect())
    assert found == [("-0.0", "b"), ("1.0", "c")]
