import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricerank.operators import pages, rows
from pricerank.operators.upsert import upsert
from pricerank.plans.maintained import maintained_latest
from pricerank.plans.prices import latest_prices
from pricerank.sources import jdbc
from pricerank.sources.partitioned import PartitionedTable
from pricerank.sources.schema import SCHEMAS
from pricerank.streaming import ingest
from tests import seed


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in seed.tables(spark).items()}


def test_jdbc(spark, t):
    url = "jdbc:derby:memory:survey;create=true"
    jdbc.save_all(t, url)
    again = jdbc.load_jdbc(spark, url, parts=3)
    for table, df in again.items():
        assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMAS[table]]
        assert sorted(map(repr, df.collect())) == sorted(map(repr, t[table].select(df.columns).collect())), table
    assert again["precio"].rdd.getNumPartitions() == 2  # ids are texts: dealt by how they begin
    by_time = jdbc.read_jdbc(spark, url, "precio", by="fecha_relevamiento", parts=4)
    assert by_time.count() == 20
    found = rows.where_given(again["precio"], sucursal_id="rada").select("id")
    assert "PushedFilters: [*IsNotNull(sucursal_id), *EqualTo(sucursal_id,rada)]" in (plan := found._jdf.queryExecution().toString()) and "moneda" not in plan.split("PhysicalPlan")[-1].split("PushedFilters")[-1]
    assert found.count() == 5
    jdbc.save_jdbc(t["marca"].withColumns({"id": F.lit("O'Hara"), "nombre": F.lit("x")}), url, "marca")
    assert jdbc.read_jdbc(spark, url, "marca", parts=2).count() == 2
    numbers = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "id long, nombre string")
    numbers.write.jdbc(url, "provincia_n")
    parts = spark.read.jdbc(url, "provincia_n", column="id", lowerBound=0, upperBound=99, numPartitions=4)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100


def test_predicates_part_all_rows():
    counted = [(None, 1), ("a", 5), ("b'", 1), ("c", 90), ("d", 1)]
    made = jdbc._predicates("SUBSTR(id, 1, 2)", "id", counted, 3)
    assert made == ["SUBSTR(id, 1, 2) IN ('a', 'b''', 'c') OR id IS NULL", "SUBSTR(id, 1, 2) IN ('d')"]


@pytest.mark.parametrize("order", [["a", "-b", "id"], ["-a", "b", "-id"]])
def test_pages(spark, order):
    rng = random.Random(1)
    data = [(k, rng.choice([None, "x", "y", "é"]), rng.choice([None, 1, 2, 3])) for k in range(230)]
    df = spark.createDataFrame(data, "id int, a string, b int").repartition(7)
    want = [r.id for r in df.orderBy(*[pages._sorted(c) for c in order]).collect()]
    numbered = pages.number_rows(df, order).cache()
    assert [r.id for r in numbered.orderBy("number").collect()] == want and numbered.agg(F.max("number")).first()[0] == 230
    assert [r.id for r in pages.page_at(numbered, 5, 20).orderBy("number").collect()] == want[80:100]
    token, at = None, 0
    while True:
        found, nexts = pages.seek(df, order, token, 50)
        assert [r.id for r in found.collect()] == want[at : at + 50]
        at += 50
        if not (last := nexts.collect()):
            break
        token = last[0].asDict()
    starts = {r.page: r.asDict() for r in pages.page_starts(numbered, order, 100).collect()}
    assert sorted(starts) == [1, 2, 3] and starts[2]["id"] == want[100]
    assert pages.number_rows(df.limit(0), order).count() == 0
    with pytest.raises(ValueError):
        pages.page_at(numbered, 0)


def test_numbering_needs_no_single_task_but_for_counts(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    plan = pages.number_rows(df, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    window = plan[: plan.index("SinglePartition")].splitlines()[-1] + plan[plan.index("SinglePartition") :]
    assert plan.count("Exchange SinglePartition") == 1 and "HashAggregate(keys=[part" in window


def price(i, day, branch="centro", listing="LA-LAV-001", amount=1):
    return (i, listing, branch, Decimal(amount), "ARS", datetime.datetime(2026, 1, day), True, False, datetime.datetime(2026, 1, 1))


def prices(spark, *rows):
    return spark.createDataFrame([price(*r) for r in rows], SCHEMAS["precio"])


def test_upsert_writes_touched_partitions_only(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path), SCHEMAS["precio"], "date_format(fecha_relevamiento, 'yyyy/MM/dd')")
    assert table.read().count() == 0 and table.versions() == []
    table.write(prices(spark, *[(f"d{d}-{k}", d) for d in range(1, 11) for k in range(5)]))
    before = table.manifest()
    table.upsert(prices(spark, ("d3-0", 3, "centro", "LA-LAV-001", 9), ("new", 3)))
    after = table.manifest()
    assert {p for p in after if after[p] != before[p]} == {"2026/01/03"} and len(after) == 10
    assert table.read().count() == 51 and table.read(version=1).count() == 50 and table.read(parts=["2026/01/03"]).count() == 6
    table.upsert(prices(spark, ("d4-0", 5)))  # a correction that moves a row to another day
    moved = table.manifest()
    assert {p for p in moved if moved[p] != after.get(p)} == {"2026/01/04", "2026/01/05"} and table.read().where("id = 'd4-0'").count() == 1
    # a version that failed half-way isn't seen, and is written by the next try
    table.read().limit(3).withColumn("part", F.lit("2026/01/03")).write.partitionBy("part").parquet(f"{tmp_path}/data/version=4")
    spark.range(1).write.parquet(f"{tmp_path}/manifest/version=4")
    (tmp_path / "manifest/version=4/_SUCCESS").unlink()
    assert table.versions() == [1, 2, 3] and table.read().count() == 51
    assert table.upsert(prices(spark, ("x", 9)), version=4) == 4 and table.read().count() == 52
    assert table.upsert(prices(spark, ("y", 9)), version=4) == 4 and table.read().count() == 52  # done already
    table.expire(keep=1)
    assert table.versions() == [4] and table.read().count() == 52
    hashed = PartitionedTable(spark, f"{tmp_path}/hashed", SCHEMAS["precio"], "pmod(xxhash64(id), 4)", by_key=True)
    hashed.upsert(table.read())
    hashed.upsert(prices(spark, ("x", 2)))
    assert hashed.read().count() == 52 and len({f.split("/")[1] for f in hashed.manifest().values()}) == 2


def test_stream_replaces_a_half_written_snapshot(spark, t, tmp_path):
    t["precio"].limit(2).withColumns({"seq": F.lit(1), "precio": F.lit(7).cast("decimal(14,2)")}).write.parquet(f"{tmp_path}/in")
    updates = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    t["precio"].limit(5).write.parquet(f"{tmp_path}/out-0")
    (tmp_path / "out-0/_SUCCESS").unlink()
    ingest.upsert_stream(updates, lambda: t["precio"], lambda n: f"{tmp_path}/out-{n}", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out-0").count() == 20


def test_stream_into_partitions(spark, tmp_path):
    table = PartitionedTable(spark, f"{tmp_path}/table", SCHEMAS["precio"], "date_format(fecha_relevamiento, 'yyyy-MM-dd')")
    table.write(prices(spark, *[(f"p{d}", d) for d in range(1, 6)]))
    source = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for day in (2, 4):
        prices(spark, (f"p{day}", day, "centro", "LA-LAV-001", 8), (f"n{day}", day)).withColumn("seq", F.lit(1)).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.stream_into(table, source(), f"{tmp_path}/checkpoint").awaitTermination()
    assert table.versions() == [1, 2, 3] and table.read().count() == 7 and table.read().where("precio = 8").count() == 2
    assert sorted(f.split("/")[1] for f in table.manifest().values()) == ["version=1"] * 3 + ["version=2", "version=3"]


def test_prices_wait_for_their_listings(spark, t, tmp_path):
    at = lambda minute: datetime.datetime(2026, 1, 1, 12) + datetime.timedelta(minutes=minute)
    offers = lambda *rows: prices(spark, *[(i, 1, "centro", listing) for i, listing, _ in rows]).withColumn("received_at", F.element_at(F.create_map(*[x for i, _, m in rows for x in (F.lit(i), F.lit(at(m)))]), F.col("id"))).withColumn("seq", F.lit(1))
    coming = lambda *rows: spark.createDataFrame([(i, at(m)) for i, m in rows], "id string, received_at timestamp")
    table = PartitionedTable(spark, f"{tmp_path}/table", SCHEMAS["precio"], "pmod(xxhash64(id), 2)", by_key=True)
    table.write(prices(spark, ("old", 1)))

    def run():
        source = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
        q = ingest.ingest_waiting(source("prices"), source("listings"), t["producto_fuente"], table, f"{tmp_path}/rejected", f"{tmp_path}/checkpoint", wait="10 minutes")
        q.awaitTermination()
        return q.lastProgress

    ids = lambda: {r.id for r in table.read().collect()}
    rejected = lambda: {tuple(r) for r in spark.read.parquet(f"{tmp_path}/rejected").select("table", "row_key", "rule").collect()}
    offers(("now", "LA-LAV-001", 0), ("later", "B", 1), ("never", "Z", 2), ("none", None, 2)).write.mode("append").parquet(f"{tmp_path}/prices")
    coming(("other", 0)).write.mode("append").parquet(f"{tmp_path}/listings")
    run()
    assert ids() == {"old", "now"} and rejected() == {("precio", "none", "reference:producto_fuente_id")}
    coming(("B", 5)).write.mode("append").parquet(f"{tmp_path}/listings")
    run()
    assert ids() == {"old", "now", "later"}
    state = []
    for minute in range(60, 360, 60):
        offers((f"t{minute}", "LA-LAV-001", minute), (f"u{minute}", "Y", minute)).write.mode("append").parquet(f"{tmp_path}/prices")
        coming((f"l{minute}", minute)).write.mode("append").parquet(f"{tmp_path}/listings")
        state.append(sum(o["numRowsTotal"] for o in run()["stateOperators"]))
    assert {"never", "u60", "u120"} <= {key for _, key, _ in rejected()} and "later" not in {key for _, key, _ in rejected()}
    assert ids() >= {"t60", "t300"} and state[-1] <= state[1]  # what is older has left the state


def test_maintained_latest(spark):
    rng = random.Random(2)
    row = lambda i: price(i, rng.randrange(1, 28), rng.choice("abc"), rng.choice("xyz"), rng.randrange(9))
    frame = lambda values: spark.createDataFrame(values, SCHEMAS["precio"])
    history = {f"p{k}": row(f"p{k}") for k in range(60)}
    latest = latest_prices(frame(list(history.values()))).collect()
    for step in range(10):
        batch = [row(i) for i in [*rng.sample(sorted(history), 6), *(f"n{step}-{k}" for k in range(3))]]
        if step % 3 == 0:  # the newest row of a key moves away
            batch.append(row(latest[0].id))
        history |= {r[0]: r for r in batch}
        now = frame(list(history.values()))
        latest = maintained_latest(frame([tuple(r) for r in latest]), now, frame(batch)).collect()
        assert sorted(map(repr, latest)) == sorted(map(repr, latest_prices(now).collect()))
    assert upsert(now, frame(batch)).count() == len(history)
