import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricerank.operators import quality, upsert
from pricerank.sources.schema import SCHEMAS
from pricerank.sources.tables import load, save, to_domain, to_storage, with_defaults
from pricerank.streaming.ingest import upsert_stream
from tests import seed


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in seed.tables(spark).items()}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", "x", "2020-01-01"), (2, "b", "y", "2020-01-01")], "id int, v string, w string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    new = spark.createDataFrame([(2, "B", None, None, 1), (2, "BB", None, None, 2), (3, "c", "z", None, 1)], "id int, v string, w string, created_at timestamp, seq int")
    out = {r.id: r for r in upsert.upsert(base, new, seq="seq").collect()}
    assert (out[1].v, out[1].w, out[2].v, out[2].w, out[3].v) == ("a", "x", "BB", None, "c")
    assert out[2].created_at.year == 2020 and out[3].created_at is not None
    again = upsert.upsert(upsert.upsert(base, new, seq="seq"), new, seq="seq")
    assert again.select("id", "v", "w").orderBy("id").collect() == upsert.upsert(base, new, seq="seq").select("id", "v", "w").orderBy("id").collect()


def test_get_or_create_twice_changes_nothing(spark, t):
    new = spark.createDataFrame([("n1", "Nestlé"), ("n2", "Nestlé"), ("n3", "Sancor")], "id string, nombre string")
    new = with_defaults(new.withColumn("descripcion", F.lit(None).cast("string")), "marca")
    merged, report = upsert.get_or_create(t["marca"], new, ("nombre",), "marca")
    assert sorted(r.id for r in merged.collect()) == ["S", "n1"]
    assert tuple(report.first()) == ("marca", 1, 2)
    merged2, report2 = upsert.get_or_create(merged, new, ("nombre",), "marca")
    assert merged2.count() == 2 and tuple(report2.first()) == ("marca", 0, 3)
    keyed, _ = upsert.get_or_create(t["marca"], new.drop("id"), ("nombre",), seq="nombre")
    assert keyed.where("nombre = 'Nestlé'").first().id == keyed.where("nombre = 'Nestlé'").first().id


def test_changes(spark, t):
    changes = spark.createDataFrame([("centro", 1, False), ("centro", 2, True), ("rada", 1, False), ("?", 1, False)], "id string, seq int, activo boolean")
    out = {r.id: r.activo for r in upsert.apply_changes(t["sucursal"], changes).collect()}
    assert out == {"centro": True, "rada": False, "carrefour": True, "chango": True}
    some = t["precio"].where("sucursal_id = 'rada'")
    marked = upsert.mark_prices(t["precio"], some, available=False)
    assert marked.where("NOT disponible").count() == 5 and marked.where("promocion").count() == 0
    assert upsert.activate(t["sucursal"], t["sucursal"].where("id = 'centro'"), False).where("NOT activo").count() == 1


def test_ingest(spark, t):
    listings = t["producto_fuente"].where("id = 'LA-LAV-001'").withColumns({"id": F.lit("new"), "codigo_externo": F.lit("new"), "seq": F.lit(1)})
    bad = listings.withColumns({"id": F.lit("bad"), "nombre_original": F.lit("  ")})
    price = t["precio"].limit(1).withColumn("seq", F.lit(1))
    offers = [price.withColumns({"id": F.lit(i), "producto_fuente_id": F.lit(f), "precio": F.lit(p).cast("decimal(14,2)")}) for i, f, p in (("p1", "new", 5), ("p2", "bad", 5), ("p3", "new", -5))]
    out, rejected = upsert.ingest(t, listings.unionByName(bad), offers[0].unionByName(offers[1]).unionByName(offers[2]))
    assert out["producto_fuente"].count() == 21 and out["precio"].where("id = 'p1'").count() == 1 and out["precio"].count() == 21
    assert {(r.table, r.row_key, r.rule) for r in rejected.collect()} == {("producto_fuente", "bad", "blank:nombre_original"), ("precio", "p2", "reference:producto_fuente_id"), ("precio", "p3", "check:precio")}


def test_quality(spark, t):
    assert quality.violations(t).count() == 0
    broken = {**t}
    broken["sucursal"] = t["sucursal"].withColumn("latitud", F.when(F.col("id") == "rada", F.lit(Decimal("91"))).otherwise(F.col("latitud")).cast("decimal(9,6)"))
    broken["producto"] = t["producto"].withColumns({"contenido_neto": F.lit(0).cast("decimal(12,3)"), "marca_id": F.when(F.col("id") == "LAV-001", "nobody")})
    broken["marca"] = t["marca"].unionByName(t["marca"])
    found = {(r.table, r.rule) for r in quality.violations(broken).collect()}
    assert found == {("sucursal", "check:coordinates"), ("producto", "check:contenido_neto"), ("producto", "reference:marca_id"), ("marca", "unique:id"), ("marca", "unique:nombre")}
    spaces = t["precio"].withColumn("moneda", F.lit("\t"))  # not blank for trim(), blank for strip()
    assert {r.rule for r in quality.row_violations(spaces, "precio").collect()} == {"blank:moneda"}
    twice = t["producto_fuente"].withColumn("codigo_externo", F.lit(None).cast("string"))
    assert quality.unique_violations(twice, "producto_fuente").count() == 0  # null keys never collide
    good, bad = quality.split_valid(broken["sucursal"], quality.table_rules("sucursal"))
    assert good.count() == 3 and [r.rules for r in bad.collect()] == [["check:coordinates"]]
    moved = t["sucursal"].withColumn("supermercado_id", F.lit("JUM"))
    assert quality.chain_mismatches(t["precio"], t["producto_fuente"], moved).count() == 20
    assert quality.currency_mix(t["precio"]).first().n_branches == 4


def test_names_and_snapshots(spark, t, tmp_path):
    for table in SCHEMAS:
        assert to_storage(to_domain(t[table], table), table).columns == t[table].columns
        save(t[table], f"{tmp_path}/{table}")
    again = load(spark, str(tmp_path))
    assert all(again[x].count() == t[x].count() for x in SCHEMAS)
    with pytest.raises(Exception, match="exist"):
        save(t["marca"], f"{tmp_path}/marca")


def test_stream(spark, t, tmp_path):
    t["precio"].limit(2).withColumns({"seq": F.lit(1), "precio": F.lit(7).cast("decimal(14,2)")}).write.parquet(f"{tmp_path}/in")
    updates = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        upsert_stream(updates, lambda: t["precio"], lambda n: f"{tmp_path}/out-{n}", f"{tmp_path}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out-0")
    assert out.count() == 20 and out.where("precio = 7").count() == 2


def test_upsert_of_odd_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").withColumn("created_at", F.current_timestamp())
    new = spark.createDataFrame([(None, "n"), (None, "m"), (2, "x"), (2, "y"), (3, "c")], "id int, v string").withColumn("created_at", F.lit(None).cast("timestamp"))
    out = upsert.upsert(base, new)
    assert sorted((r.id or 0, r.v) for r in out.collect()) == [(0, "m"), (0, "n"), (1, "a"), (2, "y"), (3, "c")]


def test_ingest_checks_uniqueness(spark, t):
    listing = t["producto_fuente"].where("id = 'LA-LAV-001'")
    one = lambda i, code, name="x", seq=1: listing.withColumns({"id": F.lit(i), "codigo_externo": F.lit(code).cast("string"), "nombre_original": F.lit(name), "seq": F.lit(seq)})
    new = one("taken", "LA-LAV-001").unionByName(one("a", "fresh")).unionByName(one("b", "fresh")).unionByName(one("n1", None)).unionByName(one("n2", None)).unionByName(one("LA-LAV-001", "moved", "old", 1)).unionByName(one("LA-LAV-001", "moved", "new", 2))
    out, rejected = upsert.ingest(t, new, t["precio"].limit(0).withColumn("seq", F.lit(1)))
    assert [(r.row_key, r.rule) for r in rejected.orderBy("row_key").collect()] == [("b", "unique:supermercado_id,codigo_externo")]
    assert quality.violations(out, ["producto_fuente"]).count() == 0 and out["producto_fuente"].where("id = 'LA-LAV-001'").first().nombre_original == "new"
    kept = new.where("id <> 'LA-LAV-001'")  # then the old key is still held
    assert {r.row_key for r in upsert.ingest(t, kept, t["precio"].limit(0).withColumn("seq", F.lit(1)))[1].collect()} == {"b", "taken"}


def test_missing_columns(spark, t):
    bare = t["precio"].select("id", "precio")
    assert {r.rule for r in quality.violations({**t, "precio": bare}, ["precio"]).collect()} == {f"missing:{c}" for c in ("producto_fuente_id", "sucursal_id", "moneda", "fecha_relevamiento", "disponible", "promocion", "created_at")}


def test_stream_with_checks(spark, t, tmp_path):
    good = t["precio"].limit(2).withColumns({"seq": F.lit(1), "precio": F.lit(7).cast("decimal(14,2)")})
    good.unionByName(good.limit(1).withColumns({"id": F.lit("odd"), "sucursal_id": F.lit("nowhere")})).write.parquet(f"{tmp_path}/in")
    updates = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    upsert_stream(updates, lambda: t["precio"], lambda n: f"{tmp_path}/out-{n}", f"{tmp_path}/checkpoint", tables=lambda: t, rejected_path=lambda n: f"{tmp_path}/rejected-{n}").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out-0")
    assert out.count() == 20 and out.where("precio = 7").count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/rejected-0").collect()] == [("precio", "odd", "reference:sucursal_id")]


KEY = "unique:supermercado_id,codigo_externo"


def ingested(spark, t, base, batch):
    """({id: code} after the batch, {(id, rule)} of what was rejected) of listings (id, code, confidence)."""
    one = t["producto_fuente"].limit(1).drop("id", "codigo_externo", "confianza_match")
    made = lambda rows: spark.createDataFrame(rows, "id string, codigo_externo string, confianza_match decimal(4,3)").crossJoin(one)
    tables = {**t, "producto_fuente": made(base).select(t["producto_fuente"].columns)}
    out, rejected = upsert.ingest_rows(tables, "producto_fuente", made(batch).withColumn("seq", F.lit(1)))
    out = out.select("id", "supermercado_id", "codigo_externo").cache()
    assert quality.unique_violations(out, "producto_fuente").count() == 0
    return {r.id: r.codigo_externo for r in out.collect()}, {(r.row_key, r.rule) for r in rejected.collect()}


def test_a_rejected_update_keeps_its_key(spark, t):
    """Cases apart, told by the first letter of ids and codes: base, batch, what stands afterwards, ids that are rejected for their key."""
    cases = {
        "a": ({"A": "x", "C": "z"}, {"A": ("new", 5), "N": ("x", None)}, {"A": "x", "C": "z"}, {"N"}),  # the update breaks a check
        "b": ({"A": "x"}, {"A": ("new", 1), "N": ("x", None)}, {"A": "new", "N": "x"}, set()),
        "c": ({"A": "x", "B": "y", "C": "z"}, {"B": ("z", None), "N": ("y", None)}, {"A": "x", "B": "y", "C": "z"}, {"B", "N"}),  # B may not have what C has, so y isn't free
        "d": ({"A": "x"}, {"0": ("x", None), "A": ("x", None)}, {"A": "x"}, {"0"}),  # an update that keeps its key comes before a lesser id
        "e": ({"A": "x", "B": "y"}, {"A": ("y", None), "B": ("x", None)}, {"A": "x", "B": "y"}, {"A", "B"}),  # an exchange needs a step between
        "f": ({"A": "x"}, {"A": (None, None), "M": (None, None), "N": ("x", None)}, {"A": None, "M": None, "N": "x"}, set()),
        "g": ({}, {"A": ("x", None), "B": ("x", None), "0": ("x", 5)}, {"A": "x"}, {"B"}),
    }
    base = [(k + i, k + c, None) for k, (rows, *_) in cases.items() for i, c in rows.items()]
    batch = [(k + i, c and k + c, m and Decimal(m)) for k, (_, rows, *_) in cases.items() for i, (c, m) in rows.items()]
    rows, rejected = ingested(spark, t, base, batch)
    assert rows == {k + i: c and k + c for k, (*_, after, _) in cases.items() for i, c in after.items()}
    assert rejected == {(k + i, KEY) for k, (*_, bad) in cases.items() for i in bad} | {("aA", "check:confianza_match"), ("g0", "check:confianza_match")}


def test_keys_stay_unique_after_any_batch(spark, t):
    rng = random.Random(11)
    base, batch = [], []
    for k in range(60):  # so many small worlds in one batch
        own = [(f"{k}b{c}", f"{k}{c}", None) for c in "abcde" if rng.random() < 0.7]
        base += own
        batch += [(i, rng.choice([None, *(f"{k}{c}" for c in "abcdefg")]), rng.choice([None, Decimal(1), Decimal(5)])) for i in rng.sample([i for i, *_ in own] + [f"{k}{x}{n}" for x in "an" for n in range(4)], 7)]
    rows, rejected = ingested(spark, t, base, batch)
    bad, before = {k for k, _ in rejected}, {i: c for i, c, _ in base}
    assert all(rows[i] == c for i, c, _ in batch if i not in bad) and all(rows.get(i) == before.get(i) for i in bad)
    assert len(bad) < len(batch) * 0.8 and all((i in rows) == (i in before) for i in bad)
