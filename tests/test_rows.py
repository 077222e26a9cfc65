from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricerank.functions import text
from pricerank.functions.geo import haversine_km
from pricerank.operators import rows
from pricerank.plans import catalog, prices
from tests import seed


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in seed.tables(spark).items()}


def ids(df):
    return [r.id for r in df.collect()]


def test_keys_and_parents(spark, t):
    assert ids(rows.get_by_id(t["marca"], "S")) == ["S"] and ids(rows.get_by_id(t["marca"], "?")) == []
    assert sorted(ids(rows.lookup(t["sucursal"], spark.createDataFrame([("centro",), ("?",), (None,)], "id string")))) == ["centro"]
    assert rows.restrict(t["precio"], "sucursal_id", None).count() == 20
    assert rows.restrict(t["precio"], "sucursal_id", []).count() == 0
    assert rows.restrict(t["precio"], "sucursal_id", ["rada"]).count() == 5
    assert ids(rows.children(t["sucursal"], "supermercado_id", "LA")) == ["centro", "rada"]
    assert ids(rows.find_by_key(t["producto_fuente"], supermercado_id="CAR", codigo_externo="CAR-LAV-001")) == ["CAR-LAV-001"]
    assert ids(rows.listing(t["ciudad"])) == ["CR", "RT"]


def test_search(spark, t):
    assert ids(rows.matching(t["producto"], "nombre_normalizado", " \tLECHE  ")) == ["LECHE-001"]
    assert rows.matching(t["producto"], "nombre_normalizado", "  ").count() == 5
    assert ids(rows.search_by_name(t["producto"], "la", limit=1)) == ["ARROZ-001"]
    with pytest.raises(ValueError):
        rows.matching(t["producto"], "nombre_normalizado", "x" * 121)


@pytest.mark.parametrize("query, hits", [("a%b", ["a%b", "a_b", "axxb"]), (r"a\%b", ["a%b"]), (r"a\_b", ["a_b"]), (r"a\xb", []), (r"\a", ["a%b", "a_b", "axxb", "c\\ad"]), (r"c\\a", ["c\\ad"]), ("C\\", [])])  # the last: a backslash takes the closing % literally
def test_patterns(spark, query, hits):
    df = spark.createDataFrame([("a%b",), ("a_b",), ("axxb",), ("c\\ad",), (None,)], "x string")
    assert [r.x for r in df.where(text.contains(F.col("x"), query)).orderBy("x").collect()] == hits


def test_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(text.strip(F.lit("\t  a b  \n"))) == "a b"
    assert [value(text.fixed(F.lit(Decimal(x)), 2)) for x in ("2.345", "2.355", "7", "-0.005")] == ["2.34", "2.36", "7.00", "0.00"]
    assert value(text.fixed(F.lit(None).cast("decimal(9,3)"), 2)) is None
    assert value(text.plain(F.lit(Decimal("2.250")))) == "2.250"
    assert value(text.iso_time(F.lit("2026-06-01 10:00:00").cast("timestamp"))) == "2026-06-01T10:00:00+00:00"
    assert value(text.iso_time(F.lit("2026-06-01 10:00:00.5").cast("timestamp"))) == "2026-06-01T10:00:00.500000+00:00"
    km = haversine_km(*[F.lit(Decimal(x)) for x in ("0", "0", "0", "180")])
    assert abs(value(km) - 3.141592653589793 * 6371.0088) < 1e-6


def test_pages(spark, t):
    found, total = rows.page(catalog.search_products(t), ["nombre", "id"], number=2, size=2)
    assert total == 5 and ids(found) == ["LAV-001", "LECHE-001"]
    with pytest.raises(ValueError):
        rows.page(t["producto"], ["id"], number=0)
    assert ids(rows.listing(t["producto"], 2, 1, "nombre_normalizado")) == ["COCA-225", "LAV-001"]


def test_catalog_queries(spark, t):
    coca = catalog.search_products(t, q="coca").first()
    assert (coca.categoria, coca.marca) == ("Bebidas", None)
    assert [r.nombre for r in catalog.supermarkets(t).collect()] == ["Carrefour", "Chango Más", "Jumbo", "La Anónima"]
    assert [r.provincia for r in catalog.cities(t).collect()] == ["Chubut", "Chubut"]
    assert ids(catalog.branches(t, city_id="RT")) == ["rada"]


def test_price_queries(spark, t):
    old = t["precio"].withColumns({"id": F.concat(F.lit("old-"), "id"), "fecha_relevamiento": F.lit("2026-05-01").cast("timestamp"), "precio": F.lit(1).cast("decimal(14,2)")})
    gone = t["precio"].where("sucursal_id = 'rada'").withColumns({"id": F.concat(F.lit("gone-"), "id"), "fecha_relevamiento": F.lit("2026-07-01").cast("timestamp"), "disponible": F.lit(False)})
    tables = {**t, "precio": t["precio"].unionByName(old).unionByName(gone)}
    latest = prices.latest_prices(tables["precio"])
    assert latest.count() == 20 and latest.where("NOT disponible").count() == 5 and latest.where("id LIKE 'old%'").count() == 0
    assert prices.current_prices(tables, branch="rada").where("disponible").count() == 0
    assert prices.current_prices(tables, product="LAV-001", city="CR").count() == 3
    assert prices.available_prices(tables["precio"], tables["producto_fuente"], branch="rada").count() == 10  # older rows count here
    assert prices.available_prices(tables["precio"], tables["producto_fuente"], products=[]).count() == 0
    assert prices.prices_for_basket(tables["precio"], tables["producto_fuente"], ["LAV-001"], ["rada", "centro"]).count() == 4
    assert prices.prices_for_basket(tables["precio"], tables["producto_fuente"], ["LAV-001"], []).count() == 0
    assert [r.id[:3] for r in prices.price_history(tables["precio"], "LA-LAV-001", "rada").collect()] == ["gon", "LA-", "old"]


def test_equal_times_fall_to_the_later_entry(spark, t):
    twin = t["precio"].limit(1).withColumns({"id": F.lit("zz"), "created_at": F.lit("2999-01-01").cast("timestamp")})
    key = twin.first()
    newest = prices.latest_prices(t["precio"].unionByName(twin)).where((F.col("producto_fuente_id") == key.producto_fuente_id) & (F.col("sucursal_id") == key.sucursal_id))
    assert ids(newest) == ["zz"]
