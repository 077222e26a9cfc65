"""Registered queries of the price model over the adapted order tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricerank.functions import geo, scores, text
from pricerank.operators import quality, rows, upsert
from pricerank.plans import catalog, prices, ranking
from pricerank.sources.schema import NATURAL_KEYS
from pricerank.sources.tables import ADAPTER, adapted, to_domain, to_storage, with_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Blocks that the SQL of several queries shares.
BLOCKS = {
    "latest": "SELECT * FROM precio QUALIFY row_number() OVER (PARTITION BY producto_fuente_id, sucursal_id ORDER BY fecha_relevamiento DESC, created_at DESC, id) = 1",
    "ab": "SELECT s.id AS sucursal_id, s.nombre AS sucursal, s.direccion, c.nombre AS supermercado, ci.nombre AS ciudad, s.latitud, s.longitud FROM sucursal s JOIN supermercado c ON s.supermercado_id = c.id JOIN ciudad ci ON s.ciudad_id = ci.id WHERE s.activo AND c.activo",
    "bp": "SELECT l.sucursal_id, f.producto_id, l.precio, l.fecha_relevamiento FROM latest l JOIN producto_fuente f ON l.producto_fuente_id = f.id WHERE l.disponible AND l.sucursal_id IN (SELECT sucursal_id FROM ab) QUALIFY row_number() OVER (PARTITION BY l.sucursal_id, f.producto_id ORDER BY l.fecha_relevamiento DESC, l.precio, l.id) = 1",
    "nl": "SELECT basket_id, count(*) AS n_lines, max(CASE WHEN product_id IN (SELECT id FROM producto WHERE activo) THEN 0 ELSE 1 END) AS unknown, max(CASE WHEN quantity > 0 THEN 0 ELSE 1 END) AS bad FROM basket_lines GROUP BY basket_id",
    "st": "SELECT b.*, coalesce(n_lines, 0) AS n_lines, CASE WHEN coalesce(n_lines, 0) NOT BETWEEN 1 AND 100 OR bad = 1 THEN 'INVALID_BASKET' WHEN c.id IS NULL THEN 'CITY_NOT_FOUND' WHEN unknown = 1 THEN 'PRODUCT_NOT_FOUND' ELSE 'OK' END AS status, c.latitud AS lat, c.longitud AS lon FROM baskets b LEFT JOIN nl USING (basket_id) LEFT JOIN ciudad c ON b.city_id = c.id",
    "matched": "SELECT l.basket_id, l.line_no, l.product_id, l.quantity, bp.sucursal_id, bp.precio, bp.fecha_relevamiento FROM basket_lines l JOIN st USING (basket_id) JOIN bp ON l.product_id = bp.producto_id WHERE st.status = 'OK'",
    "costs": "SELECT basket_id, sucursal_id, count(*) AS n_matched, CAST(sum(precio * quantity) AS DECIMAL(24,5)) AS total_cost, max(max(fecha_relevamiento)) OVER (PARTITION BY basket_id) AS latest_observed FROM matched GROUP BY basket_id, sucursal_id",
    "cand": "SELECT c.basket_id, c.sucursal_id, ab.sucursal, ab.direccion, ab.supermercado, ab.ciudad, total_cost, latest_observed, max(total_cost) OVER (PARTITION BY c.basket_id) - total_cost AS saving, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(CAST(ab.latitud - lat AS DOUBLE)) / 2), 2) + cos(radians(CAST(lat AS DOUBLE))) * cos(radians(CAST(ab.latitud AS DOUBLE))) * pow(sin(radians(CAST(ab.longitud - lon AS DOUBLE)) / 2), 2)))) AS km FROM costs c JOIN st USING (basket_id) JOIN ab USING (sucursal_id) WHERE n_matched = n_lines",
    "norm": "SELECT *, CASE WHEN max(total_cost) OVER w = min(total_cost) OVER w THEN 1.0 ELSE CAST(max(total_cost) OVER w - total_cost AS DOUBLE) / CAST(max(total_cost) OVER w - min(total_cost) OVER w AS DOUBLE) END AS s1, CASE WHEN max(km) OVER w = min(km) OVER w THEN 1.0 ELSE (max(km) OVER w - km) / (max(km) OVER w - min(km) OVER w) END AS s2, CASE WHEN max(saving) OVER w = min(saving) OVER w THEN 1.0 ELSE CAST(saving - min(saving) OVER w AS DOUBLE) / CAST(max(saving) OVER w - min(saving) OVER w AS DOUBLE) END AS s3 FROM cand WINDOW w AS (PARTITION BY basket_id)",
    "scored": "SELECT *, CAST(0.6 AS DOUBLE) * s1 + CAST(0.3 AS DOUBLE) * s2 + CAST(0.1 AS DOUBLE) * s3 AS score FROM norm",
}


def sql(body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({q})" for name, q in (ADAPTER | BLOCKS).items()) + "\n" + body


def fixed_sql(x: str, places: int) -> str:
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), {places}) AS DECIMAL(38,{places})) AS VARCHAR)"


def iso_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"


def query(name: str, body: str, *tables: str, money: tuple[str, ...] = ()):
    """Registers a function of the adapted tables under the name, with its SQL. Both engines return the decimal columns `money` as doubles."""

    def register(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(adapted(spark, sf_dir, *tables)).withColumns({c: F.col(c).cast("double") for c in money})
        ORACLE_SQL[name] = sql(f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in money)}) FROM ({body})" if money else body)
        return f

    return register


PRICE = "id, producto_fuente_id, sucursal_id, precio, moneda, disponible, promocion"
PRICE_COLUMNS = PRICE.split(", ")


# sources and sinks
@query("s1_scan_tables", " UNION ALL ".join(f"SELECT '{t}' AS tabla, count(*) AS n, count(DISTINCT id) AS n_ids FROM {t}" for t in list(ADAPTER)[:9]))
def _(t):
    parts = [t[name].agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids")).select(F.lit(name).alias("tabla"), "n", "n_ids") for name in list(ADAPTER)[:9]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s2_batch_lookup", f"SELECT {PRICE} FROM precio WHERE id IN (SELECT id FROM precio WHERE promocion)", "precio", money=("precio",))
def _(t):
    return rows.lookup(t["precio"], t["precio"].where("promocion").select("id")).select(PRICE_COLUMNS)


UPDATES = "SELECT id, producto_fuente_id, sucursal_id, CAST(precio + 1 AS DECIMAL(14,2)) AS precio, CAST(NULL AS STRING) AS moneda, fecha_relevamiento, disponible, promocion, CAST(NULL AS TIMESTAMP) AS created_at FROM precio WHERE promocion UNION ALL SELECT concat('N-', id), producto_fuente_id, sucursal_id, precio, moneda, fecha_relevamiento, disponible, promocion, created_at FROM precio WHERE NOT disponible"


def _updates(p: DataFrame) -> DataFrame:
    changed = p.where("promocion").withColumns({"precio": (F.col("precio") + 1).cast("decimal(14,2)"), "moneda": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp")})
    return changed.unionByName(p.where("NOT disponible").withColumn("id", F.concat(F.lit("N-"), "id")))


UPSERTED = "SELECT coalesce(u.id, b.id) AS id, CASE WHEN u.id IS NULL THEN b.precio ELSE u.precio END AS precio, CASE WHEN u.id IS NULL THEN b.moneda ELSE u.moneda END AS moneda, strftime(coalesce(u.created_at, b.created_at), '%Y-%m-%d') AS created FROM precio b FULL JOIN ({u}) u ON b.id = u.id"


@query("s3_upsert", UPSERTED.replace("{u}", UPDATES), "precio", money=("precio",))
def _(t):
    out = upsert.upsert(t["precio"], _updates(t["precio"]))
    return out.select("id", "precio", "moneda", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("s4_bulk_upsert", UPSERTED.replace("{u}", "SELECT id, CAST(precio + 2 AS DECIMAL(14,2)) AS precio, moneda, created_at FROM precio WHERE disponible"), "precio", money=("precio",))
def _(t):
    first = t["precio"].where("disponible").withColumn("seq", F.lit(1))
    again = first.withColumns({"precio": (F.col("precio") + 2).cast("decimal(14,2)"), "seq": F.lit(2)})
    out = upsert.upsert(t["precio"], first.unionByName(again), seq="seq")
    return out.select("id", "precio", "moneda", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("s5_ingest", "SELECT sucursal_id, count(*) AS n, sum(precio) AS total FROM (SELECT sucursal_id, precio FROM precio UNION ALL SELECT sucursal_id, precio FROM precio WHERE promocion AND precio >= 1000) GROUP BY sucursal_id", "precio", "producto_fuente", "producto", "supermercado", "sucursal", "ciudad", money=("total",))
def _(t):
    p = t["precio"].where("promocion").withColumns({"id": F.concat(F.lit("I-"), "id"), "seq": F.lit(1), "precio": F.when(F.col("precio") < 1000, F.lit(-1)).otherwise(F.col("precio")).cast("decimal(14,2)")})
    listings = t["producto_fuente"].withColumn("seq", F.lit(1))
    out, _rejected = upsert.ingest(t, listings, p)
    return out["precio"].groupBy("sucursal_id").agg(F.count("*").alias("n"), F.sum("precio").alias("total"))


@query("s5_ingest_rejected", "SELECT 'precio' AS \"table\", concat('I-', id) AS row_key, 'check:precio' AS rule FROM precio WHERE promocion AND precio < 1000 UNION ALL SELECT 'producto_fuente', concat('T-', CAST(id AS STRING)), 'unique:supermercado_id,codigo_externo' FROM producto_fuente WHERE supermercado_id = 1 UNION ALL SELECT 'producto_fuente', concat('O-', CAST(id AS STRING)), 'reference:producto_id' FROM producto_fuente WHERE supermercado_id = 2 UNION ALL SELECT 'precio', concat('O-', id), 'reference:producto_fuente_id' FROM precio WHERE NOT disponible", "precio", "producto_fuente", "producto", "supermercado", "sucursal", "ciudad", "provincia")
def _(t):
    """Listings whose key is taken (T-) or whose product is unknown (O-), and prices that are negative (I-) or refer to such a listing (O-)."""
    t = {**t, "producto_fuente": t["producto_fuente"].withColumn("id", F.col("id").cast("string")), "precio": t["precio"].withColumn("producto_fuente_id", F.col("producto_fuente_id").cast("string"))}
    f, p = t["producto_fuente"], t["precio"]
    taken = f.where("supermercado_id = 1").withColumn("id", F.concat(F.lit("T-"), "id"))
    orphans = f.where("supermercado_id = 2").withColumns({"id": F.concat(F.lit("O-"), "id"), "producto_id": -F.col("producto_id") - 1, "codigo_externo": F.concat(F.lit("O-"), "codigo_externo")})
    cheap = p.where("promocion").withColumns({"id": F.concat(F.lit("I-"), "id"), "precio": F.when(F.col("precio") < 1000, F.lit(-1)).otherwise(F.col("precio")).cast("decimal(14,2)")})
    lost = p.where("NOT disponible").withColumns({"id": F.concat(F.lit("O-"), "id"), "producto_fuente_id": F.lit("O-nothing")})
    seq = F.lit(1).alias("seq")
    return upsert.ingest(t, taken.unionByName(orphans).select("*", seq), cheap.unionByName(lost).select("*", seq))[1]


@query("s5_ingest_keys", "SELECT 'row' AS kind, CAST(id AS STRING) AS id, CASE WHEN supermercado_id IN (0, 2) THEN concat('M-', codigo_externo) ELSE codigo_externo END AS value FROM producto_fuente UNION ALL SELECT 'row', concat('N-', CAST(id AS STRING)), codigo_externo FROM producto_fuente WHERE supermercado_id IN (0, 2) UNION ALL SELECT 'rejected', CAST(id AS STRING), 'check:confianza_match' FROM producto_fuente WHERE supermercado_id = 3 UNION ALL SELECT 'rejected', concat('N-', CAST(id AS STRING)), 'unique:supermercado_id,codigo_externo' FROM producto_fuente WHERE supermercado_id IN (1, 3)", "producto_fuente", "producto", "supermercado")
def _(t):
    """New listings (N-) ask for the keys of others: chains 0 and 2 give theirs up by updates that are taken, 1 by none, 3 by updates that break a check."""
    f = t["producto_fuente"].withColumns({"id": F.col("id").cast("string"), "confianza_match": F.lit(1).cast("decimal(4,3)")})
    moved = f.where("supermercado_id <> 1").withColumns({"codigo_externo": F.concat(F.lit("M-"), "codigo_externo"), "confianza_match": F.when(F.col("supermercado_id") == 3, 5).otherwise(1).cast("decimal(4,3)")})
    asked = f.withColumn("id", F.concat(F.lit("N-"), "id"))
    out, rejected = upsert.ingest_rows({**t, "producto_fuente": f}, "producto_fuente", moved.unionByName(asked).withColumn("seq", F.lit(1)))
    return out.select(F.lit("row").alias("kind"), "id", F.col("codigo_externo").alias("value")).union(rejected.select(F.lit("rejected"), "row_key", "rule"))


NEW = "SELECT producto_fuente_id, sucursal_id, CAST(fecha_relevamiento + INTERVAL 1 DAY AS TIMESTAMP) AS fecha_relevamiento, precio, id FROM precio WHERE disponible UNION ALL SELECT producto_fuente_id, sucursal_id, fecha_relevamiento, precio, concat('Z-', id) FROM precio WHERE NOT disponible"
FRESH = f"SELECT producto_fuente_id, sucursal_id, fecha_relevamiento, min(id) AS id FROM ({NEW}) n WHERE NOT EXISTS (SELECT 1 FROM precio p WHERE p.producto_fuente_id = n.producto_fuente_id AND p.sucursal_id = n.sucursal_id AND p.fecha_relevamiento = n.fecha_relevamiento) GROUP BY ALL"


def _new(p: DataFrame) -> DataFrame:
    later = p.where("disponible").withColumn("fecha_relevamiento", F.col("fecha_relevamiento") + F.expr("INTERVAL 1 DAY"))
    return later.unionByName(p.where("NOT disponible").withColumn("id", F.concat(F.lit("Z-"), "id")))


@query("s6_get_or_create", f"SELECT id, producto_fuente_id, sucursal_id FROM precio UNION ALL SELECT id, producto_fuente_id, sucursal_id FROM ({FRESH})", "precio")
def _(t):
    merged, _report = upsert.get_or_create(t["precio"], _new(t["precio"]), ("producto_fuente_id", "sucursal_id", "fecha_relevamiento"), "precio")
    return merged.select("id", "producto_fuente_id", "sucursal_id")


@query("a9_load_summary", f"SELECT 'precio' AS resource, (SELECT count(*) FROM ({FRESH})) AS created, (SELECT count(*) FROM precio) - (SELECT count(*) FROM ({FRESH})) AS found", "precio")
def _(t):
    return upsert.get_or_create(t["precio"], _new(t["precio"]), ("producto_fuente_id", "sucursal_id", "fecha_relevamiento"), "precio")[1]


#: For each table a text of its natural key, which new rows change.
RENAMED = {"provincia": "nombre", "ciudad": "nombre", "supermercado": "nombre", "sucursal": "direccion", "categoria_producto": "nombre", "marca": "nombre", "producto": "codigo_interno", "producto_fuente": "codigo_externo", "precio": "producto_fuente_id"}


@query("s6_load_all", " UNION ALL ".join(f"SELECT '{x}' AS resource, count(*) + count(DISTINCT ({', '.join(NATURAL_KEYS[x])},)) AS n, count(DISTINCT ({', '.join(NATURAL_KEYS[x])},)) AS created, 2 * count(*) - count(DISTINCT ({', '.join(NATURAL_KEYS[x])},)) AS found FROM {x}" for x in RENAMED))
def _(t):
    """Every row once as it stands, which is found, and once with a new key, of which the first row is created."""
    t = {x: t[x].withColumns({"id": F.col("id").cast("string"), c: F.col(c).cast("string")}) for x, c in RENAMED.items()}
    new = {x: t[x].unionByName(t[x].withColumns({c: F.concat(F.lit("new "), c), "id": F.concat(F.lit("N-"), "id")})) for x, c in RENAMED.items()}
    merged, report = upsert.load_all(t, new)
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(x).alias("resource"), "n") for x, df in merged.items()]
    return report.join(reduce(DataFrame.unionByName, sizes), "resource").select("resource", "n", "created", "found")


EXPANDED = "SELECT p.id AS producto_id, s.id AS supermercado_id, CASE WHEN s.nombre = 'CHAIN_1' THEN concat('Own ', nombre_normalizado) ELSE nombre_normalizado END AS nombre_original, concat('C', CAST(s.id AS STRING), '-', codigo_interno) AS codigo_externo FROM producto p, supermercado s"


def _expanded(t) -> DataFrame:
    products = t["producto"].select("id", F.col("nombre_normalizado").alias("normalized_name"), F.col("codigo_interno").alias("source_suffix"), F.create_map(F.lit("CHAIN_1"), F.concat(F.lit("Own "), "nombre_normalizado")).alias("source_names"))
    return upsert.expand_listings(products, t["supermercado"].withColumn("prefix", F.concat(F.lit("C"), F.col("id").cast("string"))))


@query("s7_expand_listings", EXPANDED, "producto", "supermercado")
def _(t):
    return _expanded(t)


@query("s7_expand_prices", f"SELECT s.id AS sucursal_id, e.codigo_externo, CAST(p.contenido_neto + s.id AS DECIMAL(14,2)) AS precio FROM sucursal s JOIN ({EXPANDED}) e ON e.supermercado_id = s.supermercado_id JOIN producto p ON p.id = e.producto_id", "producto", "supermercado", "sucursal", money=("precio",))
def _(t):
    price = (F.col("p.contenido_neto") + F.col("s.id")).cast("decimal(14,2)")
    matrix = t["producto"].alias("p").crossJoin(t["sucursal"].alias("s")).select(F.col("s.id").alias("sucursal_id"), F.create_map("p.id", price).alias("prices"))
    listings = _expanded(t).withColumn("id", F.col("codigo_externo"))
    return upsert.expand_prices(matrix, listings, t["sucursal"]).select("sucursal_id", F.col("producto_fuente_id").alias("codigo_externo"), "precio")


@query("s8_defaults", "SELECT id, coalesce(moneda2, 'ARS') AS moneda, coalesce(disponible2, true) AS disponible, false AS promocion FROM (SELECT id, CASE WHEN promocion THEN NULL ELSE 'USD' END AS moneda2, CASE WHEN promocion THEN NULL ELSE disponible END AS disponible2 FROM precio)", "precio")
def _(t):
    bare = t["precio"].select("id", F.when(~F.col("promocion"), "USD").alias("moneda"), F.when(~F.col("promocion"), F.col("disponible")).alias("disponible"))
    return with_defaults(bare, "precio").select("id", "moneda", "disponible", "promocion")


@query("s9_domain_names", "SELECT id, producto_fuente_id AS product_source_id, sucursal_id AS branch_id, precio AS amount, moneda AS currency, disponible AS available, promocion AS promotion FROM precio", "precio", money=("amount",))
def _(t):
    there = to_domain(t["precio"], "precio")
    assert to_storage(there, "precio").columns == t["precio"].columns
    return there.select("id", "product_source_id", "branch_id", "amount", "currency", "available", "promotion")


# filters
@query("f1_active", "SELECT id, nombre FROM sucursal WHERE activo", "sucursal")
def _(t):
    return rows.active(t["sucursal"]).select("id", "nombre")


@query("f2_available", f"SELECT {PRICE} FROM precio WHERE disponible", "precio", money=("precio",))
def _(t):
    return prices.available(t["precio"]).select(PRICE_COLUMNS)


@query("f3_optional_filters", f"SELECT {PRICE} FROM precio WHERE sucursal_id = 4 AND promocion", "precio", money=("precio",))
def _(t):
    return rows.where_given(t["precio"], sucursal_id=4, promocion=True, moneda=None).select(PRICE_COLUMNS)


@query("f4_membership", f"SELECT {PRICE} FROM precio WHERE producto_fuente_id IN (SELECT id FROM producto_fuente WHERE supermercado_id = 1) AND sucursal_id IN (1, 2, 7)", "precio", "producto_fuente", money=("precio",))
def _(t):
    keys = t["producto_fuente"].where("supermercado_id = 1").select("id")
    return rows.restrict(rows.restrict(rows.restrict(t["precio"], "producto_fuente_id", keys), "sucursal_id", [1, 2, 7]), "moneda", None).select(PRICE_COLUMNS)


@query("f5_contains", "SELECT id, nombre_normalizado FROM producto WHERE nombre_normalizado ILIKE '%re_%'", "producto")
def _(t):
    return rows.matching(t["producto"], "nombre_normalizado", "  RE_ ").select("id", "nombre_normalizado")


@query("f6_search_by_name", "SELECT id, nombre_normalizado FROM producto WHERE nombre_normalizado ILIKE '%e%' ORDER BY nombre_normalizado, id LIMIT 20", "producto")
def _(t):
    return rows.search_by_name(t["producto"], "e").select("id", "nombre_normalizado")


@query("f7_natural_key", "SELECT id, nombre_original FROM producto_fuente WHERE supermercado_id = 2 AND codigo_externo = 'EXT-17'", "producto_fuente")
def _(t):
    return rows.find_by_key(t["producto_fuente"], supermercado_id=2, codigo_externo="EXT-17").select("id", "nombre_original")


@query("f8_children", "SELECT id, nombre FROM sucursal WHERE supermercado_id = 3", "sucursal")
def _(t):
    return rows.children(t["sucursal"], "supermercado_id", 3).select("id", "nombre")


@query("f9_full_listing", "SELECT id, nombre FROM marca", "marca")
def _(t):
    return rows.listing(t["marca"]).select("id", "nombre")


@query("f10_projection", "SELECT id, nombre, direccion, CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud FROM sucursal", "sucursal")
def _(t):
    return t["sucursal"].select("id", "nombre", "direccion", *[F.col(c).cast("double").alias(c) for c in ("latitud", "longitud")])


# joins
@query("j1_product_brand_category", "SELECT p.id, m.nombre AS marca, c.nombre AS categoria FROM producto p LEFT JOIN marca m ON p.marca_id = m.id LEFT JOIN categoria_producto c ON p.categoria_id = c.id WHERE p.activo", "producto", "marca", "categoria_producto")
def _(t):
    return catalog.search_products(t).select("id", "marca", "categoria")


@query("j2_city_province", "SELECT c.id, p.nombre AS provincia FROM ciudad c JOIN provincia p ON c.provincia_id = p.id", "ciudad", "provincia")
def _(t):
    return catalog.cities(t).select("id", "provincia")


@query("j3_branch_chain_city", "SELECT sucursal_id, sucursal, supermercado, ciudad FROM ab", "sucursal", "supermercado", "ciudad")
def _(t):
    return ranking.active_branches(t).select("sucursal_id", "sucursal", "supermercado", "ciudad")


CURRENT = "SELECT l.id, p.nombre_normalizado AS producto, f.nombre_original AS producto_fuente, s.nombre AS sucursal, s.direccion, c.nombre AS supermercado, ci.nombre AS ciudad, {price} AS precio, l.moneda, {time} AS fecha_relevamiento, l.disponible, l.promocion FROM latest l JOIN producto_fuente f ON l.producto_fuente_id = f.id JOIN producto p ON f.producto_id = p.id JOIN sucursal s ON l.sucursal_id = s.id JOIN supermercado c ON s.supermercado_id = c.id JOIN ciudad ci ON s.ciudad_id = ci.id".replace("{price}", fixed_sql("l.precio", 2)).replace("{time}", iso_sql("l.fecha_relevamiento"))


@query("j4_price_star", CURRENT)
def _(t):
    return prices.current_prices(t)


@query("j5_prices_of_products", f"SELECT {PRICE} FROM precio WHERE disponible AND producto_fuente_id IN (SELECT id FROM producto_fuente WHERE producto_id IN (SELECT id FROM producto WHERE NOT activo))", "precio", "producto_fuente", "producto", money=("precio",))
def _(t):
    return prices.available_prices(t["precio"], t["producto_fuente"], products=t["producto"].where("NOT activo").select("id")).select(PRICE_COLUMNS)


@query("j6_lines_with_prices", "SELECT basket_id, line_no, sucursal_id, precio FROM matched", money=("precio",))
def _(t):
    ok = ranking.basket_status(t, t["baskets"], t["basket_lines"]).where("status = 'OK'")
    return ranking.matched_lines(t, ok, t["basket_lines"]).select("basket_id", "line_no", "sucursal_id", "precio")


LACKING = "SELECT l.basket_id, ab.sucursal_id, l.line_no, l.product_id FROM basket_lines l JOIN st USING (basket_id) JOIN ab ON true WHERE st.status = 'OK' AND NOT EXISTS (SELECT 1 FROM bp WHERE bp.sucursal_id = ab.sucursal_id AND bp.producto_id = l.product_id)"


@query("j7_missing_products", f"SELECT basket_id, sucursal_id, count(*) AS n_missing FROM ({LACKING}) GROUP BY ALL")
def _(t):
    return ranking.incomplete_branches(t, t["baskets"], t["basket_lines"], every_product=True).select("basket_id", "sucursal_id", "n_missing")


@query("j8_unknown_products", "SELECT basket_id, product_id FROM basket_lines WHERE product_id NOT IN (SELECT id FROM producto WHERE activo)", "basket_lines", "producto")
def _(t):
    return ranking.unknown_products(t, t["basket_lines"]).select("basket_id", "product_id")


@query("j9_origin_distances", "SELECT basket_id, sucursal_id, round(km, 6) AS km FROM cand")
def _(t):
    return ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True).select("basket_id", F.col("branch_id").alias("sucursal_id"), F.round("distance_km", 6).alias("km"))


# aggregates
@query("a1_counts", "SELECT count(*) AS total FROM (SELECT p.id FROM producto p WHERE activo AND nombre_normalizado ILIKE '%a%')", "producto", "marca", "categoria_producto")
def _(t):
    return catalog.search_products(t, q="a").agg(F.count("*").alias("total"))


@query("a2_basket_totals", "SELECT basket_id, sucursal_id, n_matched, total_cost FROM costs", money=("total_cost",))
def _(t):
    return ranking.basket_costs(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)


@query("a3_a4_savings", "SELECT basket_id, sucursal_id, total_cost + saving AS max_total, saving FROM cand", money=("max_total", "saving",))
def _(t):
    return ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True).select("basket_id", F.col("branch_id").alias("sucursal_id"), (F.col("total_cost") + F.col("saving")).alias("max_total"), "saving")


@query("a5_latest_observation", "SELECT DISTINCT basket_id, strftime(latest_observed, '%Y-%m-%d') AS latest FROM costs")
def _(t):
    found = ranking.latest_observations(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)
    return found.select("basket_id", F.date_format("latest_observed", "yyyy-MM-dd").alias("latest"))


@query("a6_missing_list", f"SELECT basket_id, sucursal_id, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY line_no) AS missing FROM ({LACKING}) GROUP BY basket_id, sucursal_id")
def _(t):
    found = ranking.incomplete_branches(t, t["baskets"], t["basket_lines"], every_product=True)
    return found.select("basket_id", "sucursal_id", F.array_join(F.transform("productos_faltantes", lambda x: x["product_id"].cast("string")), ",").alias("missing"))


@query("a7_extremes", "SELECT basket_id, min(total_cost) AS low, max(total_cost) AS high, round(min(km), 6) AS near, round(max(km), 6) AS far FROM cand GROUP BY basket_id", money=("low", "high",))
def _(t):
    return ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True).groupBy("basket_id").agg(F.min("total_cost").alias("low"), F.max("total_cost").alias("high"), F.round(F.min("distance_km"), 6).alias("near"), F.round(F.max("distance_km"), 6).alias("far"))


@query("a8_basket_summary", "SELECT b.basket_id, count(product_id) AS n_lines, coalesce(string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY line_no), '') AS products, count(product_id) = 0 AS empty FROM baskets b LEFT JOIN basket_lines l USING (basket_id) GROUP BY b.basket_id", "baskets", "basket_lines")
def _(t):
    return ranking.basket_summary(t["baskets"], t["basket_lines"]).select("basket_id", "n_lines", F.array_join(F.transform("product_ids", lambda x: x.cast("string")), ",").alias("products"), "empty")


# windows
@query("w1_latest_price", f"SELECT {PRICE} FROM latest", "precio", money=("precio",))
def _(t):
    return prices.latest_prices(t["precio"]).select(PRICE_COLUMNS)


@query("w2_normalized", "SELECT basket_id, sucursal_id, round(s1, 6) AS price_score, round(s2, 6) AS distance_score, round(s3, 6) AS saving_score FROM norm")
def _(t):
    c = ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)
    s = {"price_score": scores.cost_score("total_cost", "basket_id"), "distance_score": scores.cost_score("distance_km", "basket_id"), "saving_score": scores.benefit_score("saving", "basket_id")}
    return c.select("basket_id", F.col("branch_id").alias("sucursal_id"), *[F.round(v, 6).alias(k) for k, v in s.items()])


@query("w3_positions", "SELECT basket_id, sucursal_id, row_number() OVER (PARTITION BY basket_id ORDER BY score DESC, supermercado, sucursal, sucursal_id) AS posicion FROM scored")
def _(t):
    return ranking.rank_baskets(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True).select("basket_id", "sucursal_id", "posicion")


# orders and pages
@query("l1_listing_order", "SELECT provincia_id, string_agg(nombre, ';' ORDER BY supermercado, nombre, id) AS branches FROM (SELECT s.id, c.nombre AS supermercado, s.nombre, ci.provincia_id FROM sucursal s JOIN supermercado c ON s.supermercado_id = c.id JOIN ciudad ci ON s.ciudad_id = ci.id WHERE s.activo) GROUP BY provincia_id", "sucursal", "supermercado", "ciudad")
def _(t):
    listed = catalog.branches(t).join(t["sucursal"].join(t["ciudad"].select(F.col("id").alias("ciudad_id"), "provincia_id"), "ciudad_id").select("id", "provincia_id"), "id")
    order = F.array_sort(F.collect_list(F.struct(*catalog.BRANCH_ORDER)))
    return listed.groupBy("provincia_id").agg(F.array_join(F.transform(order, lambda x: x["nombre"]), ";").alias("branches"))


@query("l2_page", "SELECT id, nombre FROM (SELECT id, nombre_normalizado AS nombre FROM producto WHERE activo ORDER BY nombre, id LIMIT 20 OFFSET 40)", "producto", "marca", "categoria_producto")
def _(t):
    return rows.page(catalog.search_products(t), ["nombre", "id"], number=3, size=20)[0].select("id", "nombre")


PAGED = "SELECT id, CAST((SELECT count(*) FROM r) AS BIGINT) AS total FROM (SELECT id FROM r ORDER BY {order} LIMIT 20 OFFSET 20)"


def _paged(df: DataFrame, order: list[str]) -> DataFrame:
    found, total = rows.page(df, order, number=2, size=20)
    return found.select("id", F.lit(total).cast("long").alias("total"))


@query("k1_page", f"SELECT * FROM (WITH r AS (SELECT id, nombre_normalizado FROM producto WHERE activo AND nombre_normalizado ILIKE '%a%') {PAGED.format(order='nombre_normalizado, id')})", "producto", "marca", "categoria_producto")
def _(t):
    return _paged(catalog.search_products(t, q="a"), ["nombre", "id"])


@query("k5_page", f"SELECT * FROM (WITH r AS (SELECT s.id, s.nombre, c.nombre AS supermercado FROM sucursal s JOIN supermercado c ON s.supermercado_id = c.id WHERE s.activo) {PAGED.format(order='supermercado, nombre, id')})", "sucursal", "supermercado", "ciudad")
def _(t):
    return _paged(catalog.branches(t), catalog.BRANCH_ORDER)


@query("k6_page", f"SELECT * FROM (WITH r AS ({CURRENT} WHERE s.supermercado_id = 2) {PAGED.format(order='producto, supermercado, sucursal, id')})")
def _(t):
    return _paged(prices.current_prices(t, chain=2), prices.CURRENT_ORDER)


@query("l3_limit_offset", "SELECT id FROM (SELECT id FROM producto WHERE activo ORDER BY nombre_normalizado, id LIMIT 100 OFFSET 50)", "producto")
def _(t):
    return rows.listing(rows.active(t["producto"]), 100, 50, "nombre_normalizado").select("id")


@query("l4_recency_order", "SELECT sucursal_id, id, row_number() OVER (PARTITION BY sucursal_id ORDER BY fecha_relevamiento DESC, id) AS pos FROM precio WHERE disponible", "precio", "producto_fuente")
def _(t):
    found = prices.available_prices(t["precio"], t["producto_fuente"])
    return found.select("sucursal_id", "id", F.row_number().over(Window.partitionBy("sucursal_id").orderBy(*prices.recency())).alias("pos"))


@query("l5_incomplete_order", f"SELECT basket_id, sucursal_id, row_number() OVER (PARTITION BY basket_id ORDER BY n, supermercado, sucursal, sucursal_id) AS pos FROM (SELECT basket_id, sucursal_id, count(*) AS n FROM ({LACKING}) GROUP BY ALL) JOIN ab USING (sucursal_id)")
def _(t):
    found = ranking.incomplete_branches(t, t["baskets"], t["basket_lines"], every_product=True)
    return found.select("basket_id", "sucursal_id", F.row_number().over(Window.partitionBy("basket_id").orderBy(*ranking.INCOMPLETE_ORDER[1:])).alias("pos"))


# sets
@query("u1_difference", "SELECT DISTINCT product_id FROM basket_lines WHERE product_id NOT IN (SELECT id FROM producto WHERE activo)", "basket_lines", "producto")
def _(t):
    return t["basket_lines"].select("product_id").subtract(rows.active(t["producto"]).select(F.col("id").alias("product_id")))


@query("u2_duplicate_products", "SELECT basket_id, product_id, count(*) AS n FROM raw_lines GROUP BY ALL HAVING count(*) > 1", "raw_lines")
def _(t):
    return quality.duplicate_products(t["raw_lines"])


# scalar functions
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(CAST(s.latitud - c.latitud AS DOUBLE)) / 2), 2) + cos(radians(CAST(c.latitud AS DOUBLE))) * cos(radians(CAST(s.latitud AS DOUBLE))) * pow(sin(radians(CAST(s.longitud - c.longitud AS DOUBLE)) / 2), 2))))"


@query("c1_haversine", f"SELECT b.basket_id, s.id AS sucursal_id, round({HAVERSINE}, 6) AS km FROM baskets b JOIN ciudad c ON b.city_id = c.id JOIN ciudad h ON h.provincia_id = c.provincia_id JOIN sucursal s ON s.ciudad_id = h.id", "baskets", "ciudad", "sucursal")
def _(t):
    home = t["ciudad"].select(F.col("id").alias("city_id"), "provincia_id", F.col("latitud").alias("lat"), F.col("longitud").alias("lon"))
    places = t["sucursal"].join(t["ciudad"].select(F.col("id").alias("ciudad_id"), "provincia_id"), "ciudad_id").select("provincia_id", F.col("id").alias("sucursal_id"), "latitud", "longitud")
    near = home.join(places, "provincia_id").select("city_id", "sucursal_id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("latitud"), F.col("longitud")), 6).alias("km"))
    return t["baskets"].select("basket_id", "city_id").join(near, "city_id").select("basket_id", "sucursal_id", "km")


@query("c2_c3_normalization", "SELECT id, round(CASE WHEN max(precio) OVER w = min(precio) OVER w THEN 1.0 ELSE CAST(max(precio) OVER w - precio AS DOUBLE) / CAST(max(precio) OVER w - min(precio) OVER w AS DOUBLE) END, 6) AS cost, round(CASE WHEN max(precio) OVER w = min(precio) OVER w THEN 1.0 ELSE CAST(precio - min(precio) OVER w AS DOUBLE) / CAST(max(precio) OVER w - min(precio) OVER w AS DOUBLE) END, 6) AS benefit FROM latest WINDOW w AS (PARTITION BY producto_fuente_id)", "precio")
def _(t):
    return prices.latest_prices(t["precio"]).select("id", F.round(scores.cost_score("precio", "producto_fuente_id"), 6).alias("cost"), F.round(scores.benefit_score("precio", "producto_fuente_id"), 6).alias("benefit"))


@query("c4_weighted_sum", "SELECT basket_id, sucursal_id, round(score, 6) AS score FROM scored")
def _(t):
    ranked = ranking.rank_alternatives(ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True))
    return ranked.select("basket_id", F.col("branch_id").alias("sucursal_id"), F.round("score", 6).alias("score"))


@query("c5_fixed_decimals", f"SELECT id, {fixed_sql('floor(precio) / 8', 2)} AS eighth, CAST(precio AS VARCHAR) AS plain FROM precio", "precio")
def _(t):
    return t["precio"].select("id", text.fixed(F.floor("precio").cast("double") / 8, 2).alias("eighth"), text.plain(F.col("precio")).alias("plain"))


@query("c6_metres", "SELECT basket_id, sucursal_id, round(km * 1000, 3) AS m FROM cand")
def _(t):
    return ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True).select("basket_id", F.col("branch_id").alias("sucursal_id"), F.round(geo.metres(F.col("distance_km")), 3).alias("m"))


@query("c7_iso_time", f"SELECT id, {iso_sql('fecha_relevamiento')} AS at FROM precio", "precio")
def _(t):
    return t["precio"].select("id", text.iso_time(F.col("fecha_relevamiento")).alias("at"))


@query("c8_strip", "SELECT id, nombre_normalizado AS nombre FROM producto", "producto")
def _(t):
    around = F.array(*[F.lit(x) for x in ("\t  ", "  \n", "\u00a0", "\x1c\x1d", "\x1e\u2003\x1f", "")])  # a pair for each row, in turn
    pick = lambda k: F.element_at(around, ((F.col("id") + k) % 6 + 1).cast("int"))
    return rows.stripped(t["producto"].select("id", F.concat(pick(0), "nombre_normalizado", pick(2)).alias("nombre")), "nombre")


@query("c9_external_code", "SELECT id, concat('C', CAST(supermercado_id AS STRING), '-', codigo_externo) AS code FROM producto_fuente", "producto_fuente")
def _(t):
    return t["producto_fuente"].select("id", text.external_code(F.concat(F.lit("C"), F.col("supermercado_id").cast("string")), F.col("codigo_externo")).alias("code"))


# change sets
@query("m1_activate", "SELECT id, CASE WHEN marca_id IS NULL THEN NOT activo ELSE activo END AS activo FROM producto", "producto")
def _(t):
    changed = t["producto"].where("marca_id IS NULL").select("id", F.lit(2).alias("seq"), (~F.col("activo")).alias("activo"))
    earlier = changed.withColumns({"seq": F.lit(1), "activo": ~F.col("activo")})
    return upsert.apply_changes(t["producto"], changed.unionByName(earlier)).select("id", "activo")


#: The kinds of rows that can be switched on and off.
SWITCHED = ("producto", "marca", "categoria_producto", "producto_fuente", "supermercado", "sucursal")


@query("m1_all_kinds", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", CAST(id AS VARCHAR) AS row_key, CASE WHEN right(CAST(id AS VARCHAR), 1) IN ('0', '1', '2', 'L') THEN true WHEN right(CAST(id AS VARCHAR), 1) IN ('3', '4', '5', 'N') THEN false ELSE activo END AS activo FROM {x}" for x in SWITCHED))
def _(t):
    def switched(x: str) -> DataFrame:
        last = F.substring(F.col("id").cast("string"), -1, 1)
        on = upsert.activate(t[x], t[x].where(last.isin("0", "1", "2", "L")))
        return upsert.activate(on, t[x].where(last.isin("3", "4", "5", "N")), False).select(F.lit(x).alias("table"), F.col("id").cast("string").alias("row_key"), "activo")

    return reduce(DataFrame.unionByName, map(switched, SWITCHED))


@query("m2_price_flags", "SELECT id, CASE WHEN promocion THEN false ELSE disponible END AS disponible, promocion OR NOT disponible AS promocion FROM precio", "precio")
def _(t):
    p = t["precio"]
    marked = upsert.mark_prices(p, p.where("promocion"), available=False, promotion=True)
    return upsert.mark_prices(marked, p.where("NOT disponible"), promotion=True).select("id", "disponible", "promocion")


# quality
@query("q1_q4_row_checks", "SELECT * FROM (SELECT 'precio' AS \"table\", id AS row_key, unnest(list_filter([CASE WHEN bad THEN 'check:precio' END, CASE WHEN promocion THEN 'length:moneda' END], lambda r: r IS NOT NULL)) AS rule FROM (SELECT id, promocion, disponible = false AND precio > 0 AS bad FROM precio))", "precio")
def _(t):
    broken = t["precio"].withColumns({"precio": F.when(F.col("disponible"), F.col("precio")).otherwise(-F.col("precio")).cast("decimal(14,2)"), "moneda": F.when(F.col("promocion"), F.lit("ARS pesos")).otherwise(F.col("moneda"))})
    return quality.row_violations(broken, "precio").select("table", "row_key", "rule")


@query("q2_unique", "SELECT 'producto_fuente' AS \"table\", concat(CAST(supermercado_id AS STRING), '|', codigo_externo) AS row_key, 'unique:supermercado_id,codigo_externo' AS rule, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT supermercado_id, codigo_externo FROM producto_fuente UNION ALL SELECT supermercado_id, codigo_externo FROM producto_fuente WHERE supermercado_id = 2) GROUP BY ALL HAVING count(*) > 1", "producto_fuente")
def _(t):
    again = t["producto_fuente"].where("supermercado_id = 2").withColumn("id", -F.col("id") - 1)
    return quality.unique_violations(t["producto_fuente"].unionByName(again), "producto_fuente").where("rule <> 'unique:id'")


@query("q3_references", "SELECT id AS row_key, 'reference:producto_fuente_id' AS rule FROM precio WHERE producto_fuente_id NOT IN (SELECT id FROM producto_fuente WHERE producto_id IN (SELECT id FROM producto WHERE activo))", "precio", "producto_fuente", "producto", "sucursal")
def _(t):
    kept = rows.active(t["producto"]).select(F.col("id").alias("producto_id"))
    fewer = {**t, "producto_fuente": t["producto_fuente"].join(kept, "producto_id", "left_semi")}
    return quality.reference_violations(fewer, "precio").select("row_key", "rule")


#: For each table a text that must not be blank and a reference that is broken below.
BLANKED = {"provincia": "nombre", "ciudad": "nombre", "supermercado": "nombre", "sucursal": "direccion", "categoria_producto": "nombre", "marca": "nombre", "producto": "nombre_normalizado", "producto_fuente": "nombre_original", "precio": "moneda"}
BROKEN = {"ciudad": "provincia_id", "sucursal": "ciudad_id", "producto": "categoria_id", "producto_fuente": "supermercado_id", "precio": "sucursal_id"}


def _blank_sql(table: str, column: str) -> str:
    """Every row of the table has a blank text here."""
    also = " UNION ALL SELECT 'precio', CAST(id AS VARCHAR), 'check:moneda' FROM precio" if table == "precio" else ""
    return f"SELECT '{table}' AS \"table\", CAST(id AS VARCHAR) AS row_key, 'blank:{column}' AS rule FROM {table}{also}"


@query("q1_all_tables", " UNION ALL ".join(_blank_sql(x, c) for x, c in BLANKED.items()))
def _(t):
    t = {x: t[x].withColumn(c, F.lit("  ")) for x, c in BLANKED.items()}
    return quality.violations(t, families=("row",)).where(~F.col("rule").startswith("missing:") & (F.col("rule") != "not_null:unidad_medida")).select("table", "row_key", "rule")


@query("q2_all_keys", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", CAST(id AS VARCHAR) AS row_key, 'unique:id' AS rule, '2' AS detail FROM {x}" for x in BLANKED))
def _(t):
    doubled = {x: t[x].unionByName(t[x]) for x in BLANKED}
    return quality.violations(doubled, families=("unique",)).where("rule = 'unique:id'")


@query("q3_all_references", " UNION ALL ".join(f"SELECT '{x}' AS \"table\", CAST(id AS VARCHAR) AS row_key, 'reference:{c}' AS rule FROM {x}" for x, c in BROKEN.items()))
def _(t):
    broken = {x: t[x].withColumn(BROKEN[x], F.concat(F.lit("?"), F.col(BROKEN[x]).cast("string"))) if x in BROKEN else t[x] for x in BLANKED}
    broken |= {x: broken[x].withColumn("id", F.col("id").cast("string")) for x in BROKEN.values() for x in (x.removesuffix("_id"),) if x in broken}
    named = {**broken, "categoria_producto": t["categoria_producto"].withColumn("id", F.col("id").cast("string"))}
    return quality.violations(named, list(BROKEN), families=("reference",)).where(F.col("rule").isin([f"reference:{c}" for c in BROKEN.values()])).select("table", "row_key", "rule")


@query("q5_baskets", "SELECT basket_id, count(product_id) AS n_lines, count(product_id) = 0 OR count(product_id) > 100 AS bad_size, coalesce(max(CASE WHEN quantity <= 0 THEN 1 ELSE 0 END), 0) = 1 AS bad_quantity, count(product_id) > count(DISTINCT product_id) AS duplicate_product FROM baskets LEFT JOIN raw_lines USING (basket_id) GROUP BY basket_id", "baskets", "raw_lines")
def _(t):
    return quality.basket_checks(t["baskets"], t["raw_lines"]).select("basket_id", "n_lines", "bad_size", "bad_quantity", "duplicate_product")


@query("q6_weights", "SELECT basket_id, basket_id % 5 IN (1, 2) AS bad_weights FROM baskets", "baskets")
def _(t):
    w = F.when(F.col("basket_id") % 5 == 1, F.lit(0.59)).when(F.col("basket_id") % 5 == 2, F.lit(-0.6)).otherwise(F.lit(0.6)).cast("decimal(9,8)")
    return t["baskets"].withColumn("w_price", w).select("basket_id", quality.bad_weights("w_price", "w_distance", "w_saving").alias("bad_weights"))


@query("q7_result_checks", "SELECT basket_id, sucursal_id AS branch_id, unnest(list_filter(['total_cost', CASE WHEN km > 0 THEN 'distance_km' END, CASE WHEN saving > 0 THEN 'saving' END, 'missing_products_count', 'supermarket_name', 'branch_name', 'score', 'position'], lambda r: r IS NOT NULL)) AS rule FROM scored")
def _(t):
    """All eight promises of a ranking broken at once."""
    ranked = ranking.rank_alternatives(ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True))
    broken = {c: -F.col(c) for c in ("total_cost", "distance_km", "saving")} | {"missing_products_count": F.lit(-1), "supermarket_name": F.lit(" "), "branch_name": F.lit(""), "score": F.col("score") + 2, "position": F.lit(0)}
    return quality.result_violations(ranked.withColumns(broken))


@query("q8_chain_mismatch", "SELECT p.id, f.supermercado_id AS listing_chain, s.supermercado_id AS branch_chain FROM precio p JOIN producto_fuente f ON p.producto_fuente_id = f.id JOIN (SELECT id, CASE WHEN NOT activo THEN (supermercado_id + 1) % 4 ELSE supermercado_id END AS supermercado_id FROM sucursal) s ON p.sucursal_id = s.id WHERE f.supermercado_id <> s.supermercado_id", "precio", "producto_fuente", "sucursal")
def _(t):
    moved = t["sucursal"].withColumn("supermercado_id", F.when(~F.col("activo"), (F.col("supermercado_id") + 1) % 4).otherwise(F.col("supermercado_id")))
    return quality.chain_mismatches(t["precio"], t["producto_fuente"], moved)


@query("q9_basket_status", "SELECT basket_id, n_lines, status FROM st")
def _(t):
    return ranking.basket_status(t, t["baskets"], t["basket_lines"]).select("basket_id", "n_lines", "status")


# the public queries
@query("k1_search_products", "SELECT p.id, p.nombre_normalizado AS nombre, m.nombre AS marca, c.nombre AS categoria, unidad_medida, CAST(contenido_neto AS VARCHAR) AS contenido_neto, codigo_interno FROM producto p LEFT JOIN marca m ON p.marca_id = m.id LEFT JOIN categoria_producto c ON p.categoria_id = c.id WHERE p.activo AND nombre_normalizado ILIKE '%a%'", "producto", "marca", "categoria_producto")
def _(t):
    return catalog.search_products(t, q="a")


@query("k2_categories", "SELECT id, nombre FROM categoria_producto WHERE activo", "categoria_producto")
def _(t):
    return catalog.categories(t)


@query("k3_cities", "SELECT c.id, c.nombre, p.nombre AS provincia, CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud FROM ciudad c JOIN provincia p ON c.provincia_id = p.id", "ciudad", "provincia")
def _(t):
    return catalog.cities(t)


@query("k4_supermarkets", "SELECT id, nombre FROM supermercado WHERE activo", "supermercado")
def _(t):
    return catalog.supermarkets(t)


@query("k5_branches", "SELECT s.id, s.nombre, s.direccion, c.nombre AS supermercado, ci.nombre AS ciudad, CAST(s.latitud AS DOUBLE) AS latitud, CAST(s.longitud AS DOUBLE) AS longitud FROM sucursal s JOIN supermercado c ON s.supermercado_id = c.id JOIN ciudad ci ON s.ciudad_id = ci.id WHERE s.activo AND s.supermercado_id = 1", "sucursal", "supermercado", "ciudad")
def _(t):
    return catalog.branches(t, supermarket_id=1)


@query("k6_current_prices", CURRENT + " WHERE s.supermercado_id = 2")
def _(t):
    return prices.current_prices(t, chain=2)


@query("k7_rank_baskets", f"SELECT basket_id, row_number() OVER (PARTITION BY basket_id ORDER BY score DESC, supermercado, sucursal, sucursal_id) AS posicion, sucursal_id, sucursal, direccion, supermercado, ciudad, {fixed_sql('total_cost', 2)} AS total, {fixed_sql('km', 2)} AS distancia_km, {fixed_sql('saving', 2)} AS ahorro, {fixed_sql('score', 4)} AS puntaje, {iso_sql('latest_observed')} AS fecha_relevamiento FROM scored")
def _(t):
    return ranking.rank_baskets(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)


@query("k8_incomplete_branches", f"SELECT basket_id, sucursal_id, sucursal, supermercado, ciudad, count(*) AS n_missing, string_agg(concat(CAST(product_id AS VARCHAR), ':', nombre_normalizado), ';' ORDER BY line_no) AS faltantes FROM ({LACKING}) JOIN ab USING (sucursal_id) JOIN producto p ON p.id = product_id GROUP BY ALL")
def _(t):
    found = ranking.incomplete_branches(t, t["baskets"], t["basket_lines"], every_product=True)
    named = F.transform("productos_faltantes", lambda x: F.concat_ws(":", x["product_id"].cast("string"), x["product_name"]))
    return found.withColumn("faltantes", F.array_join(named, ";")).drop("productos_faltantes")


@query("k9_available_prices", f"SELECT {PRICE} FROM precio WHERE disponible AND sucursal_id = 2", "precio", "producto_fuente", money=("precio",))
def _(t):
    return prices.available_prices(t["precio"], t["producto_fuente"], branch=2).select(PRICE_COLUMNS)


@query("k10_prices_for_basket", f"SELECT {PRICE} FROM precio WHERE disponible AND sucursal_id IN (SELECT id FROM sucursal WHERE activo) AND producto_fuente_id IN (SELECT id FROM producto_fuente WHERE producto_id IN (SELECT product_id FROM basket_lines))", "precio", "producto_fuente", "basket_lines", "sucursal", money=("precio",))
def _(t):
    wanted = t["basket_lines"].select("product_id").distinct()
    return prices.prices_for_basket(t["precio"], t["producto_fuente"], wanted, rows.active(t["sucursal"]).select("id")).select(PRICE_COLUMNS)


@query("k11_price_history", f"SELECT {PRICE} FROM precio WHERE producto_fuente_id = 41", "precio", money=("precio",))
def _(t):
    return prices.price_history(t["precio"], 41).select(PRICE_COLUMNS)


@query("k12_rank_alternatives", "SELECT basket_id, sucursal_id, row_number() OVER (PARTITION BY basket_id ORDER BY s1 DESC, supermercado, sucursal, sucursal_id) AS position FROM norm")
def _(t):
    c = ranking.candidates(t, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)
    return ranking.rank_alternatives(c, (1, 0, 0)).select("basket_id", F.col("branch_id").alias("sucursal_id"), "position")
