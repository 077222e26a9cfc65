"""Registered queries of storage, deep pages and maintained tables, in the manner of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.operators import observed, pages, rows, trigrams
from pricerank.plans import catalog, prices, ranking
from pricerank.plans.maintained import maintained_latest
from pricerank.queries import CURRENT, FRESH, ORACLE_SQL, UPDATES, UPSERTED, _new, _updates, query
from pricerank.sources import jdbc, layout
from pricerank.sources.partitioned import PartitionedTable
from pricerank.sources.scratch import new_path, stored


@query("s1_jdbc_scan", "SELECT CAST(id AS VARCHAR) AS id, CAST(producto_id AS VARCHAR) AS producto_id, CAST(supermercado_id AS VARCHAR) AS supermercado_id, codigo_externo, nombre_original, activo FROM producto_fuente WHERE supermercado_id <> 2", "producto_fuente")
def _(t):
    """The listings into a database and back, by ranges of their id. The database is that of pricerank.jdbc.url, or on a local master one in memory."""
    spark, name = t["producto_fuente"].sparkSession, f"listings_{uuid.uuid4().hex[:12]}"
    url = spark.conf.get("pricerank.jdbc.url", None) or f"jdbc:derby:memory:{name};create=true"
    jdbc.save_jdbc(t["producto_fuente"], url, "producto_fuente", name=name)
    found = jdbc.read_jdbc(spark, url, "producto_fuente", parts=4, name=name)
    return found.where("supermercado_id <> '2'").select("id", "producto_id", "supermercado_id", "codigo_externo", "nombre_original", "activo")


BY_PRODUCT = "producto, supermercado, sucursal, id"


@query("l2_page_numbers", f"SELECT id, row_number() OVER (ORDER BY {BY_PRODUCT}) AS number FROM ({CURRENT})")
def _(t):
    return pages.number_rows(prices.current_prices(t), prices.CURRENT_ORDER).select("id", "number")


@query("l2_deep_page", f"SELECT id, producto, precio FROM ({CURRENT}) ORDER BY {BY_PRODUCT} LIMIT 20 OFFSET 580")
def _(t):
    return pages.page_at(pages.number_rows(prices.current_prices(t), prices.CURRENT_ORDER), 30).select("id", "producto", "precio")


@query("l2_seek", f"SELECT id, producto, precio FROM ({CURRENT}) ORDER BY {BY_PRODUCT} LIMIT 20 OFFSET 601")
def _(t):
    """What follows the first row of page 31, found by that row's values; nothing if there is no such page."""
    current = stored(prices.current_prices(t))
    token = pages.page_starts(pages.number_rows(current, prices.CURRENT_ORDER), prices.CURRENT_ORDER).where("page = 31").drop("page").first()
    found = current.limit(0) if token is None else pages.seek(current, prices.CURRENT_ORDER, token.asDict())[0]
    return found.select("id", "producto", "precio")


LISTED = {
    "products": ("SELECT CAST(p.id AS VARCHAR) AS id, nombre_normalizado AS a, '' AS b, p.id AS c FROM producto p WHERE p.activo", lambda t: catalog.search_products(t).orderBy("nombre", "id")),
    "categories": ("SELECT id, nombre, '', 0 FROM categoria_producto WHERE activo", catalog.categories),
    "supermarkets": ("SELECT CAST(id AS VARCHAR), nombre, '', id FROM supermercado WHERE activo", catalog.supermarkets),
    "cities": ("SELECT CAST(c.id AS VARCHAR), c.nombre, '', c.id FROM ciudad c JOIN provincia p ON c.provincia_id = p.id", catalog.cities),
    "branches": ("SELECT CAST(s.id AS VARCHAR), c.nombre, s.nombre, s.id FROM sucursal s JOIN supermercado c ON s.supermercado_id = c.id JOIN ciudad ci ON s.ciudad_id = ci.id WHERE s.activo", lambda t: catalog.branches(t).orderBy(*catalog.BRANCH_ORDER)),
    "prices": (f"SELECT id, producto, concat(supermercado, ' ', sucursal), 0 FROM ({CURRENT})", lambda t: prices.current_prices(t).orderBy(*prices.CURRENT_ORDER)),
}


@query("l1_all_orders", " UNION ALL ".join(f"SELECT '{kind}' AS kind, id, row_number() OVER (ORDER BY a, b, c, id) AS number FROM (SELECT * FROM ({sql}) x(id, a, b, c))" for kind, (sql, _) in LISTED.items()))
def _(t):
    """Each listing's rows, numbered as its function orders them."""
    out = None
    for kind, (_, listing) in LISTED.items():
        ordered = listing(t).select(F.col("id").cast("string").alias("id"), F.monotonically_increasing_id().alias("_place"))
        part = pages.number_rows(ordered, ["_place"]).select(F.lit(kind).alias("kind"), "id", "number")
        out = part if out is None else out.unionByName(part)
    return out


def price_table(prices_: DataFrame) -> PartitionedTable:
    return PartitionedTable(prices_.sparkSession, new_path(prices_.sparkSession, "prices"), prices_.schema, "date_format(fecha_relevamiento, 'yyyy-MM')")


MONTH = "fecha_relevamiento >= TIMESTAMP '1996-03-01 00:00:00' AND fecha_relevamiento < TIMESTAMP '1996-04-01 00:00:00'"


@query("s3_partitioned_upsert", UPSERTED.replace("{u}", f"SELECT * FROM ({UPDATES}) WHERE {MONTH}"), "precio", money=("precio",))
def _(t):
    """The updates of a month into a table by months, which writes that month's partition."""
    table = price_table(t["precio"])
    table.write(t["precio"])
    table.upsert(_updates(t["precio"]).where(MONTH))
    return table.read().select("id", "precio", "moneda", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("s3_partitions_written", f"SELECT strftime(fecha_relevamiento, '%Y-%m') AS month, CASE WHEN {MONTH} THEN 2 ELSE 1 END AS version FROM precio GROUP BY ALL", "precio")
def _(t):
    """The version that each partition's files are of, after that upsert."""
    table = price_table(t["precio"])
    table.write(t["precio"])
    table.upsert(_updates(t["precio"]).where(MONTH))
    rows = [(part, int(folder.split("/")[1].split("=")[1])) for part, folder in table.manifest().items()]
    return t["precio"].sparkSession.createDataFrame(rows, "month string, version int")


EARLY = "fecha_relevamiento < TIMESTAMP '1997-06-01 00:00:00'"
CORRECTED = f"SELECT * REPLACE (CASE WHEN {EARLY} AND NOT disponible THEN fecha_relevamiento - INTERVAL 400 DAY ELSE fecha_relevamiento END AS fecha_relevamiento) FROM precio"


@query("w1_maintained_latest", f"SELECT id, producto_fuente_id, sucursal_id, precio, disponible FROM ({CORRECTED}) QUALIFY row_number() OVER (PARTITION BY producto_fuente_id, sucursal_id ORDER BY fecha_relevamiento DESC, created_at DESC, id) = 1", "precio", money=("precio",))
def _(t):
    """The latest prices of mid 1997, maintained by the later rows and by corrections that date unavailable ones 400 days back."""
    before = t["precio"].where(EARLY)
    corrected = before.where("NOT disponible").withColumn("fecha_relevamiento", F.col("fecha_relevamiento") - F.expr("INTERVAL 400 DAY"))
    changed = corrected.unionByName(t["precio"].where(f"NOT ({EARLY})"))
    now = before.where("disponible").unionByName(changed)
    latest = stored(prices.latest_prices(before))
    return maintained_latest(latest, now, changed.select("id")).select("id", "producto_fuente_id", "sucursal_id", "precio", "disponible")


@query("k7_rank_bucketed", "SELECT 1")
def _(t):
    """The ranking over prices stored in buckets, of which none is dealt anew."""
    bucketed = layout.save_bucketed(t["precio"], t["producto_fuente"], f"prices_{uuid.uuid4().hex[:12]}", buckets=8)
    return ranking.rank_baskets({**t, "precio": bucketed}, t["baskets"], t["basket_lines"].drop("line_no"), every_product=True)


ORACLE_SQL["k7_rank_bucketed"] = ORACLE_SQL["k7_rank_baskets"]

ASKED = "SELECT id AS query_id, CASE id % 5 WHEN 0 THEN substr(nombre_normalizado, 3, 2) WHEN 1 THEN concat(substr(nombre_normalizado, 1, 3), '%', substr(nombre_normalizado, 7, 3)) WHEN 2 THEN concat('_', upper(substr(nombre_normalizado, 4, 4))) ELSE substr(nombre_normalizado, 2, 6) END AS query FROM producto"


@query("f5_search_many", f"SELECT query_id, count(*) AS n_hits, min(p.id) AS first_id FROM ({ASKED}) q JOIN producto p ON p.nombre_normalizado ILIKE concat('%', query, '%') GROUP BY query_id", "producto")
def _(t):
    """A search out of every product's name, short ones and wildcards among them, over all names."""
    asked = t["producto"].sparkSession.sql(ASKED.replace("FROM producto", "FROM {p}"), p=t["producto"])
    return trigrams.count_many(t["producto"], asked, "nombre_normalizado")


@query("s2_point_lookup", "SELECT id, sucursal_id, precio FROM precio WHERE id IN (SELECT id FROM precio ORDER BY md5(id), id LIMIT 10)", "precio", money=("precio",))
def _(t):
    """Ten prices by id out of files with Bloom filters."""
    path = new_path(t["precio"].sparkSession, "lookup")
    layout.save_for_lookups(t["precio"], path, ["id"])
    wanted = [r.id for r in t["precio"].orderBy(F.md5(F.col("id").cast("binary")), "id").limit(10).select("id").collect()]
    return layout.lookup_few(t["precio"].sparkSession.read.parquet(path), wanted).select("id", "sucursal_id", "precio")


@query("q1_observed", "SELECT 'rows' AS rule, count(*) AS n FROM precio UNION ALL SELECT 'check:precio', count(*) FILTER (WHERE NOT disponible AND precio > 0) FROM precio UNION ALL SELECT 'length:moneda', count(*) FILTER (WHERE promocion) FROM precio", "precio")
def _(t):
    """What q1_q4_row_checks lists, counted by the pass that writes the table."""
    odd = t["precio"].withColumns({"precio": F.when(F.col("disponible"), F.col("precio")).otherwise(-F.col("precio")).cast("decimal(14,2)"), "moneda": F.when(F.col("promocion"), F.lit("MUCH TOO LONG")).otherwise(F.col("moneda"))})
    spark = odd.sparkSession
    return spark.createDataFrame(sorted(observed.observed_write(odd, "precio", new_path(spark)).items()), "rule string, n long")


@query("a9_observed_load", f"SELECT (SELECT count(*) FROM ({FRESH})) AS created, (SELECT count(*) FROM precio) - (SELECT count(*) FROM ({FRESH})) AS found", "precio")
def _(t):
    """What a9_load_summary counts, by the pass that writes the load."""
    spark = t["precio"].sparkSession
    counts = observed.observed_get_or_create(t["precio"], _new(t["precio"]), ("producto_fuente_id", "sucursal_id", "fecha_relevamiento"), new_path(spark))
    return spark.createDataFrame([(counts["created"], counts["found"])], "created long, found long")


@query("l1_collated", "SELECT id, row_number() OVER (ORDER BY lower(nombre), nombre, id) AS number FROM (SELECT id, CASE WHEN id % 3 = 0 THEN upper(nombre_normalizado) ELSE nombre_normalizado END AS nombre FROM producto)", "producto")
def _(t):
    """All products by name without regard to case, as one of the collations orders them."""
    mixed = t["producto"].withColumn("nombre", F.when(F.col("id") % 3 == 0, F.upper("nombre_normalizado")).otherwise(F.col("nombre_normalizado")))
    ordered = rows.listing(mixed, collation="UTF8_LCASE").select("id", F.monotonically_increasing_id().alias("_place"))
    return pages.number_rows(ordered, ["_place"]).select("id", "number")
