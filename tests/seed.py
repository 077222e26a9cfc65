"""The small survey whose rankings are known: two cities, four chains, four branches, five products. Its names, places and prices are fixed values, as the rankings rest on them."""

from decimal import Decimal

from pyspark.sql import functions as F

from pricerank.operators.upsert import expand_listings, expand_prices
from pricerank.sources.schema import SCHEMAS
from pricerank.sources.tables import conform, with_defaults

CHAINS = {"La Anónima": "LA", "Carrefour": "CAR", "Chango Más": "CHA", "Jumbo": "JUM"}
CITIES = {"CR": ("Comodoro Rivadavia", "-45.8641", "-67.4966"), "RT": ("Rada Tilly", "-45.9269", "-67.5542")}
BRANCHES = [
    ("centro", "La Anónima", "CR", "Centro", "-45.8645", "-67.4820", (2600, 1450, 1800, 1200, 3200)),
    ("carrefour", "Carrefour", "CR", "Comodoro", "-45.8750", "-67.5100", (2550, 1500, 1750, 1150, 3150)),
    ("chango", "Chango Más", "CR", "Comodoro", "-45.8460", "-67.5000", (2500, 1420, 1700, 1100, 3300)),
    ("rada", "La Anónima", "RT", "Rada Tilly", "-45.9250", "-67.5550", (2700, 1480, 1850, 1250, 3400)),
]
PRODUCTS = {"COCA-225": "Coca Cola 2.25 L", "LECHE-001": "Leche Entera 1 L", "ARROZ-001": "Arroz Largo Fino 1 Kg", "LAV-001": "Lavandina 1 L", "PAPEL-004": "Papel Higiénico 4 Rollos"}


def rows(spark, table, values):
    names = SCHEMAS[table].names
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], SCHEMAS[table])


def tables(spark):
    t = {
        "provincia": rows(spark, "provincia", [{"id": "CH", "nombre": "Chubut"}]),
        "ciudad": rows(spark, "ciudad", [{"id": k, "provincia_id": "CH", "nombre": n, "latitud": Decimal(a), "longitud": Decimal(o)} for k, (n, a, o) in CITIES.items()]),
        "supermercado": rows(spark, "supermercado", [{"id": p, "nombre": n, "activo": True} for n, p in CHAINS.items()]),
        "sucursal": rows(spark, "sucursal", [{"id": k, "supermercado_id": CHAINS[c], "ciudad_id": city, "nombre": n, "direccion": k, "latitud": Decimal(a), "longitud": Decimal(o), "activo": True} for k, c, city, n, a, o, _ in BRANCHES]),
        "categoria_producto": rows(spark, "categoria_producto", [{"id": "B", "nombre": "Bebidas", "activo": True}]),
        "marca": rows(spark, "marca", [{"id": "S", "nombre": "Sancor", "activo": True}]),
        "producto": rows(spark, "producto", [{"id": k, "categoria_id": "B" if k == "COCA-225" else None, "nombre_normalizado": n, "codigo_interno": k, "activo": True} for k, n in PRODUCTS.items()]),
    }
    t = {name: conform(with_defaults(df, name), name) for name, df in t.items()}
    products = t["producto"].select("id", F.col("nombre_normalizado").alias("normalized_name"), F.col("id").alias("source_suffix"), F.create_map(F.lit("Carrefour"), F.lit("Gaseosa Coca Cola 2,25 L")).alias("source_names"))
    products = products.withColumn("source_names", F.when(F.col("id") == "COCA-225", F.col("source_names")))
    listings = expand_listings(products, t["supermercado"].withColumn("prefix", F.col("id"))).withColumn("id", F.col("codigo_externo"))
    t["producto_fuente"] = conform(with_defaults(listings, "producto_fuente"), "producto_fuente")
    matrix = spark.createDataFrame([(k, {p: Decimal(x) for p, x in zip(PRODUCTS, prices)}) for k, *_, prices in BRANCHES], "sucursal_id string, prices map<string, decimal(14,2)>")
    cells = expand_prices(matrix, t["producto_fuente"], t["sucursal"]).withColumns({"id": F.concat_ws("/", "producto_fuente_id", "sucursal_id"), "fecha_relevamiento": F.lit("2026-06-01 10:00:00").cast("timestamp")})
    t["precio"] = conform(with_defaults(cells, "precio"), "precio")
    return t


def baskets(spark, *values):
    """(basket_id, city_id, w_price, w_distance, w_saving)"""
    return spark.createDataFrame([(b, c, *map(Decimal, w)) for b, c, *w in values], "basket_id string, city_id string, w_price decimal(9,8), w_distance decimal(9,8), w_saving decimal(9,8)")


def lines(spark, *values):
    """(basket_id, {product: quantity})"""
    flat = [(b, k, p, Decimal(str(q))) for b, items in values for k, (p, q) in enumerate(items.items(), 1)]
    return spark.createDataFrame(flat, "basket_id string, line_no int, product_id string, quantity decimal(12,3)")


def all_of(q=1):
    return {p: q for p in PRODUCTS}
