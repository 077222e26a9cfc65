"""Catalog and place queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.functions.text import plain
from pricerank.operators.rows import active, matching, where_given


def search_products(tables: Mapping[str, DataFrame], q: str | None = None, category_id=None) -> DataFrame:
    """Active products, with brand and category where they have one."""
    products = where_given(matching(active(tables["producto"]), "nombre_normalizado", q), categoria_id=category_id)
    brands, categories = (tables[t].select(F.col("id").alias(key), F.col("nombre").alias(name)) for t, key, name in (("marca", "marca_id", "marca"), ("categoria_producto", "categoria_id", "categoria")))
    joined = products.join(brands, "marca_id", "left").join(categories, "categoria_id", "left")
    return joined.select("id", F.col("nombre_normalizado").alias("nombre"), "marca", "categoria", "unidad_medida", plain(F.col("contenido_neto")).alias("contenido_neto"), "codigo_interno")


def categories(tables: Mapping[str, DataFrame]) -> DataFrame:
    return active(tables["categoria_producto"]).select("id", "nombre").orderBy("nombre", "id")


def supermarkets(tables: Mapping[str, DataFrame]) -> DataFrame:
    return active(tables["supermercado"]).select("id", "nombre").orderBy("nombre", "id")


def cities(tables: Mapping[str, DataFrame]) -> DataFrame:
    provinces = tables["provincia"].select(F.col("id").alias("provincia_id"), F.col("nombre").alias("provincia"))
    return tables["ciudad"].join(provinces, "provincia_id").select("id", "nombre", "provincia", F.col("latitud").cast("double").alias("latitud"), F.col("longitud").cast("double").alias("longitud")).orderBy("nombre", "id")


def branches(tables: Mapping[str, DataFrame], city_id=None, supermarket_id=None) -> DataFrame:
    """Active branches with the names of their chain and city; the chain itself need not be active."""
    rows = where_given(active(tables["sucursal"]), ciudad_id=city_id, supermercado_id=supermarket_id)
    chains, places = (tables[t].select(F.col("id").alias(key), F.col("nombre").alias(t)) for t, key in (("supermercado", "supermercado_id"), ("ciudad", "ciudad_id")))
    return rows.join(chains, "supermercado_id").join(places, "ciudad_id").select("id", "nombre", "direccion", "supermercado", "ciudad", F.col("latitud").cast("double").alias("latitud"), F.col("longitud").cast("double").alias("longitud"))


BRANCH_ORDER = ["supermercado", "nombre", "id"]
