"""Price queries. "Current" has two meanings, kept apart: the newest row of each (listing, branch), and all available rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.functions.text import fixed, iso_time
from pricerank.operators.rows import restrict, where_given


def latest_prices(prices: DataFrame, also_by: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each (listing, branch), available or not; ties by created_at (newest), then id. also_by: columns that the
    listing or branch determines, if the rows are already dealt by them."""
    newest = Window.partitionBy(*also_by, "producto_fuente_id", "sucursal_id").orderBy(F.col("fecha_relevamiento").desc(), F.col("created_at").desc_nulls_last(), F.col("id"))
    return prices.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def available(prices: DataFrame) -> DataFrame:
    return prices.where("disponible")


def current_prices(tables: Mapping[str, DataFrame], product=None, city=None, branch=None, chain=None) -> DataFrame:
    """Newest prices with their listing, product, branch, chain and city, by any of four filters. Neither availability nor any activo flag
    filters. Filters by product, city and chain reach the prices as key lists before the newest row is picked, which is safe, since
    they select whole (listing, branch) groups."""
    listings = where_given(tables["producto_fuente"], producto_id=product)
    branches = where_given(tables["sucursal"], id=branch, ciudad_id=city, supermercado_id=chain)
    prices = tables["precio"]
    if product is not None:
        prices = prices.join(listings.select(F.col("id").alias("producto_fuente_id")), "producto_fuente_id", "left_semi")
    if branch is not None or city is not None or chain is not None:
        prices = prices.join(branches.select(F.col("id").alias("sucursal_id")), "sucursal_id", "left_semi")
    latest = latest_prices(prices)
    return (
        latest.join(listings.select(F.col("id").alias("producto_fuente_id"), "producto_id", F.col("nombre_original").alias("producto_fuente")), "producto_fuente_id")
        .join(tables["producto"].select(F.col("id").alias("producto_id"), F.col("nombre_normalizado").alias("producto")), "producto_id")
        .join(branches.select(F.col("id").alias("sucursal_id"), F.col("nombre").alias("sucursal"), "direccion", "supermercado_id", "ciudad_id"), "sucursal_id")
        .join(tables["supermercado"].select(F.col("id").alias("supermercado_id"), F.col("nombre").alias("supermercado")), "supermercado_id")
        .join(tables["ciudad"].select(F.col("id").alias("ciudad_id"), F.col("nombre").alias("ciudad")), "ciudad_id")
        .select("id", "producto", "producto_fuente", "sucursal", "direccion", "supermercado", "ciudad", fixed(F.col("precio"), 2).alias("precio"), "moneda", iso_time(F.col("fecha_relevamiento")).alias("fecha_relevamiento"), "disponible", "promocion")
    )


CURRENT_ORDER = ["producto", "supermercado", "sucursal", "id"]


def recency() -> list[Column]:
    return [F.col("fecha_relevamiento").desc(), F.col("id")]


def _of_products(prices: DataFrame, listings: DataFrame, products: DataFrame | list | None) -> DataFrame:
    if products is None:
        return prices
    chosen = restrict(listings.select(F.col("id").alias("producto_fuente_id"), "producto_id"), "producto_id", products)
    return prices.join(chosen.select("producto_fuente_id"), "producto_fuente_id", "left_semi")


def available_prices(prices: DataFrame, listings: DataFrame, source=None, branch=None, products: DataFrame | list | None = None) -> DataFrame:
    """All available rows (not only the newest) of a listing, a branch or some products, newest first. An empty product list gives no rows."""
    chosen = where_given(available(prices), producto_fuente_id=source, sucursal_id=branch)
    return _of_products(chosen, listings, products).orderBy(*recency())


def prices_for_basket(prices: DataFrame, listings: DataFrame, products: DataFrame | list, branches: DataFrame | list | None = None) -> DataFrame:
    """All available rows of the products at the branches (None: everywhere), by branch, newest first. Empty lists give no rows."""
    chosen = restrict(_of_products(available(prices), listings, products), "sucursal_id", branches)
    return chosen.orderBy("sucursal_id", *recency())


def price_history(prices: DataFrame, source, branch=None) -> DataFrame:
    """All rows of a listing (at a branch, or everywhere), unavailable ones too, newest first."""
    return where_given(prices, producto_fuente_id=source, sucursal_id=branch).orderBy(*recency())


def listing_prices(prices: DataFrame, listings: DataFrame, branches: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The newest row of each (listing, branch) with its producto_id, dropped if it is unavailable (no older row takes its place). branches (sucursal_id, one row each, whose other columns are kept) and
    products (producto_id) are applied before the newest rows are picked. Prices meet their listing and lose all but the newest rows in one shuffle by listing, or in none if save_bucketed() stored them with their producto_id."""
    wanted = ["id", "producto_fuente_id", "sucursal_id", "precio", "fecha_relevamiento", "disponible", "created_at"]
    kept = [c for c in branches.columns if c != "sucursal_id"]
    placed = lambda rows: rows.join(branches, "sucursal_id", "inner" if kept else "left_semi")
    if "producto_id" in prices.columns:
        rows = placed(prices.select(*wanted, "producto_id"))
        rows = rows if products is None else rows.join(products.select("producto_id"), "producto_id", "left_semi")
    else:
        listing = listings.select(F.col("id").alias("producto_fuente_id"), "producto_id")
        if products is not None:
            listing = listing.join(products.select("producto_id"), "producto_id", "left_semi")
        rows = placed(prices.select(*wanted)).join(listing, "producto_fuente_id")
    return available(latest_prices(rows, also_by=("producto_id",))).select("sucursal_id", "producto_id", "precio", "fecha_relevamiento", "id", *kept)


def branch_product_prices(prices: DataFrame, listings: DataFrame, branches: DataFrame, products: DataFrame | None = None, by_product: bool = False) -> DataFrame:
    """One current price per (branch, product): of a product's listing_prices() the newest, cheapest, least id. These are dealt by (product, branch), or by product alone, so that what is
    gathered by product then isn't dealt again (for many products, as a few would fill a few tasks); none is dealt if save_bucketed() stored them with their producto_id."""
    current = listing_prices(prices, listings, branches, products)
    if "producto_id" not in prices.columns:
        current = current.repartition("producto_id", *(() if by_product else ("sucursal_id",)))
    best = Window.partitionBy("producto_id", "sucursal_id").orderBy(F.col("fecha_relevamiento").desc(), "precio", "id")
    return current.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "id")


def newest_observations(prices: DataFrame, listings: DataFrame, branches: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """producto_id and observed, the newest observation among its branch_product_prices(). As the newest of a product's listings stands for it, that is the newest of its listing_prices(), which are dealt as one row for each product and task."""
    return listing_prices(prices, listings, branches, products).groupBy("producto_id").agg(F.max("fecha_relevamiento").alias("observed"))
