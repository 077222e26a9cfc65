"""Checks that a database would enforce row by row, as jobs over whole tables.

Violations have table, row_key, rule, detail. A CHECK passes on null, so rules test that an expression is false, not that it isn't true.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricerank.functions.geo import valid_point
from pricerank.functions.text import strip
from pricerank.sources.schema import FOREIGN_KEYS, LIMITS, SCHEMAS, UNIQUE_KEYS

#: Texts that must hold something besides white space.
NOT_BLANK = {"provincia": ["nombre"], "ciudad": ["nombre"], "supermercado": ["nombre"], "sucursal": ["nombre", "direccion"], "categoria_producto": ["nombre"], "marca": ["nombre"], "producto": ["nombre_normalizado"], "producto_fuente": ["nombre_original"], "precio": ["moneda"]}
MOST_LINES = 100


def table_rules(table: str) -> dict[str, Column]:
    """Rule -> whether the row breaks it: nulls, lengths, checks and blank texts."""
    limits, rules = LIMITS[table], {}
    for column in SCHEMAS[table].names:
        if column not in limits.nullable:
            rules[f"not_null:{column}"] = F.col(column).isNull()
    for column, most in limits.lengths.items():
        rules[f"length:{column}"] = F.char_length(column) > most
    if table in ("ciudad", "sucursal"):
        rules["check:coordinates"] = ~valid_point(F.col("latitud"), F.col("longitud"))
    if table == "producto":
        rules["check:contenido_neto"] = F.col("contenido_neto") <= 0
    if table == "producto_fuente":
        rules["check:confianza_match"] = ~F.col("confianza_match").between(0, 1)
    if table == "precio":
        rules["check:precio"] = F.col("precio") < 0
        rules["check:moneda"] = F.char_length(F.trim("moneda")) == 0
    for column in NOT_BLANK[table]:
        rules[f"blank:{column}"] = strip(F.col(column)) == ""
    return {name: F.coalesce(broken, F.lit(False)) for name, broken in rules.items()}


def rules_of(df: DataFrame, table: str) -> dict[str, Column]:
    """The table's rules over those of its columns that the frame has; absent columns are told by missing_columns()."""
    here = lambda name: {"latitud", "longitud"} <= set(df.columns) if name == "check:coordinates" else name.split(":")[1] in df.columns
    return {name: broken for name, broken in table_rules(table).items() if here(name)}


def missing_columns(df: DataFrame, table: str) -> DataFrame:
    """A violation (row_key null) for each column that must hold a value, or is part of a key, and that the frame lacks."""
    needed = [c for c in SCHEMAS[table].names if c not in LIMITS[table].nullable or c in FOREIGN_KEYS.get(table, {}) or any(c in key for key in UNIQUE_KEYS[table])]
    rows = [(table, None, f"missing:{c}", None) for c in needed if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "table string, row_key string, rule string, detail string")


def broken_rules(rules: Mapping[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda name: name.isNotNull())


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with the array column `rules`)."""
    marked = df.withColumn("rules", broken_rules(rules))
    return marked.where(F.size("rules") == 0).drop("rules"), marked.where(F.size("rules") > 0)


def row_violations(df: DataFrame, table: str) -> DataFrame:
    found = df.select(F.col("id").cast("string").alias("row_key"), F.explode(broken_rules(rules_of(df, table))).alias("rule"))
    return found.select(F.lit(table).alias("table"), "row_key", "rule", F.lit(None).cast("string").alias("detail"))


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """A row for each key that repeats; keys with a null part never collide. detail is the number of rows."""
    parts = []
    for key in UNIQUE_KEYS[table]:
        if not set(key) <= set(df.columns):
            continue
        counted = df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(counted.select(F.lit(table).alias("table"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row_key"), F.lit("unique:" + ",".join(key)).alias("rule"), F.col("n").cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "table string, row_key string, rule string, detail string")


def reference_violations(tables: Mapping[str, DataFrame], table: str) -> DataFrame | None:
    """Rows whose non-null foreign key has no parent; detail is the key."""
    parts = []
    for column, parent in FOREIGN_KEYS.get(table, {}).items():
        if column not in tables[table].columns:
            continue
        rows = tables[table].where(F.col(column).isNotNull()).select(F.col("id").cast("string").alias("row_key"), F.col(column).alias("_key"))
        orphans = rows.join(tables[parent].select(F.col("id").alias("_key")), "_key", "left_anti")
        parts.append(orphans.select(F.lit(table).alias("table"), "row_key", F.lit(f"reference:{column}").alias("rule"), F.col("_key").cast("string").alias("detail")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def violations(tables: Mapping[str, DataFrame], names: list[str] | None = None, families: tuple[str, ...] = ("row", "unique", "reference")) -> DataFrame:
    """Violations of the tables (all, or those named). The family "row" includes missing_columns()."""
    parts = []
    for table in names or list(tables):
        if "row" in families:
            parts += [missing_columns(tables[table], table), row_violations(tables[table], table)]
        if "unique" in families:
            parts.append(unique_violations(tables[table], table))
        if "reference" in families:
            parts.append(reference_violations(tables, table))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def chain_mismatches(prices: DataFrame, listings: DataFrame, branches: DataFrame) -> DataFrame:
    """Prices whose listing belongs to another chain than their branch. Reported only: nothing drops them."""
    listing, branch = listings.select(F.col("id").alias("producto_fuente_id"), F.col("supermercado_id").alias("listing_chain")), branches.select(F.col("id").alias("sucursal_id"), F.col("supermercado_id").alias("branch_chain"))
    return prices.select("id", "producto_fuente_id", "sucursal_id").join(listing, "producto_fuente_id").join(branch, "sucursal_id").where("listing_chain <> branch_chain").select("id", "listing_chain", "branch_chain")


def currency_mix(prices: DataFrame) -> DataFrame:
    """Rows and branches by currency; totals add prices of all currencies alike."""
    return prices.groupBy("moneda").agg(F.count("*").alias("n_prices"), F.countDistinct("sucursal_id").alias("n_branches"))


def duplicate_products(lines: DataFrame) -> DataFrame:
    return lines.groupBy("basket_id", "product_id").agg(F.count("*").alias("n")).where("n > 1")


def basket_checks(baskets: DataFrame, lines: DataFrame, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Per basket: n_lines and flags bad_size (not 1 to 100 lines), bad_quantity (null, <= 0, or beyond 12 digits with 3 decimals), duplicate_product, bad_weights
    (null, negative, or a sum other than exactly 1). also: further flags, by conditions of which a line of the basket fulfils one (never null)."""
    also = dict(also or {})
    # one row per line first: a product that repeats in a basket shows as a count above 1, without collecting the lines
    per_product = lines.groupBy("basket_id", "product_id").agg(F.count("*").alias("n"), F.max(bad_quantity("quantity").cast("int")).alias("bad"), *[F.max(flag).alias(name) for name, flag in also.items()])
    per_basket = per_product.groupBy("basket_id").agg(F.sum("n").alias("n"), F.max(F.coalesce("bad", F.lit(1))).alias("bad"), F.max((F.col("n") > 1).cast("int")).alias("twice"), *[F.max(name).alias(name) for name in also])
    n = F.coalesce("n", F.lit(0)).cast("long")
    flags = baskets.join(per_basket, "basket_id", "left")
    return flags.select(*baskets.columns, n.alias("n_lines"), (~n.between(1, MOST_LINES)).alias("bad_size"), (F.coalesce("bad", F.lit(0)) == 1).alias("bad_quantity"), (F.coalesce("twice", F.lit(0)) == 1).alias("duplicate_product"), bad_weights("w_price", "w_distance", "w_saving").alias("bad_weights"), *[F.coalesce(name, F.lit(False)).alias(name) for name in also])


def bad_quantity(column: str) -> Column:
    """Null, not above 0, or beyond 12 digits with 3 decimals."""
    q, fits = F.col(column), F.col(column).try_cast("decimal(12,3)")
    return F.coalesce(q.isNull() | (q <= 0) | fits.isNull() | (q != fits), F.lit(True))


def bad_weights(*weights: str) -> Column:
    """Compared as decimals, so that 0.6 + 0.3 + 0.1 is 1."""
    w = [F.col(c).cast("decimal(18,8)") for c in weights]
    fine = reduce(lambda a, b: a & b, [x >= 0 for x in w]) & (reduce(lambda a, b: a + b, w) == F.lit(1).cast("decimal(18,8)"))
    return ~F.coalesce(fine, F.lit(False))


def result_violations(ranking: DataFrame) -> DataFrame:
    """Rows of a ranking that break its promises: negative cost, distance, saving or missing count, blank names, score outside 0 to 1, position below 1."""
    rules = {
        "total_cost": F.col("total_cost") < 0,
        "distance_km": F.col("distance_km") < 0,
        "saving": F.col("saving") < 0,
        "missing_products_count": F.col("missing_products_count") < 0,
        "supermarket_name": strip(F.col("supermarket_name")) == "",
        "branch_name": strip(F.col("branch_name")) == "",
        "score": ~F.col("score").between(0, 1),
        "position": F.col("position") < 1,
    }
    marked = ranking.select("basket_id", "branch_id", F.explode(broken_rules({k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})).alias("rule"))
    return marked
