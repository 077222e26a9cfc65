"""Reading and writing the nine tables, and the adapter from the order tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricerank.sources.schema import DEFAULTS, DOMAIN, SCHEMAS
from pricerank.sources.scratch import dealt

Tables = Mapping[str, DataFrame]

#: The adapter as SQL that Spark and DuckDB both run; order matters, as later ones use earlier ones.
ADAPTER = {
    "provincia": "SELECT r_regionkey AS id, r_name AS nombre FROM region",
    "ciudad": "SELECT n_nationkey AS id, n_regionkey AS provincia_id, n_name AS nombre, CAST(-55 + n_nationkey * 1.7 AS DECIMAL(9,6)) AS latitud, CAST(-73 + ((n_nationkey * 7) % 25) * 0.9 AS DECIMAL(9,6)) AS longitud FROM nation",
    "supermercado": "SELECT DISTINCT n_nationkey % 4 AS id, concat('CHAIN_', CAST(n_nationkey % 4 AS STRING)) AS nombre, true AS activo FROM nation",
    "sucursal": "SELECT n_nationkey AS id, n_nationkey % 4 AS supermercado_id, n_nationkey AS ciudad_id, concat('BR_', n_name) AS nombre, n_name AS direccion, CAST(-55 + n_nationkey * 1.7 + 0.05 AS DECIMAL(9,6)) AS latitud, CAST(-73 + ((n_nationkey * 7) % 25) * 0.9 + 0.05 AS DECIMAL(9,6)) AS longitud, n_nationkey % 12 <> 11 AS activo FROM nation",
    "marca": "SELECT DISTINCT p_brand AS id, p_brand AS nombre, true AS activo FROM part",
    "categoria_producto": "SELECT DISTINCT p_type AS id, p_type AS nombre, true AS activo FROM part",
    "producto": "SELECT p_partkey AS id, p_type AS categoria_id, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS marca_id, p_name AS nombre_normalizado, CAST(NULL AS STRING) AS unidad_medida, CAST(p_size AS DECIMAL(12,3)) AS contenido_neto, concat('P-', CAST(p_partkey AS STRING)) AS codigo_interno, p_partkey % 40 <> 0 AS activo FROM part",
    "producto_fuente": "SELECT DISTINCT l_partkey * 4 + s_nationkey % 4 AS id, l_partkey AS producto_id, s_nationkey % 4 AS supermercado_id, concat('EXT-', CAST(l_partkey AS STRING)) AS codigo_externo, concat('Part ', CAST(l_partkey AS STRING)) AS nombre_original, true AS activo FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "precio": "SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING)) AS id, l_partkey * 4 + s_nationkey % 4 AS producto_fuente_id, s_nationkey AS sucursal_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS precio, 'ARS' AS moneda, CAST(l_shipdate AS TIMESTAMP) AS fecha_relevamiento, l_returnflag <> 'R' AS disponible, l_discount >= 0.05 AS promocion, CAST(l_shipdate AS TIMESTAMP) AS created_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "baskets": "SELECT o_orderkey AS basket_id, c_nationkey AS city_id, CAST(0.6 AS DECIMAL(9,8)) AS w_price, CAST(0.3 AS DECIMAL(9,8)) AS w_distance, CAST(0.1 AS DECIMAL(9,8)) AS w_saving FROM orders JOIN customer ON o_custkey = c_custkey",
    "basket_lines": "SELECT l_orderkey AS basket_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS INT) AS line_no, l_partkey AS product_id, CAST(sum(l_quantity) AS DECIMAL(12,3)) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey",
    "raw_lines": "SELECT l_orderkey AS basket_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(12,3)) AS quantity FROM lineitem",
}
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine tables as Parquet under a folder, read by their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def save(df: DataFrame, path: str) -> None:
    """A new snapshot; the path must not exist, so a table is never overwritten while it is read."""
    df.write.mode("errorifexists").parquet(path)


def adapted(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the price model out of the order tables (only those named, if any are). Times are read as UTC, which the session is set to."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sources = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}
    # the lines of an order are put together, numbered and checked where one dealing by order brings them
    given = {"basket_lines": {"lineitem": dealt(sources["lineitem"], "l_orderkey")}}
    found = {}
    for name, sql in ADAPTER.items():
        if not names or name in names:
            used = {x: given.get(name, {}).get(x, sources[x]) for x in re.findall(r"(?:FROM|JOIN) (\w+)", sql)}
            found[name] = spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **used)
    return found


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Missing and null columns take the table's defaults; created_at the time of the batch."""
    for column, default in DEFAULTS.get(table, {}).items():
        value = F.current_timestamp() if default is None else F.lit(default)
        df = df.withColumn(column, F.coalesce(F.col(column), value) if column in df.columns else value)
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table in order, null where the frame has none; types stay as they are."""
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])


def to_domain(df: DataFrame, table: str) -> DataFrame:
    return df.withColumnsRenamed(DOMAIN[table])


def to_storage(df: DataFrame, table: str) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in DOMAIN[table].items()})
