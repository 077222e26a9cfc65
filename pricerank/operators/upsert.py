"""Writes as new snapshots: keyed upsert, idempotent load, change sets, ingestion."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.functions.text import external_code
from pricerank.sources.schema import NATURAL_KEYS
from pricerank.sources.tables import with_defaults


#: Types of which equal values are the same value.
EXACT = ("tinyint", "smallint", "int", "bigint", "string", "boolean", "date", "timestamp", "timestamp_ntz", "binary")


def latest_by(df: DataFrame, keys: list[str], seq: Column | str, first: bool = False) -> DataFrame:
    """One row per key, that of the greatest (or least) seq; ties by the whole row. The result is dealt by its keys, and keys travel once."""
    # a key of which equal values can differ (doubles, collated texts) is taken from the row
    same = [k for k in keys if df.schema[k].dataType.simpleString() in EXACT or df.schema[k].dataType.typeName() == "decimal"]
    rest = [c for c in df.columns if c not in same] or df.columns
    row = F.struct(F.col(seq) if isinstance(seq, str) else seq, F.struct(*rest).alias("row"))
    best = (F.min if first else F.max)(row)
    found = df.groupBy(*[F.col(k) if k in same else F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("_best"))
    return found.select(*[F.col(f"_best.row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", seq: str | None = None, keep_if_null: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of base overwritten by updates of equal key, nulls included, plus the new ones. Columns in keep_if_null keep their old
    value where the update has none, and take the current time where neither has. Of several updates of a key one wins: the last by seq, a column of
    updates only, or without it the greatest row by its columns in order. Null keys match nothing, so each update with one is a new row."""
    columns = base.columns
    unkeyed = updates.where(F.col(key).isNull()).select(*columns)
    last = latest_by(updates.where(F.col(key).isNotNull()).select(*columns, *([seq] if seq else [])), [key], seq or F.lit(0)).select(*columns)
    return overwritten(base, last.unionByName(unkeyed), key, keep_if_null)


def overwritten(base: DataFrame, updates: DataFrame, key: str = "id", keep_if_null: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """upsert() of updates with one row for each key."""
    columns = base.columns
    b, u = base.select(F.struct(*columns).alias("b"), F.col(key).alias("_b")), updates.select(F.struct(*columns).alias("u"), F.col(key).alias("_u"))

    def merged(c: str) -> Column:
        if c in keep_if_null:
            return F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}"), F.current_timestamp())
        return F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}"))

    return b.join(u, F.col("_b") == F.col("_u"), "full").select(*[merged(c).alias(c) for c in columns])


def get_or_create(base: DataFrame, new: DataFrame, natural_key: tuple[str, ...], resource: str = "", seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(base with the rows whose natural key it lacked, report). Existing rows stay untouched; of new rows with one key the first by seq is created and the
    rest count as found. The report has resource, created, found. Null key parts never match; ids not given come from the key's hash."""
    rows = new if "id" in new.columns else new.withColumn("id", stable_id(*natural_key))
    order = seq or "id"
    ranked = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in natural_key))
    # found rows go first, so that rows are dealt by their key once, and by nothing else where only their number is asked for
    unknown = ranked.join(base.select(*natural_key), list(natural_key), "left_anti").select(*rows.columns)
    without_key = rows.where(" OR ".join(f"{k} IS NULL" for k in natural_key))
    fresh = latest_by(unknown, list(natural_key), order, first=True).unionByName(without_key)
    created = fresh.select(*[c for c in base.columns])
    counted = rows.select(F.lit(0).alias("created")).unionByName(fresh.select(F.lit(1).alias("created")))
    made = F.coalesce(F.sum("created"), F.lit(0)).cast("long")
    report = counted.agg(made.alias("created"), (F.count("*") - 2 * made).alias("found")).select(F.lit(resource).alias("resource"), "created", "found")
    return base.unionByName(created), report


def stable_id(*key: str) -> Column:
    """An id that reruns repeat: the hash of the key's parts."""
    return F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in key])), 256)


def expand_listings(products: DataFrame, chains: DataFrame) -> DataFrame:
    """A listing of every product at every chain: products (id, normalized_name, source_suffix, source_names map of chain name to name), chains
    (id, nombre, prefix). The result is products times chains."""
    both = products.select(F.col("id").alias("producto_id"), "normalized_name", "source_suffix", "source_names").crossJoin(chains.select(F.col("id").alias("supermercado_id"), F.col("nombre").alias("chain"), "prefix"))
    return both.select("producto_id", "supermercado_id", F.coalesce(F.try_element_at("source_names", "chain"), "normalized_name").alias("nombre_original"), external_code(F.col("prefix"), F.col("source_suffix")).alias("codigo_externo"))


def expand_prices(matrix: DataFrame, listings: DataFrame, branches: DataFrame) -> DataFrame:
    """matrix (sucursal_id, prices map of product id to amount) -> sucursal_id, producto_fuente_id, precio, through the listing of the branch's chain."""
    cells = matrix.select("sucursal_id", F.explode("prices").alias("producto_id", "precio"))
    chain = branches.select(F.col("id").alias("sucursal_id"), "supermercado_id")
    return cells.join(chain, "sucursal_id").join(listings.select(F.col("id").alias("producto_fuente_id"), "producto_id", "supermercado_id"), ["producto_id", "supermercado_id"]).select("sucursal_id", "producto_fuente_id", "precio")


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Sets the columns that changes (key, seq, any of base's columns) holds. Each column takes the last change of its key that
    is not null, so that flags change independently; unknown keys change nothing."""
    columns = [c for c in changes.columns if c not in (key, seq)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(seq), F.col(c).alias("value")))).alias(f"_{c}") for c in columns]
    final = changes.groupBy(F.col(key).alias("_key")).agg(*last)
    joined = base.join(final, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}.value"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def activate(base: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    return apply_changes(base, ids.select("id", F.lit(0).alias("seq"), F.lit(value).alias("activo")))


def mark_prices(base: DataFrame, ids: DataFrame, available: bool | None = None, promotion: bool | None = None) -> DataFrame:
    flags = [F.lit(v).cast("boolean").alias(c) for c, v in (("disponible", available), ("promocion", promotion))]
    return apply_changes(base, ids.select("id", F.lit(0).alias("seq"), *flags))


def ingest(tables: Mapping[str, DataFrame], listings: DataFrame, prices: DataFrame, seq: str = "seq") -> tuple[dict[str, DataFrame], DataFrame]:
    """Listings, then prices, upserted with defaults after the checks; (new tables, rejected rows: table, row_key, rule). A price whose listing
    is rejected is rejected too, as its reference fails. Of rows with one id the last by seq counts, the others are no part of the batch. Of several rows
    with one unique key that pass the other checks only one is taken: the row that has the key in the base, or else the least id. A row whose key stands in the base under another id is rejected,
    unless the batch gives that other row another key by an update that is taken without any base row giving way. So no result has a key twice if the base had none."""
    out, rejected = dict(tables), None
    for table, rows in (("producto_fuente", listings), ("precio", prices)):
        out[table], reasons = ingest_rows(out, table, rows, seq)
        rejected = reasons if rejected is None else rejected.unionByName(reasons)
    return out, rejected


def ingest_rows(tables: Mapping[str, DataFrame], table: str, rows: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """ingest() of one table: (the table with the rows that pass all checks, the reasons of the others). Each check adds to a list of broken rules of the row, so that the
    batch is read along one chain of joins."""
    from pricerank.operators.quality import broken_rules, rules_of
    from pricerank.sources.schema import FOREIGN_KEYS, UNIQUE_KEYS

    base = tables[table]
    full = with_defaults(rows, table)
    missing = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in full.columns]
    full = full.select("*", *missing).select(*base.columns, seq)
    marked = full.withColumn("_rules", F.array().cast("array<string>"))
    also = lambda name, broken: F.concat("_rules", F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
    for column, parent in FOREIGN_KEYS.get(table, {}).items():
        ids = tables[parent].select(F.col("id").alias("_id"))
        ids = ids.union(full.select("id")) if parent == table else ids
        # dealt anew after the grouping, as adaptive execution splits a key with many rows only between two plain dealings
        ids = ids.groupBy(F.col("_id").alias("_each")).agg(F.max("_id").alias("_id")).select("_id", F.lit(True).alias("_there"))
        marked = marked.join(ids, F.col(column) == F.col("_id"), "left").withColumn("_rules", also(f"reference:{column}", F.col(column).isNotNull() & F.col("_there").isNull())).drop("_id", "_there")
    # references are told of all rows first, so that the last row of an id stays where it is dealt to meet its base row
    told = lambda rows: rows.withColumn("_rules", F.concat(broken_rules(rules_of(full, table)), "_rules"))
    last, unkeyed = told(latest_by(marked.where("id IS NOT NULL"), ["id"], seq)), told(marked.where("id IS NULL"))
    keys = [key for key in UNIQUE_KEYS[table] if key != ("id",) and set(key) <= set(base.columns)]
    if keys:
        last = _with_taken_keys(base, last, keys)
    # a row without an id breaks a rule by that
    reasons = last.unionByName(unkeyed).select(F.lit(table).alias("table"), F.col("id").cast("string").alias("row_key"), F.explode("_rules").alias("rule"))
    taken = last.where(F.size("_rules") == 0).drop("_rules")
    return upsert(base, taken, seq=seq) if keys else overwritten(base, taken.select(*base.columns)), reasons


def _with_taken_keys(base: DataFrame, rows: DataFrame, keys: list[tuple[str, ...]]) -> DataFrame:
    """rows with `unique:...` added to _rules for each key that a row may not take. A base row gives up its key only to an update that is certain to be taken: it passes all
    checks, no other base row has its new key, and it comes before all other rows of the batch with that key."""
    spread = sorted({c for key in keys for c in key})
    old = base.select(F.col("id").alias("_id"), F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in spread])
    rows = rows.join(old, F.col("id") == F.col("_id"), "left").withColumn("_passes", F.size("_rules") == 0)
    every = lambda terms: reduce(lambda x, y: x & y, terms)
    whole = {key: every([F.col(c).isNotNull() for c in key]) for key in keys}
    own = {key: F.coalesce(F.col("_known") & every([F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in key]), F.lit(False)) for key in keys}
    certain = F.col("_passes")
    for k, key in enumerate(keys):
        holders = base.dropna(subset=list(key)).groupBy(*[F.col(c).alias(f"_key_{c}") for c in key]).agg(F.count("*").alias(f"_holders{k}"))
        equal = every([F.col(c) == F.col(f"_key_{c}") for c in key])
        rows = rows.join(holders, equal, "left").drop(*[f"_key_{c}" for c in key])
        # rows without a whole key take no part, so they are dealt by their id
        claims = Window.partitionBy(*key, F.when(~whole[key], F.col("id")))
        rows = rows.withColumn(f"_first{k}", F.min(F.when(F.col("_passes"), F.struct((~own[key]).alias("other"), F.col("id")))).over(claims))
        rows = rows.withColumn(f"_others{k}", F.coalesce(f"_holders{k}", F.lit(0)) - own[key].cast("int"))
        certain = certain & (~whole[key] | (F.col(f"_others{k}") == 0) & (F.col(f"_first{k}.id") == F.col("id")))
    rows = rows.withColumn("_certain", certain)
    for k, key in enumerate(keys):
        moved = rows.where(F.col("_certain") & F.col("_known") & ~own[key]).dropna(subset=[f"_old_{c}" for c in key])
        freed = moved.groupBy(*[F.col(f"_old_{c}").alias(f"_key_{c}") for c in key]).agg(F.count("*").alias(f"_freed{k}"))
        rows = rows.join(freed, every([F.col(c) == F.col(f"_key_{c}") for c in key]), "left").drop(*[f"_key_{c}" for c in key])
        taken = (F.col(f"_others{k}") > F.coalesce(f"_freed{k}", F.lit(0))) | (F.col(f"_first{k}.id") != F.col("id"))
        broken = whole[key] & F.col("_passes") & taken
        rows = rows.withColumn("_rules", F.when(F.coalesce(broken, F.lit(False)), F.array_append("_rules", F.lit("unique:" + ",".join(key)))).otherwise(F.col("_rules")))
    extra = [f"_{x}{k}" for k in range(len(keys)) for x in ("holders", "first", "others", "freed")]
    return rows.drop("_id", "_known", "_passes", "_certain", *[f"_old_{c}" for c in spread], *extra)


def load_all(base: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """get_or_create() for every table of `new` by its natural key, and the reports of all."""
    out, report = dict(base), None
    for table, rows in new.items():
        out[table], part = get_or_create(base[table], rows, NATURAL_KEYS[table], table)
        report = part if report is None else report.unionByName(part)
    return out, report
