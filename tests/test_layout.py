import random
import re

import pytest
from pyspark.sql import functions as F

from pricerank.functions.text import contains
from pricerank.operators import observed, pages, quality, rows, trigrams
from pricerank.operators.upsert import get_or_create
from pricerank.plans import ranking
from pricerank.sources import layout
from pricerank.sources.scratch import stored
from tests import seed

DEFAULT = ("0.6", "0.3", "0.1")


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in seed.tables(spark).items()}


def test_bucketed_prices_are_not_dealt_anew(spark, t):
    tables = {k: stored(v) for k, v in t.items()}
    b, lines = seed.baskets(spark, ("A", "CR", *DEFAULT), ("B", "RT", *DEFAULT)), seed.lines(spark, ("A", seed.all_of()), ("B", {"COCA-225": 2}))
    bucketed = layout.save_bucketed(tables["precio"], tables["producto_fuente"], "prices_in_buckets", 4)
    try:
        plain, quick = (ranking.rank_baskets({**tables, "precio": p}, b, lines) for p in (tables["precio"], bucketed))
        assert sorted(plain.collect()) == sorted(quick.collect()) and quick.count() == 8
        missing = lambda p: sorted(map(repr, ranking.incomplete_branches({**tables, "precio": p.where("id NOT LIKE '%LAV%'")}, b, lines).collect()))
        assert missing(tables["precio"]) == missing(bucketed) and missing(bucketed)
        dealt = lambda df: len(re.findall(r"Exchange hashpartitioning\((?:producto_id#\d+L?, )?sucursal_id", df._jdf.queryExecution().executedPlan().toString()))
        assert dealt(plain) > 0 and dealt(quick) == 0 and "Bucketed: true" in quick._jdf.queryExecution().executedPlan().toString()
    finally:
        layout.drop_table(spark, "prices_in_buckets")


def test_searches_by_index_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = [None, "", "a", "100% Café_x", "a\\b", "ÑANDÚ con leche", *("".join(rng.choices("abcñ %_\\", k=rng.randrange(1, 12))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    asked = ["", "%", "_", "a", "B", "ab", "abc", "abca", "ñ", "a%b", "a_c%ñ", r"\%", r"\_", r"a\\", "c\\", r"\a", "ñandú CON", "%%", "___", "leche%", *("".join(rng.choices("abcñ%_\\", k=rng.randrange(1, 5))) for _ in range(60))]
    queries = spark.createDataFrame([*enumerate(asked), (900, None)], "query_id int, query string")
    got = {(r.query_id, r.id) for r in trigrams.search_many(df, queries, "name").collect()}
    flags = df.select("id", *[contains(F.col("name"), q).alias(f"q{k}") for k, q in enumerate(asked)]).collect()
    want = {(k, r.id) for r in flags for k in range(len(asked)) if r[f"q{k}"]}
    assert got == want and len(want) > 1_000
    index = stored(trigrams.postings(df, "name"))
    again = trigrams.search_many(df, queries.where("query_id = 8"), "name", index=index)
    assert {(r.query_id, r.id) for r in again.collect()} == {p for p in want if p[0] == 8}
    assert trigrams.search_many(df.limit(0), queries, "name").count() == 0 == trigrams.search_many(df, queries.limit(0), "name").count()


def test_searches_of_copies_are_counted_once(spark):
    """4,000 copies of each of 12 names and of 9 queries, of which each pair would be 1.7 billion rows."""
    names, asked = ["", "red bolt", "Red Bolt", "blue gear", "old ring", "a%b", "ñandú", "hot plate", "cold plate", "plate", "bolt", None], ["", "bolt", "e_", "PLATE", r"\%", "d%o", "zz", "ñ", None]
    copied = lambda values, name: spark.range(4_000 * len(values)).select(F.col("id").alias("n"), F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % len(values) + 1).cast("int")).alias(name))
    got = {r.query_id: (r.n_hits, r.first_id) for r in trigrams.count_many(copied(names, "name"), copied(asked, "query").withColumnRenamed("n", "query_id"), "name", "n").collect()}
    few = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    hits = {k: [r.id for r in few.where(contains(F.col("name"), q)).collect()] for k, q in enumerate(asked) if q is not None}
    assert got == {k: (4_000 * len(hits[k % len(asked)]), min(hits[k % len(asked)])) for k in range(4_000 * len(asked)) if hits.get(k % len(asked))}
    assert len(got) == 4_000 * 7


def test_lookups_read_a_fraction(spark, tmp_path):
    df = spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.md5(F.col("id").cast("string")).alias("code"), F.col("id").alias("v"))
    layout.save_for_lookups(df, f"{tmp_path}/t", ["id", "code"], distinct=50_000, group_bytes=1 << 20)
    table = spark.read.parquet(f"{tmp_path}/t")

    def scanned(found):
        got = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        while plan.nodeName() != "Scan parquet ":
            plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().head()
        return got, plan.metrics().get("numOutputRows").get().value()

    wanted = df.where("v % 40000 = 7").collect()
    for key in ("id", "code"):  # the files are sorted by the first, the second has its Bloom filters only
        got, n = scanned(layout.lookup_few(table, [r[key] for r in wanted] + [None, "no such key"], key))
        assert sorted(got) == sorted(wanted) and n < 300_000
    assert layout.lookup_few(table, []).count() == 0
    many = [r.id for r in df.where("v < 450").collect()]
    assert layout.lookup_few(table, many[:150]).count() == 150 and layout.lookup_few(table, many).count() == 450


def test_observed_counts_are_those_of_separate_passes(spark, t, tmp_path):
    odd = t["precio"].withColumns({"precio": F.when(F.col("sucursal_id") == "rada", -1).otherwise(F.col("precio")).cast("decimal(14,2)"), "moneda": F.when(F.col("sucursal_id") == "centro", " ").otherwise("ARS")})
    counts = observed.observed_write(odd, "precio", f"{tmp_path}/prices")
    listed = {r.rule: r["count"] for r in quality.row_violations(odd, "precio").groupBy("rule").count().collect()}
    assert counts == {"rows": 20, **listed} and len(listed) == 3 and spark.read.parquet(f"{tmp_path}/prices").count() == 20
    new = spark.createDataFrame([("n1", "Nestlé"), ("n2", "Nestlé"), ("n3", "Sancor"), ("n4", None), ("n5", None)], "id string, nombre string").withColumns({"descripcion": F.lit(None).cast("string"), "activo": F.lit(True)})
    merged, report = get_or_create(t["marca"], new, ("nombre",))
    assert observed.observed_get_or_create(t["marca"], new, ("nombre",), f"{tmp_path}/brands") == {"created": 3, "found": 2} == report.select("created", "found").first().asDict()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/brands").collect()) == sorted(r.id for r in merged.collect())


def test_collations(spark):
    df = spark.createDataFrame([(1, "Zapallo"), (2, "ñoqui"), (3, "Ácido"), (4, "acelga"), (5, "Nuez"), (6, "ácido"), (7, "nabo"), (8, "oliva")], "id int, nombre string")
    ids = lambda **more: [r.id for r in rows.listing(df, **more).collect()]
    assert ids() == [5, 1, 4, 7, 8, 3, 6, 2]  # code points: capitals, small letters, accents
    assert ids(collation="es") == [4, 6, 3, 7, 5, 2, 8, 1] and ids(collation="UNICODE_CI")[:3] == [4, 3, 6]
    names = df.selectExpr("1 AS basket_id", "id AS branch_id", "nombre AS supermarket_name", "'x' AS branch_name", "1D AS total_cost", "1D AS distance_km", "0D AS saving")
    ranked = lambda **more: [r.branch_id for r in ranking.rank_alternatives(names, (1, 0, 0), **more).orderBy("position").collect()]
    assert ranked() == ids() and ranked(collation="es") == ids(collation="es")
    assert [r.id for r in pages.number_rows(rows.listing(df, collation="es").withColumn("m", F.monotonically_increasing_id()), ["m"]).orderBy("number").collect()] == ids(collation="es")
