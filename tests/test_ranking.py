import os
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricerank.operators.quality import basket_checks, result_violations
from pricerank.plans import ranking
from pricerank.queries import QUERIES
from pricerank.sources.scratch import stored
from tests import seed

DEFAULT = ("0.6", "0.3", "0.1")
SMALLEST = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def t(spark):
    tables = {k: v.cache() for k, v in seed.tables(spark).items()}
    return tables


def ranked(spark, t, baskets, lines):
    found = ranking.rank_baskets(t, seed.baskets(spark, *baskets), seed.lines(spark, *lines)).orderBy("basket_id", "posicion").collect()
    return {b: [(r.sucursal_id, r.total, r.distancia_km, r.ahorro, r.puntaje) for r in found if r.basket_id == b] for b in {r.basket_id for r in found}}


def test_known_rankings(spark, t):
    found = ranked(spark, t, [("A", "CR", *DEFAULT), ("B", "RT", *DEFAULT), ("C", "CR", *DEFAULT), ("D", "RT", "0", "1", "0")], [("A", seed.all_of()), ("B", seed.all_of()), ("C", {"COCA-225": 2, "LECHE-001": 1.5}), ("D", seed.all_of())])
    assert found["A"] == [("chango", "10020.00", "2.03", "660.00", "0.9616"), ("carrefour", "10100.00", "1.60", "580.00", "0.8953"), ("centro", "10250.00", "1.13", "430.00", "0.7561"), ("rada", "10680.00", "8.14", "0.00", "0.0000")]
    assert found["B"] == [("carrefour", "10100.00", "6.71", "580.00", "0.7146"), ("chango", "10020.00", "9.93", "660.00", "0.7000"), ("centro", "10250.00", "8.91", "430.00", "0.4875"), ("rada", "10680.00", "0.22", "0.00", "0.3000")]
    assert found["C"] == [("chango", "7130.00", "2.03", "490.00", "0.9616"), ("carrefour", "7350.00", "1.60", "270.00", "0.6659"), ("centro", "7375.00", "1.13", "245.00", "0.6500"), ("rada", "7620.00", "8.14", "0.00", "0.0000")]
    assert [(x[0], x[4]) for x in found["D"]] == [("rada", "1.0000"), ("carrefour", "0.3315"), ("centro", "0.1048"), ("chango", "0.0000")]


def test_cheaper_alternative_first(spark):
    df = spark.createDataFrame([("b", "1", "A", "Centro", 120.0, 1.0, 0.0), ("b", "2", "B", "Norte", 100.0, 5.0, 20.0)], "basket_id string, branch_id string, supermarket_name string, branch_name string, total_cost double, distance_km double, saving double")
    out = {r.branch_id: (r.position, r.score) for r in ranking.rank_alternatives(df, (1, 0, 0)).collect()}
    assert out == {"2": (1, 1.0), "1": (2, 0.0)}
    assert ranking.rank_alternatives(df.limit(0), (1, 0, 0)).count() == 0


def test_ties_and_single_candidates(spark):
    schema = "basket_id string, branch_id string, supermarket_name string, branch_name string, total_cost double, distance_km double, saving double, missing_products_count int"
    df = spark.createDataFrame([("one", "1", "A", "x", 5.0, 2.0, 0.0, 0), ("tie", "3", "B", "x", 5.0, 2.0, 0.0, 0), ("tie", "2", "A", "y", 5.0, 2.0, 0.0, 0), ("tie", "1", "A", "x", 5.0, 2.0, 0.0, 0)], schema)
    out = ranking.rank_alternatives(df, (0.6, 0.3, 0.1))
    assert [(r.basket_id, r.branch_id, r.position, round(r.score, 9)) for r in out.orderBy("basket_id", "position").collect()] == [("one", "1", 1, 1.0), ("tie", "1", 1, 1.0), ("tie", "2", 2, 1.0), ("tie", "3", 3, 1.0)]
    assert result_violations(out.withColumn("score", F.least("score", F.lit(1.0)))).count() == 0
    assert {r.rule for r in result_violations(out.withColumn("total_cost", -F.col("total_cost"))).collect()} == {"total_cost"}


def test_newest_price_decides_even_if_unavailable(spark, t):
    newer = t["precio"].where("sucursal_id = 'chango' AND producto_fuente_id = 'CHA-COCA-225'").withColumns({"id": F.lit("new"), "fecha_relevamiento": F.lit("2026-06-02 10:00:00").cast("timestamp"), "disponible": F.lit(False)})
    tables = {**t, "precio": t["precio"].unionByName(newer)}
    b, lines = seed.baskets(spark, ("A", "CR", *DEFAULT)), seed.lines(spark, ("A", seed.all_of()))
    assert {r.sucursal_id for r in ranking.rank_baskets(tables, b, lines).collect()} == {"centro", "carrefour", "rada"}
    missing = ranking.incomplete_branches(tables, b, lines).collect()
    assert [(r.sucursal_id, r.n_missing, [x.product_id for x in r.productos_faltantes]) for r in missing] == [("chango", 1, ["COCA-225"])]


def test_two_listings_of_one_product_count_once(spark, t):
    listing = t["producto_fuente"].where("id = 'LA-COCA-225'").withColumns({"id": F.lit("LA-X"), "codigo_externo": F.lit("LA-X")})
    price = t["precio"].where("sucursal_id = 'centro' AND producto_fuente_id = 'LA-COCA-225'").withColumns({"id": F.lit("x"), "producto_fuente_id": F.lit("LA-X"), "precio": F.lit(100).cast("decimal(14,2)")})
    tables = {**t, "producto_fuente": t["producto_fuente"].unionByName(listing), "precio": t["precio"].unionByName(price)}
    found = ranked(spark, tables, [("A", "CR", *DEFAULT)], [("A", seed.all_of())])
    assert dict((x[0], x[1]) for x in found["A"])["centro"] == "7750.00"  # the cheaper of two equally new ones


def test_status(spark, t):
    cities = t["ciudad"].unionByName(seed.rows(spark, "ciudad", [{"id": "NO", "provincia_id": "CH", "nombre": "Nowhere"}]))
    tables = {**t, "ciudad": cities}
    b = seed.baskets(spark, ("ok", "CR", *DEFAULT), ("far", "XX", *DEFAULT), ("lost", "NO", *DEFAULT), ("odd", "CR", *DEFAULT), ("none", "CR", *DEFAULT), ("zero", "CR", *DEFAULT), ("sum", "CR", "0.6", "0.3", "0.09"), ("twice", "CR", *DEFAULT), ("many", "CR", *DEFAULT))
    lines = seed.lines(spark, ("ok", seed.all_of()), ("far", seed.all_of()), ("lost", seed.all_of()), ("odd", {"COCA-225": 1, "GHOST": 1}), ("zero", {"COCA-225": 0}), ("sum", seed.all_of()), ("twice", {"COCA-225": 1}), ("twice", {"COCA-225": 2}), ("many", {f"p{k}": 1 for k in range(101)}))
    found = {r.basket_id: r.status for r in ranking.basket_status(tables, b, lines).collect()}
    assert found == {"ok": "OK", "far": "CITY_NOT_FOUND", "lost": "CITY_WITHOUT_COORDINATES", "odd": "PRODUCT_NOT_FOUND", "none": "INVALID_BASKET", "zero": "INVALID_BASKET", "sum": "INVALID_WEIGHTS", "twice": "INVALID_BASKET", "many": "INVALID_BASKET"}
    closed = {**tables, "sucursal": tables["sucursal"].withColumn("activo", F.lit(False))}
    assert {r.status for r in ranking.basket_status(closed, b.where("basket_id = 'ok'"), lines).collect()} == {"NO_ACTIVE_BRANCHES"}
    assert ranking.rank_baskets(closed, b, lines).count() == 0
    assert basket_checks(b, lines).where("duplicate_product").count() == 1


def test_every_branch_is_ranked_or_incomplete(spark, t):
    b, lines = seed.baskets(spark, ("A", "CR", *DEFAULT), ("B", "RT", *DEFAULT)), seed.lines(spark, ("A", seed.all_of()), ("B", {"COCA-225": 1}))
    tables = {**t, "precio": t["precio"].where("NOT (sucursal_id = 'rada' AND producto_fuente_id = 'LA-COCA-225')")}
    full = {(r.basket_id, r.sucursal_id) for r in ranking.rank_baskets(tables, b, lines).collect()}
    part = {(r.basket_id, r.sucursal_id) for r in ranking.incomplete_branches(tables, b, lines).collect()}
    assert not full & part and len(full | part) == 8 and part == {("A", "rada"), ("B", "rada")}


def test_scaling_prices_keeps_the_ranking(spark, t):
    args = [("A", "CR", *DEFAULT)], [("A", seed.all_of())]
    scaled = {**t, "precio": t["precio"].withColumn("precio", (F.col("precio") * 3).cast("decimal(14,2)"))}
    assert [x[0] for x in ranked(spark, t, *args)["A"]] == [x[0] for x in ranked(spark, scaled, *args)["A"]]


def test_overflow_gives_no_ranking(spark, t):
    dear = {**t, "precio": t["precio"].withColumn("precio", F.lit(Decimal("999999999999.99")))}
    lines = seed.lines(spark, ("A", {p: 999999999.0 for p in seed.PRODUCTS}))
    assert ranking.rank_baskets(dear, seed.baskets(spark, ("A", "CR", *DEFAULT)), lines).count() == 0


def test_summary_lists_every_line(spark):
    baskets = spark.createDataFrame([("long",), ("none",)], "basket_id string")
    lines = spark.createDataFrame([("long", n, 1000 - n) for n in range(250, 0, -1)], "basket_id string, line_no int, product_id long")
    found = {r.basket_id: r for r in ranking.basket_summary(baskets, lines).collect()}
    assert found["long"].n_lines == 250 and found["long"].product_ids == [1000 - n for n in range(1, 251)] and not found["long"].empty
    assert found["none"].product_ids == [] and found["none"].empty


def test_plans_run_no_job_while_they_are_built(spark, t):
    b, lines = seed.baskets(spark, ("A", "CR", *DEFAULT)), seed.lines(spark, ("A", seed.all_of()))
    spark.sparkContext.setJobGroup("building", "")
    try:
        ranking.rank_baskets(t, b, lines), ranking.incomplete_branches(t, b, lines), ranking.rank_alternatives(ranking.candidates(t, b, lines))
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("building") == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_plans_stay_small(spark, t):
    """On stored tables each is read once or a few times, and rows are dealt a few times only."""
    tables = {name: stored(df) for name, df in t.items()}
    b, lines = stored(seed.baskets(spark, ("A", "CR", *DEFAULT))), stored(seed.lines(spark, ("A", seed.all_of())))
    for plan, scans in ((ranking.rank_baskets(tables, b, lines), 13), (ranking.rank_alternatives(ranking.candidates(tables, b, lines)), 13), (ranking.incomplete_branches(tables, b, lines), 19)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") <= 8 and text.count("FileScan parquet") <= scans
        assert len(re.findall(r"FileScan parquet \[[^\]]*fecha_relevamiento", text)) == 1 and len(re.findall(r"FileScan parquet \[[^\]]*line_no", text)) == 1  # prices once, lines once and their products once


def test_status_reads_lines_once_and_ranking_ships_no_row_for_each_branch(spark, t):
    tables = {name: stored(df) for name, df in t.items()}
    b, lines = stored(seed.baskets(spark, ("A", "CR", *DEFAULT))), stored(seed.lines(spark, ("A", seed.all_of())))
    text = ranking.basket_status(tables, b, lines)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*basket_id#\d+,[^\]]*product_id", text)) == 1
    text = ranking.rank_baskets(tables, b, lines)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(basket_id#\d+, \d+\), REPARTITION_BY_COL[^\n]*\n[^\n]*Project \[([^\n]*)", text)
    assert len(dealt) == 1 and "branches" in dealt[0] and "sucursal_id" not in dealt[0]


def test_many_branches_in_bitmaps(spark, t):
    """More branches than a word has bits, of which some have nothing."""
    many = t["sucursal"].where("id = 'centro'").drop("id", "nombre").crossJoin(spark.range(150).selectExpr("concat('s', lpad(id, 3, '0')) AS id", "concat('S', id) AS nombre")).select(t["sucursal"].columns)
    own = t["precio"].where("sucursal_id = 'centro'").drop("id", "sucursal_id").crossJoin(spark.range(0, 150, 3).selectExpr("concat('s', lpad(id, 3, '0')) AS sucursal_id"))
    some = own.where("NOT (producto_fuente_id = 'LA-LAV-001' AND sucursal_id > 's100')").withColumn("id", F.concat_ws("/", "producto_fuente_id", "sucursal_id")).select(t["precio"].columns)
    tables = {**t, "sucursal": many, "precio": some}
    found = {r.sucursal_id: [x.product_id for x in r.productos_faltantes] for r in ranking.incomplete_branches(tables, seed.baskets(spark, ("A", "CR", *DEFAULT)), seed.lines(spark, ("A", seed.all_of()))).collect()}
    every = list(seed.PRODUCTS)
    assert found == {f"s{k:03}": every if k % 3 else ["LAV-001"] for k in range(150) if k % 3 or k > 100}


PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def plan_of(spark, build):
    old = {k: spark.conf.get(k) for k in PLAIN}
    try:
        for k, v in PLAIN.items():
            spark.conf.set(k, v)
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_of_every_product_are_dealt_once_by_each_key_and_sorted_once_with_their_prices(spark, t):
    """Prices of all products give the same ranking; the lines aren't read for their products, prices aren't dealt by product twice, costs are taken once, and no aggregate collects a basket's lines."""
    tables = {name: stored(df) for name, df in t.items()}
    b, lines = stored(seed.baskets(spark, ("A", "CR", *DEFAULT), ("B", "RT", *DEFAULT))), stored(seed.lines(spark, ("A", seed.all_of()), ("B", {"COCA-225": 2}))).drop("line_no")
    few, every = (lambda e=e: ranking.rank_baskets(tables, b, lines, every_product=e) for e in (False, True))
    assert sorted(every().collect()) == sorted(few().collect()) and every().count() == 8
    text = plan_of(spark, every)
    assert len(re.findall(r"FileScan parquet \[[^\]]*product_id#", text)) == 1 and not re.search(r"Exchange hashpartitioning\(producto_id#\d+, sucursal_id", text)
    assert len(re.findall(r"Exchange hashpartitioning\(product_?o?_?id#\d+", text)) == 3  # prices, active products, lines
    assert text.count("array_intersect") == 1 and not re.search(r"Aggregate\(keys=\[basket_id", text)
    text = plan_of(spark, lambda: ranking.incomplete_branches(tables, b, stored(seed.lines(spark, ("A", seed.all_of()))), every_product=True))
    assert not re.search(r"Aggregate\(keys=\[basket_id", text)


def test_lines_that_keep_a_basket_from_being_ranked(spark, t):
    """A null quantity or product, a product that repeats, an unknown or inactive one, too many lines, lines of no basket; without line numbers too."""
    closed = t["producto"].withColumn("activo", F.col("id") != "LAV-001")
    b = seed.baskets(spark, *[(name, "CR", *DEFAULT) for name in ("fine", "twice", "ghost", "closed", "null", "zero", "many", "empty")])
    rows = [("fine", "COCA-225", 2), ("twice", "COCA-225", 2), ("twice", "COCA-225", 1), ("ghost", "COCA-225", 1), ("ghost", "GHOST", 1), ("closed", "COCA-225", 1), ("closed", "LAV-001", 1), ("null", "COCA-225", 1), ("null", None, 1), ("zero", "COCA-225", None), ("other", "COCA-225", 1), (None, "COCA-225", 1), *[("many", "COCA-225", 1)] * 101]
    lines = spark.createDataFrame([(basket, n, product, None if q is None else Decimal(q)) for n, (basket, product, q) in enumerate(rows)], "basket_id string, line_no int, product_id string, quantity decimal(12,3)")
    for given in (lines, lines.drop("line_no")):
        for every in (False, True):
            found = ranking.rank_baskets({**t, "producto": closed}, b, given, every_product=every).collect()
            assert {r.basket_id for r in found} == {"fine"} and len(found) == 4
    assert {r.basket_id for r in ranking.basket_status({**t, "producto": closed}, b, lines).where("status = 'OK'").collect()} == {"fine"}


def observed_later(t, newer):
    """The tables with chango's COCA-225 observed again in its branch, a month later."""
    again = t["precio"].where("sucursal_id = 'chango' AND producto_fuente_id = 'CHA-COCA-225'").withColumns({"id": F.lit("new"), "fecha_relevamiento": F.lit("2026-07-01 10:00:00").cast("timestamp"), **newer})
    return {**t, "precio": t["precio"].where("NOT (sucursal_id = 'rada' AND producto_fuente_id = 'LA-LAV-001')").unionByName(again)}


ODD = [("A", seed.all_of()), ("B", {"COCA-225": 2}), ("C", {"LAV-001": 1.5, "ARROZ-001": 1}), ("ghost", {"COCA-225": 1, "GHOST": 1}), ("zero", {"COCA-225": 0}), ("twice", {"COCA-225": 1}), ("twice", {"COCA-225": 2}), ("far", {"COCA-225": 1})]


def test_latest_observation_of_a_basket(spark, t):
    """The newest of its lines' current prices, at branches that lack other products too; an unavailable price counts nowhere, and baskets with no price or of another status than OK have no row."""
    baskets = seed.baskets(spark, *[(name, "XX" if name == "far" else "CR", *DEFAULT) for name in ("A", "B", "C", "ghost", "zero", "twice", "far", "empty")])
    lines = seed.lines(spark, *ODD)
    june, july = "2026-06-01", "2026-07-01"
    for newer, want in (({}, {"A": july, "B": july, "C": june}), ({"disponible": F.lit(False)}, {"A": june, "B": june, "C": june})):
        tables = observed_later(t, newer)
        for given, every in ((lines, False), (lines.drop("line_no"), True)):
            found = ranking.latest_observations(tables, baskets, given, every_product=every).collect()
            assert len(found) == len(want) and {r.basket_id: str(r.latest_observed.date()) for r in found} == want
    gone = {**t, "precio": t["precio"].where("producto_fuente_id NOT LIKE '%COCA-225'")}
    assert {r.basket_id for r in ranking.latest_observations(gone, baskets, lines).collect()} == {"A", "C"}
    undated = {**t, "precio": t["precio"].withColumn("fecha_relevamiento", F.lit(None).cast("timestamp"))}
    assert {tuple(r) for r in ranking.latest_observations(undated, baskets, lines).collect()} == {("A", None), ("B", None), ("C", None)}


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_latest_observation_deals_no_prices_by_basket(spark):
    """A line carries its product's newest observation; the lines are read once, and prices are dealt by listing alone, without their amounts."""
    text = plan_of(spark, lambda: QUERIES["a5_latest_observation"](spark, SMALLEST))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_quantity", text)) == 1
    assert not re.search(r"collect_list\(struct\((?!product_id)", text) and "explode" not in text and not re.search(r"Exchange hashpartitioning\(producto_id#\d+, sucursal_id", text)
    assert not re.search(r"hashpartitioning\(producto_fuente_id#\d+L?, \d+\)[^\n]*\n[^\n]*Project \[[^\n]*precio#", text)


def test_costs_at_every_branch(spark, t):
    """Lines that a branch has and their cost, at branches that lack other products too, against a plain sum over the matched lines."""
    baskets = seed.baskets(spark, *[(name, "XX" if name == "far" else "CR", *DEFAULT) for name in ("A", "B", "C", "ghost", "zero", "twice", "far", "empty")])
    lines = seed.lines(spark, *ODD)
    tables = observed_later(t, {"precio": F.lit(Decimal("7.25"))})
    wanted = ranking.matched_lines(tables, baskets.where("basket_id IN ('A', 'B', 'C')"), lines).groupBy("basket_id", "sucursal_id").agg(F.count("*").alias("n"), F.sum(F.col("precio") * F.col("quantity")).alias("cost"))
    want = {(r.basket_id, r.sucursal_id): (r.n, r.cost) for r in wanted.collect()}
    assert len(want) == 12 and want["A", "rada"] == (4, Decimal("9430")) and want["B", "chango"] == (1, Decimal("14.5")) and want["C", "rada"] == (1, Decimal("1850"))
    for given, every in ((lines, False), (lines.drop("line_no"), True)):
        found = ranking.basket_costs(tables, baskets, given, every_product=every).collect()
        assert len(found) == 12 and {(r.basket_id, r.sucursal_id): (r.n_matched, r.total_cost) for r in found} == want
    dear = {**t, "precio": t["precio"].withColumn("precio", F.lit(Decimal("999999999999.99")))}
    over = ranking.basket_costs(dear, baskets, seed.lines(spark, ("A", {p: 999999999.0 for p in seed.PRODUCTS}))).collect()
    assert len(over) == 4 and {r.total_cost for r in over} == {None} and {r.n_matched for r in over} == {5}


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_costs_read_lines_once_and_deal_them_by_basket_in_finer_parts(spark):
    """Lines are read once; they carry prices by basket without their observation, in more parts than a shuffle has, as each part's sums are kept in memory."""
    text = plan_of(spark, lambda: QUERIES["a2_basket_totals"](spark, SMALLEST))
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_quantity", text)) == 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    carried = re.findall(r"Exchange hashpartitioning\(basket_id#\d+L?, (\d+)\), REPARTITION_BY_\w+[^\n]*\n[^\n]*Project \[([^\n]*amounts[^\n]*)", text)
    assert len(carried) == 1 and int(carried[0][0]) == 4 * parts and "observed" not in carried[0][1]
