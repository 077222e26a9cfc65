import random
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from pricerank.functions.text import fixed_double
from pricerank.plans import ranking
from pricerank.queries import BLOCKS, fixed_sql


def test_scores_on_a_half_are_rounded_as_in_sql(spark, tmp_path):
    """Baskets of three branches whose middle score has a 5 as its fifth and last digit in most cases."""
    rng, rows = random.Random(5), []
    for basket in range(1_500):
        low, step = rng.randrange(1, 10**7), rng.randrange(1, 10**4)
        high, middle = low + 400 * step, low + step * rng.randrange(1, 400)
        for branch, (cents, km) in enumerate([(low, 3.7), (middle, rng.choice([1.1, 3.7])), (high, 1.1)]):
            rows.append((basket, branch, "S", f"B{branch}", Decimal(cents) / 100, km, Decimal(high - cents) / 100))
    df = spark.createDataFrame(rows, "basket_id long, branch_id long, supermarket_name string, branch_name string, total_cost decimal(24,5), distance_km double, saving decimal(24,5)")
    df.coalesce(1).write.parquet(f"{tmp_path}/cand")
    got = ranking.rank_alternatives(df, (0.6, 0.3, 0.1)).select("basket_id", "branch_id", "position", "score", fixed_double(F.col("score"), 4))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW cand AS SELECT *, distance_km AS km FROM '{tmp_path}/cand/*.parquet'")
    want = con.execute(f"WITH norm AS ({BLOCKS['norm']}), scored AS ({BLOCKS['scored']}) SELECT basket_id, branch_id, row_number() OVER (PARTITION BY basket_id ORDER BY score DESC, supermarket_name, branch_name, branch_id), score, {fixed_sql('score', 4)} FROM scored").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
