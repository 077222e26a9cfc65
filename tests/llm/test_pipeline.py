import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricerank.llm import decontaminate, grid_join, near_dup
from pricerank.llm.common import intermediate, shared_dir, stored
from pricerank.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import test_near_dup, test_substring
from tests.llm.helpers import documents
from tests.test_oracle import FOLDER, normal

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_tables
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "mixing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_dup":
            assert near_dup.components(docs).where("NOT kept").count() == 0
        if name == "substring_dedup":
            want = test_substring.brute([tuple(r) for r in before.collect()])
            assert all((r.text or "").split() == [w.decode() for w in want[r.doc_id]] for r in docs.collect() if len(want[r.doc_id]) < len((r.text or "").encode().split()))
        if name == "decontamination":
            assert decontaminate.report(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.count() and set(columns) <= set(docs.columns)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got, want = QUERIES[name](spark, FOLDER), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), columns)


def test_run_on_odd_documents(spark, tmp_path):
    """Null ids, null and empty texts, rows that repeat whole, clashing column names; and an empty table."""
    odd = documents(spark, odd=True)
    docs = odd.unionByName(odd.where("doc_id = 20")).unionByName(odd.where("doc_id IN (21, 22)").withColumn("doc_id", F.lit(None).cast("long")))
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "never seen words at all here or there")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "text", "epoch", "a.b"} <= set(out.columns)
        rows = out.collect()
        assert bool(rows) == (name == "odd") and all(len((r.text or "").split()) == r.taken for r in rows)
        assert max([0, *Counter((r.doc_id, r.epoch) for r in rows if r.doc_id is not None).values()]) <= 1


@needs_tables
def test_near_dup_finds_all_pairs_at_the_threshold(spark):
    """Five-word shingles at similarity 0.8, against all pairs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = test_near_dup.brute([tuple(r) for r in docs.collect()], 5)
    assert test_near_dup.found(near_dup.components(docs)) == want


@pytest.mark.parametrize("toxic", [{1}, {0}, {0, 1}])
def test_toxicity_stage_keeps_what_it_cannot_judge(spark, tmp_path, toxic):
    """Labels of one class teach nothing, so all stay; with a toxic majority texts without words stay by rule."""
    texts = [None if k == 8 else "" if k == 9 else " \t" if k == 10 else f"a kind word for every reader number {k}" if k % 10 == 0 else f"awful nasty insults thrown at all {k}" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "4 AS score", "12 AS `a.b`")
    marks = [(k, 1, 1 if toxic == {1} else 0 if toxic == {0} else int(k % 10 > 0)) for k in range(200)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == ({8, 9} | set(range(0, 200, 10)) if len(toxic) == 2 else set(range(200)))


def test_intermediate_tables_go(spark):
    """Kept tables stay until the intermediate() around them ends; others go, of a failed run all."""
    folder = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with intermediate() as keep_outer:
        with intermediate() as keep:
            one, two, three = stored(spark.range(3)), keep(stored(spark.range(4))), keep_outer(keep(stored(spark.range(5))))
        assert [os.path.isdir(folder(t)) for t in (one, two, three)] == [False, True, True] and two.count() == 4
    assert [os.path.isdir(folder(t)) for t in (two, three)] == [False, True] and three.count() == 5
    with pytest.raises(ZeroDivisionError), intermediate():
        four = stored(spark.range(3))
        1 / 0
    assert not os.path.isdir(folder(four)) and os.path.isdir(folder(stored(spark.range(1))))


@pytest.mark.parametrize("components, columns", [(near_dup.components, "doc_id long, text string"), (grid_join.components, "vec_id long, label int, embedding array<float>")])
def test_what_a_result_reads_is_all_that_stays(spark, components, columns):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    row = (1, "a b c d e f") if components is near_dup.components else (1, 0, [1.0, 2.0])
    found = components(spark.createDataFrame([row, (2, *row[1:])], columns))
    left = set(os.listdir(folder)) - before
    assert {f.split("/")[-2] for f in found.inputFiles()} == left and len(left) <= 3
    assert [r.component_id for r in found.collect()] == [1, 1]
