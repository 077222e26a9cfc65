import numpy as np
import pytest

from pricerank.llm import grid_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=0, n=150, dims=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for k in range(5, n, 3):
        x[k] = x[k - 1] * rng.uniform(0.5, 2) + rng.normal(size=dims) * rng.choice([0, 0.05, 0.3])
    out = [(k, [float(np.float32(v)) for v in x[k]], int(k // 60)) for k in range(n)]
    inf, nan = float("inf"), float("nan")
    out += [(900, None, 0), (901, [], 0), (902, [0.0] * dims, 0), (903, [nan] + [1.0] * (dims - 1), 0), (904, [inf] + [1.0] * (dims - 1), 0), (905, [None] + [1.0] * (dims - 1), 0), (906, out[0][1], None), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1.0, 2.0], 1), (None, out[0][1], 0)]
    return out


def brute(data, cosine=0.93):
    fine = [(k, np.array(v, float), lab) for k, v, lab in data if k is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    root, links = {k: k for k, *_ in data if k is not None}, {k: 0 for k, *_ in data if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, u, p) in enumerate(fine):
        for b, v, q in fine[i + 1 :]:
            if p == q and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cosine:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (links[k], find(k), find(k) == k) for k in root}


@pytest.mark.parametrize("block, leaf", [(2048, 256), (16, 4)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(grid_join, "BLOCK", block)
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    monkeypatch.setattr(grid_join, "INTERVAL", 2)
    data = rows()
    got = grid_join.components(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS block", "2 AS cell", "3 AS v")).collect()
    assert len(got) == len(data)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute(data)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_odd_tables(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert grid_join.components(df.limit(0)).count() == 0
    twice = grid_join.components(df.union(df))
    assert twice.count() == 2 * df.count() and sorted(twice.where("vec_id IS NOT NULL").distinct().collect()) == sorted(grid_join.components(df).where("vec_id IS NOT NULL").collect())
    doubles = grid_join.components(df.selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding", "label"))
    assert {r.vec_id: r.n_links for r in doubles.collect() if r.vec_id is not None} == {k: x[0] for k, x in brute(rows()).items()}


def test_blocks_are_skipped():
    axes, eps = np.eye(2), 0.3
    x = np.array([[1.0, 0.0]] * 8)
    y = np.array([[-1.0, 0.0]] * 8)
    i, j = grid_join.joined_sequences(x, y, x @ axes, y @ axes, False, 0.955, eps)
    assert not len(i)
    i, j = grid_join.joined_sequences(x, x, x @ axes, x @ axes, True, 0.955, eps)
    assert len(i) == 28 and (i < j).all()
