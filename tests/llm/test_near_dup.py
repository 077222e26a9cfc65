import random

import pytest

from pricerank.llm import near_dup
from pricerank.llm.components import connected_components
from tests.llm.helpers import DOCS, documents, prose, values, words


def brute(rows, n, threshold=80):
    sets = {}
    for k, text, *_ in rows:
        w = words(text, lower=True)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, n):
    assert found(near_dup.components(documents(spark, odd=True), n=n)) == brute(values(), n)


@pytest.mark.parametrize("small, block, tile", [(16, 256, 16), (2, 8, 16), (2, 4, 2)])
def test_large_group_of_near_copies(spark, monkeypatch, small, block, tile):
    """Pairs on both sides of the threshold; 2, 8 and 4: nearly every bucket is compared block by block."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(2)
    base = [f"u{k}" for k in range(80)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 8, 12])):
            text[rng.randrange(80)] = f"v{rng.randrange(10_000)}"
        rows.append((k, " ".join(text), "", "", 0))
    rows += [(100 + k, prose(rng, 40), "", "", 0) for k in range(20)]
    assert found(near_dup.components(spark.createDataFrame(rows, DOCS), n=2)) == brute(rows, 2)


def test_crowded_bucket_of_unlike_texts(spark, monkeypatch):
    """Texts with a passage in common share bands without being alike: their sketches meet in tiles, and no set of theirs is sent."""
    rng = random.Random(4)
    passage = prose(rng, 60, [f"c{k}" for k in range(500)])
    rows = [(k, passage + " " + prose(rng, 50, [f"u{k}" for k in range(20_000)]), "", "", 0) for k in range(5_000)]
    sent = []
    monkeypatch.setattr(near_dup, "dealt_tiles", lambda members, deal=near_dup.dealt_tiles: sent.append((members.count(), deal(members).count())) or deal(members))

    def no_set_is_sent(*_):
        raise AssertionError

    monkeypatch.setattr(near_dup, "shared_counts", no_set_is_sent)
    got = near_dup.components(spark.createDataFrame(rows, DOCS), n=2)
    assert got.where("component_id = doc_id AND kept").count() == 5_000
    [(members, dealt)] = sent
    assert members > 5_000 and dealt <= 2 * members


def test_tiles_of_one_bucket(spark):
    """5,000 members, none alike: each is sent twice for each of two tiles."""
    members = spark.range(5_000).selectExpr("0L AS main", "id AS rep", "id AS component", "id <> 0 AS outside", "array(id) AS sketch")
    dealt = near_dup.dealt_tiles(members)
    assert dealt.count() <= 4 * 5_000
    blocks = {(r.outside, r.block): r["count"] for r in dealt.where("tile_x = 0 AND outside OR tile_y = 0 AND NOT outside").groupBy("outside", "block").count().collect()}
    assert max(blocks.values()) < 2 * 2 * near_dup.BLOCK


def test_dedup(spark):
    docs = documents(spark, odd=True)
    out = near_dup.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {k for k, x in brute(values(), 5).items() if x[2]}


def test_odd_tables(spark):
    docs = documents(spark)
    assert near_dup.components(docs.limit(0)).count() == 0
    nulls = near_dup.components(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text")).collect()
    assert len(nulls) == 60 and all(r.kept and r.component_id is None for r in nulls)
    once, twice = near_dup.components(docs, n=2), near_dup.components(docs.union(docs), n=2)
    assert twice.count() == 120 and sorted(twice.distinct().collect()) == sorted(once.collect())


def test_sketch_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    most = near_dup.most_differing_bits(0.8)
    for _ in range(200):  # pairs at similarity 0.8 stay within the bound
        shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (160, 20, 20))
        least = np.stack([near_dup.minima(np.concatenate([shared, x])) for x in (a, b)])
        x, y = near_dup.odd_sketches(least).view(np.uint64)
        assert int(np.bitwise_count(x ^ y).sum()) <= most


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(path).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}
