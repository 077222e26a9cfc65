import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricerank.llm import search
from tests.llm.helpers import documents, values

ITEMS = "item_id long, text string"


def ranking(docs, items, k=50):
    tf = [(d, Counter(search.terms_of((t or "").encode()))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    n, total = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(search.terms_of((t or "").encode()))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in tf:
            m = 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((score, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, d, s) for r, (s, d) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k, slices", [(50, 100_000), (3, 100_000), (5, 30)])
def test_against_all_scores(spark, monkeypatch, k, slices):
    monkeypatch.setattr(search, "SLICE_TERMS", slices)
    monkeypatch.setattr(search, "BROADCAST_PAIRS", 200_000 if k > 3 else 0)
    rows = [(d, t) for d, t, *_ in values(n=160)]
    rows += [(500 + j, "w1 w2, W3! é straße x") for j in range(120)]  # copies, of which only the first can be results
    rows += [(None, "w1 w1 w1"), (900, "w1 " * 40), (900, "w1 " * 40), (901, None)]
    items = [(0, "w1 w2"), (1, "w5-w6 W7 w7 nothing"), (2, "nothing at all"), (3, None), (4, ""), (5, "Straße É x"), (6, rows[0][1]), (6, "w9"), (None, "w3 w4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS query", "2 AS content", "3 AS score", "4 AS `rank`")
    got = result(search.report(docs, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS term"), k))
    assert got == ranking(rows, items, k) and len(got) >= 5 * k


def test_bounds_hold_and_exclude(spark):
    """The bounds are never below the scores, and far fewer documents than all are scored."""
    rows = [(d, t) for d, t, *_ in values(n=200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.build_index(docs)
    df = {r.term: r.df for r in index.terms.collect()}
    terms = sorted(df)[:20]
    queries = search.Queries(index, [(7, terms[:10]), (8, terms[10:])], df)
    scored = 0
    for b in index.blocks.collect():
        bounds = queries.bounds(b.slices, bytes(b.bits), np.array(b.sizes))
        for col, d in enumerate(b.doc_ids):
            words = search.terms_of((rows[d][1] or "").encode())
            for q in (0, 1):
                exact = queries.score(Counter(words), len(words), q)
                assert bounds[q, col] >= exact
                scored += bounds[q, col] > 1.2 * exact + 1
    assert scored < 60  # of 400
    assert index.n_docs == sum(bool(search.terms_of((t or "").encode())) for _, t in rows)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "w1")], ITEMS)
    assert search.report(documents(spark).limit(0), items).count() == 0
    assert search.report(documents(spark), items.limit(0)).count() == 0
    found = search.report(documents(spark, odd=True), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 50 or found.count() > 10
