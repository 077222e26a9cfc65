import hashlib
from fractions import Fraction

import pytest

from pricerank.llm import mixing
from tests.llm.helpers import DOCS, documents, values, words


def brute_targets(sizes, weights=(5, 2, 1), share=1, most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        target = {s: Fraction(left) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", [0, 1])
def test_mix(spark, seed):
    rows = values(seed)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = brute_targets(sizes)
    got = {r.doc_id: r for r in mixing.mix(documents(spark, seed)).collect()}
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for k, text, _, source, _ in rows:
        r = got[k]
        assert r["size"] == len(words(text)) and r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 1
    again = {r.doc_id: r.taken for r in mixing.mix(documents(spark, seed).repartition(7)).collect()}
    assert again == {k: r.taken for k, r in got.items()}


def test_texts(spark):
    docs = documents(spark, odd=True)
    mixed = mixing.mixed_texts(docs).collect()
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    total = {}
    for r in mixed:
        assert len(words(r.text)) == r.taken and r.n_chars == len(r.text) and r["a.b"] == 12
        total[r.doc_id] = total.get(r.doc_id, 0) + r.taken
    assert total == {k: v for k, v in want.items() if v}


def test_empty_and_repeated(spark):
    docs = documents(spark)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_texts(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id IN (8, 9)")).collect()] == [0, 0]  # no words at all
    twice = mixing.mix(docs.union(docs))
    assert twice.count() == 120 and twice.where("taken > 3 * size").count() == 0
    assert mixing.mix(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "source")).count() == 60


def test_null_ids_are_dealt_by_text(spark):
    """Rows without an id come in the order of their texts' md5, which spreads them over the ranges."""
    rows = [(None, text, "en", "a" if k % 3 else "b", 0) for k, (_, text, *_) in enumerate(values())]
    got = {r.row.text: r for r in mixing.mix(spark.createDataFrame(rows, DOCS), with_row=True).collect()}
    for source in "ab":
        mine = sorted({t for _, t, _, s, _ in rows if s == source and t and words(t)}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        rest = [got[t].taken - got[t].epochs * got[t]["size"] for t in mine if sum(x == t for _, x, *_ in rows) == 1]
        full = [got[t]["size"] for t in mine if sum(x == t for _, x, *_ in rows) == 1]
        at = next((k for k, (r, f) in enumerate(zip(rest, full)) if r < f), len(rest))
        assert not any(rest[at + 1 :])  # whole documents, one that is cut, none
