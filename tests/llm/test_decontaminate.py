import hashlib
import re

import numpy as np
import pytest

from pricerank.llm import decontaminate
from tests.llm.helpers import documents, values, words

ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for k, text, *_ in rows:
        w, hit, found = tokens(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[k] = (len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def benchmark(rows):
    text = {k: t for k, t, *_ in rows}
    return [(1, " ".join(words(text[12])[i].decode() for i in range(100, 125))), (2, "One!"), (3, None), (4, ""), (10, text[0]), (11, text[0]), (None, text[7]), (5, "never seen words at all " * 3)]


@pytest.mark.parametrize("limit", [2_000_000, 40])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", limit)  # 40: several passes
    rows = values()
    for items in (benchmark(rows), [x for x in benchmark(rows) if x[0] != 2]):  # with and without a one-word item
        want = brute(rows, items)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(documents(spark), spark.createDataFrame(items, ITEMS)).collect()}
        assert got == want


@pytest.mark.parametrize("piece", [1, 7, 10_000])
def test_pieces_hold_all_windows(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    rows = values()
    items = benchmark(rows) + [(12, rows[12][1]), (12, rows[12][1]), (13, "one -- Two\u00a0\u00e9")]  # a long item, twice
    want = brute(rows, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(documents(spark), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == want
    pieces = decontaminate._item_pieces(spark.createDataFrame(items, ITEMS), 10)
    assert pieces.agg({"size": "max"}).first()[0] <= piece + 9 and pieces.count() == pieces.distinct().count()


def test_empty_tables(spark):
    docs, none = documents(spark), spark.createDataFrame([], ITEMS)
    assert decontaminate.report(docs, none).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), none).count() == 0
    assert decontaminate.report(docs.union(docs), spark.createDataFrame(benchmark(values()), ITEMS)).count() == 120


def test_clean(spark):
    docs, rows = documents(spark, odd=True), values()
    items = spark.createDataFrame([x for x in benchmark(rows) if x[0] != 2], ITEMS)
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and out.count() == 60
    assert decontaminate.report(out, items).where("contaminated").count() == 0
    hit = {r.doc_id: r.n_hit for r in decontaminate.report(docs, items).collect()}
    for r, (k, text, *_) in zip(out.orderBy("doc_id").collect(), rows):
        assert r.text == text if not hit[k] else len(tokens(r.text)) == len(tokens(text)) - hit[k]


def test_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 6, 500)
    index = decontaminate.FMIndex(text, 6)
    for size in (1, 3, 6):
        for at in (0, 100, 494):
            w = text[at : at + size]
            low, high = index.search(w[None, :], np.array([size]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(500 - size + 1) if (text[i : i + size] == w).all()]
