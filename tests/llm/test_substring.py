import hashlib

import numpy as np
import pandas as pd
import pytest

from pricerank.llm import substring
from tests.llm.helpers import documents, values, words


def brute(rows, n=20):
    seen, gone = set(), {}
    for k, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone[k] = set()
        for i in range(len(w) - n + 1):
            window = tuple(w[i : i + n])
            if window in seen:
                gone[k].update(range(i, i + n))
            seen.add(window)
    return {k: [x for i, x in enumerate(words(text)) if i not in gone[k]] for k, text, *_ in rows}


def check(spark, rows, docs):
    want = brute(rows)
    got = {r.doc_id: r for r in substring.report(docs).collect()}
    assert set(got) == set(want)
    for k, text, *_ in rows:
        kept = want[k]
        assert (got[k].n_words, got[k].n_removed) == (len(words(text)), len(words(text)) - len(kept)), k
        assert got[k].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


@pytest.mark.parametrize("crowd", [1_000, 1])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring, "ANCHOR_MOST", crowd)  # 1: every contested anchor is dealt by windows
    for seed in (0, 3):
        check(spark, values(seed), documents(spark, seed))


def test_repeats_inside_one_document(spark):
    loop = "a b c d e f g h i j " * 12
    rows = [(1, loop, "", "", 0), (2, "x " * 100, "", "", 0), (3, "y " + loop, "", "", 0)]
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_clean(spark):
    docs = documents(spark, odd=True)
    want = brute(values())
    out = substring.clean(docs)
    assert out.columns == docs.columns
    for r, (k, text, *_) in zip(out.orderBy("doc_id").collect(), values()):
        assert r.doc_id == k
        if len(want[k]) < len(words(text)):
            assert r.text == b" ".join(want[k]).decode() and r.n_chars == len(r.text)
        else:
            assert r.text == text
    assert substring.clean(docs.limit(0)).count() == 0


def test_null_ids_and_whole_repeats(spark):
    docs = documents(spark)
    nulls = docs.where("doc_id = 12").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars")
    out = substring.report(docs.union(nulls))
    assert [r.n_removed for r in out.where("doc_id IS NULL").collect()] == [0]
    once, twice = substring.report(docs), substring.report(docs.union(docs))
    assert sorted(twice.distinct().collect()) == sorted(once.collect()) and twice.count() == 120


def test_automaton():
    a = substring.SuffixAutomaton()
    a.add_text(list("abcab"))
    a.add_text(list("bcd"))
    assert a.matching_statistics(list("xabcdab")) == [0, 1, 2, 3, 3, 1, 2]


def test_the_automaton_decides_among_fragments_of_an_anchor(monkeypatch):
    """Of fragments of one anchor just the words go that windows of earlier ones cover; with an automaton that finds everything the result is another."""
    fragment = lambda doc, start, symbols, content: {"doc_id": doc, "start": start, "anchor": 7, "content": content, "words": np.array(symbols, np.uint64).tobytes()}
    shared = list(range(100, 120))
    shard = pd.DataFrame([fragment(3, 5, [1, *shared, 2], 3), fragment(1, 0, [*shared, 9], 1), fragment(2, 0, [4, 5, *shared[:19], 6, 7], 2), fragment(4, 0, [*shared, 9, 8], 4)])
    found = lambda: sorted(substring._matched(20)(shard).itertuples(index=False, name=None))
    assert found() == [(3, 6, 26), (4, 0, 21)]
    monkeypatch.setattr(substring, "_ranges", lambda automaton, symbols, n: [[0, len(symbols)]])
    assert found() == [(2, 0, 23), (3, 5, 27), (4, 0, 22)]
