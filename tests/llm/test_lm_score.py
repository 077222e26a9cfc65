import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pricerank.llm import lm_score
from tests.llm.helpers import documents, values, words


def base(rows):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, *_ in rows}
    counts = Counter(w for k, text, *_ in rows if not held[k] for w in [*words(text, lower=True), None])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for k, text, *_ in rows:
        t = [*words(text, lower=True), None]
        out[k] = (held[k], len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t))
    return out


@pytest.mark.parametrize("own, table", [(30_000, 400_000), (10, 25)])
def test_base_and_model(spark, monkeypatch, own, table):
    monkeypatch.setattr(lm_score, "MODEL_WORDS", own)  # 10, 25: most words are classed, many are joined
    monkeypatch.setattr(lm_score, "TABLE_WORDS", table)
    rows = values()
    got = {r.doc_id: r for r in lm_score.scores(documents(spark, odd=True)).collect()}
    for k, (held, n, known, total, score) in base(rows).items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.score < 0


def test_every_training_word_has_its_emissions(spark, monkeypatch):
    """Where the broadcast is cut changes no score: words outside it have emissions of their own, too."""
    got = []
    for own in (30_000, 10, 0):
        monkeypatch.setattr(lm_score, "MODEL_WORDS", own)
        got.append({r.doc_id: r.score for r in lm_score.scores(documents(spark)).collect()})
    assert got[1] == pytest.approx(got[0], rel=1e-6) and got[2] == pytest.approx(got[0], rel=1e-6)  # they are stored as floats


def forward(model, symbols):
    """The plain forward recursion of one text, scaled token by token."""
    state, total = model.start, 0.0
    for t, s in enumerate(symbols):
        state = (state @ model.move if t else state) * model.emit[s]
        total += math.log10(state.sum())
        state = state / state.sum()
    return total


def model(symbols=50):
    m = lm_score.Model(np.random.default_rng(0).dirichlet(np.ones(symbols)))
    m.learn(np.random.default_rng(1).random((symbols, lm_score.STATES)), np.random.default_rng(2).random((lm_score.STATES,) * 2), np.random.default_rng(3).random(lm_score.STATES))
    return m


def test_exact_forward_and_expectations():
    m, rng = model(), np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (1, 5, 127, 128, 129, 700, 2000)]
    got = m.log10([t.tobytes() for t in texts])
    assert got == pytest.approx([forward(m, t) for t in texts], rel=1e-9)
    emissions, moves, starts = m.expected([t.tobytes() for t in texts])
    assert emissions.sum() == pytest.approx(sum(map(len, texts))) and starts.sum() == pytest.approx(len(texts))
    assert emissions.sum(axis=1) == pytest.approx(np.bincount(np.concatenate(texts), minlength=50))


def test_expectations_cross_segments():
    """Against the plain forward and backward recursion over whole texts."""
    m, rng = model(), np.random.default_rng(6)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (3, 128, 129, 300, 1000)]
    emissions, moves, starts = np.zeros((50, lm_score.STATES)), np.zeros((lm_score.STATES,) * 2), np.zeros(lm_score.STATES)
    for text in texts:
        b = m.emit[text]
        a = [m.start * b[0] / (m.start * b[0]).sum()]
        for t in range(1, len(text)):
            v = a[-1] @ m.move * b[t]
            a.append(v / v.sum())
        back = np.ones(lm_score.STATES)
        for t in range(len(text) - 1, -1, -1):
            state = a[t] * back / (a[t] * back).sum()
            emissions[text[t]] += state
            if t:
                x = a[t - 1][:, None] * m.move * (b[t] * back)[None, :]
                moves += x / x.sum()
                back = m.move @ (b[t] * back)
                back /= back.sum()
        starts += state
    got = m.expected([t.tobytes() for t in texts])
    assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(got, (emissions, moves, starts)))


def test_learning_raises_likelihood():
    rng = np.random.default_rng(5)
    texts = [(rng.integers(0, 20, 60) + 20 * (k % 2)).astype(np.uint16).tobytes() for k in range(40)]
    m = lm_score.Model(np.full(40, 1 / 40))
    before = m.log10(texts).sum()
    for _ in range(5):
        m.learn(*m.expected(texts))
    assert m.log10(texts).sum() > before + 100  # the two halves of the alphabet come apart


def test_odd_tables(spark):
    docs = documents(spark)
    assert lm_score.scores(docs.limit(0)).count() == 0
    assert lm_score.scores(docs.union(docs)).count() == 120
    only_held = docs.where("doc_id = 2" if zlib.crc32(b"2") % 7 == 2 else f"doc_id = {next(k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2)}")
    r = lm_score.scores(only_held).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score)
