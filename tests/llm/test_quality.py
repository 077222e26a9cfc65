"""The quality classifier against a plain computation of every step, and what sites add where texts tell little."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricerank.llm import quality
from tests.llm.helpers import documents, values

SHAPE = "doc_id long, text string, source string, lang string"


def plain(docs, labels, folds=5):
    """(evidence, host_rate, path_rate, score) by row, of rows (doc_id, text, host, path) and {doc_id: quality}, step by step."""
    taught = {d: q for d, q in labels.items() if zlib.crc32(str(d).encode()) % folds}
    x = np.array([quality.features((t or "").encode()) for _, t, *_ in docs], np.float32).astype(float)
    rows = [k for k, (d, *_) in enumerate(docs) if d in taught]
    y = np.array([taught[docs[k][0]] for k in rows], float)
    odds, prior = np.zeros(len(docs)), 0.5
    if 0 < y.mean() < 1:
        middle, spread, prior = x[rows].mean(0), x[rows].std(0) + 1e-6, y.mean()
        z = np.clip((x - middle) / spread, -8, 8)
        full = np.hstack([np.ones((len(z), 1)), z, z * z])
        w = np.zeros(full.shape[1])
        for _ in range(200):  # Newton steps to the end
            p = 1 / (1 + np.exp(-full[rows] @ w))
            w -= np.linalg.solve((full[rows].T * (p * (1 - p))) @ full[rows] + np.eye(len(w)), full[rows].T @ (p - y) + w)
        odds = np.clip(full @ w, -20, 20)
    belief = np.array([taught.get(d, 1 / (1 + np.exp(-o))) for (d, *_), o in zip(docs, odds)], float)
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, h, p), b in zip(docs, belief):
        hosts[h].append(b)
        paths[h, p].append(b)
    rate = (belief.sum() + 1) / (len(belief) + 2)

    def strength(groups, prior_of):
        between = np.mean([(np.mean(g) - prior_of(k)) ** 2 - np.var(g) / len(g) for k, g in groups.items()])
        spread = np.mean([prior_of(k) * (1 - prior_of(k)) for k in groups])
        return min(max(spread / between - 1, 1.0), 1e4) if between > 0 else 1e4

    s = strength(hosts, lambda k: rate)
    shrunk = lambda good, n: (good + s * rate) / (n + s)
    s2 = strength(paths, lambda k: shrunk(sum(hosts[k[0]]), len(hosts[k[0]])))
    out = []
    for (_, _, h, p), b, o in zip(docs, belief, odds):
        own = shrunk(sum(hosts[h]) - b, len(hosts[h]) - 1)
        sub = (sum(paths[h, p]) - b + s2 * own) / (len(paths[h, p]) - 1 + s2)
        evidence = o - np.log(prior / (1 - prior))
        out.append((evidence, own, sub, 1 / (1 + np.exp(-(evidence + np.log(sub / (1 - sub)))))))
    return out


@pytest.mark.parametrize("classes", [2, 1])
def test_every_step_by_hand(spark, classes):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["a", "b", "b", "b", "", None]), rng.choice(["x", "y", None])) for k, t, *_ in values(n=120)]
    labels = {k: int(rng.random() < 0.7 or classes == 1) for k in range(0, 120, 2)}
    got = {r.doc_id: r for r in quality.scores(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    for (d, *_), want in zip(rows, plain(rows, labels)):
        assert [got[d].evidence, got[d].host_rate, got[d].path_rate, got[d].score] == pytest.approx(want, rel=1e-3, abs=1e-5)
        assert got[d].kept == (got[d].score >= 0.5)


def auc(scores, truth):
    order = np.argsort(np.argsort(scores))
    good = np.array(truth) == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_sites_help_where_texts_tell_little(spark):
    """Pages of 400 hosts, most with a few documents: a page's quality hangs on its host and section, its text tells little of it, and a fifth has labels. Held-out ranking gains by the rates, and those of
    lone hosts stay near the whole."""
    rng = random.Random(9)
    rows, truth, labels = [], {}, {}
    for host in range(400):
        rate = rng.betavariate(1.2, 1.2)
        for _ in range(1 if host % 4 == 0 else rng.choice([4, 12, 40])):
            k, section = len(rows), rng.choice(["news", "shop"])
            good = int(rng.random() < min(max(rate + (0.25 if section == "news" else -0.25), 0.02), 0.98))
            words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 60) + 6 * good)]
            rows.append((k, " ".join(words), f"http://h{host}.example/{section}/{k}.html"))
            truth[k] = good
            if rng.random() < 0.2:
                labels[k] = good
    pages = spark.createDataFrame(rows, "doc_id long, text string, url string")
    host, path = quality.url_levels(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    got = quality.scores(pages, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), levels=("host", "path")).join(pages.select("doc_id", "host"), "doc_id").collect()
    unseen = [r for r in got if r.doc_id not in labels or r.held_out]
    marks = [truth[r.doc_id] for r in unseen]
    by_text, by_site, both = (auc([r[c] for r in unseen], marks) for c in ("evidence", "path_rate", "score"))
    assert both > by_text + 0.03 and by_site > 0.6 and sum((r.score >= 0.5) != (r.evidence >= 0) for r in unseen) > len(unseen) * 0.1
    sizes = defaultdict(int)
    for r in got:
        sizes[r.host] += 1
    middle = np.median([r.host_rate for r in got])
    spread = lambda alone: np.std([r.host_rate for r in got if (sizes[r.host] == 1) == alone])
    assert spread(True) < 0.5 * spread(False) and 0.3 < middle < 0.7


def test_bounded_sample_and_odd_tables(spark):
    docs = documents(spark, odd=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    few = quality.scores(docs, labels, most_rows=5)
    assert few.count() == 60 and quality.scores(docs.limit(0), labels).count() == 0 and quality.scores(docs, labels.limit(0)).where("evidence <> 0").count() == 0
