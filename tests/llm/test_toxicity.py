import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pricerank.llm import toxicity
from pricerank.llm.common import stored
from tests.llm.test_others import labelled


def buckets(word):
    return toxicity.subwords([word])[0].tolist()


def counted(docs, labels):
    rows = docs.join(labels, "doc_id").select("doc_id", "toxic", "text")
    return stored(rows.mapInArrow(toxicity._counted, "doc_id long, toxic int, words binary, counts array<int>"))


def test_evidence_by_hand(spark):
    docs, labels = labelled(spark)
    sample = counted(docs, labels)
    held, texts = {0: Counter(), 1: Counter()}, Counter()
    for r in docs.join(labels, "doc_id").collect():
        texts[r.toxic] += 1
        held[r.toxic].update({b for w in r.text.encode().lower().split() for b in buckets(w)})
    want = {}
    for b in held[0] | held[1]:
        t, o = held[1][b] + 1, held[0][b] + 1
        ratio = math.log(t / (texts[1] + 2)) - math.log(o / (texts[0] + 2))
        sure = abs(ratio) - toxicity.DOUBT * math.sqrt(1 / t + 1 / o)
        if sure > 0:
            want[b] = math.copysign(sure, ratio)
    got = {r.bucket: r.evidence for r in toxicity._evidence(sample, texts[0], texts[1]).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[b] - want[b]) < 1e-5 for b in want)


def test_scores_by_hand(spark):
    """A score is the softmax of the mean over words of the mean over a word's buckets."""
    docs, labels = labelled(spark)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, "").when(F.col("doc_id") == 11, None).otherwise(F.col("text")))
    value, bias = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == 600
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        margin = bias + (np.mean([np.mean([float(value[b]) for b in buckets(w)]) for w in words]) if words else 0.0)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-margin))) < 1e-5


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = labelled(spark)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.scores(docs, labels).collect()) == sorted(toxicity.scores(docs, flipped).collect())


def test_texts_without_words_only(spark):
    docs, labels = labelled(spark)
    blank = docs.withColumn("text", F.lit(" \n"))
    rows = toxicity.report(blank, labels).collect()
    assert len(rows) == 600 and len({r.score for r in rows}) == 1 and 0 <= rows[0].score <= 1
