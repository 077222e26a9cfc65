"""Toxicity: bags of subwords, embedded and averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams (with word edges) and of the word itself, hashed into BUCKETS; a text is the mean
of its words; a softmax over two classes stands on top. A text holds few telling words among hundreds, so each bucket enters the mean weighted by its evidence: the log ratio of the
shares of toxic and other training texts it occurs in, shrunk by DOUBT standard errors (most become 0). Vectors and softmax are trained jointly in numpy, by Adagrad, on a
bounded sample of labelled rows (MOST_ROWS by hash of the id), each kept as its distinct words and their counts, so that a long text costs no more than its vocabulary. The evidence is a
grouped count over the sample, and the driver gets a text's buckets with evidence only. Once trained, the model is linear in the words, so scoring needs one number a
bucket, which is broadcast (BUCKETS * 4 bytes); a misspelt word takes the numbers of the n-grams it shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import byte_lists, mix64, n_words, numbered, pieces, remainder, stored

BUCKETS, DIMENSIONS, GRAMS = 1 << 20, 8, (3, 4, 5)
#: The training sample's bound, by default.
MOST_ROWS = 5_000
EPOCHS, BATCH, RATE, SCALE, DOUBT = 8, 32, 0.2, 50.0, 2.0
#: Words whose numbers a task keeps.
KNOWN_WORDS = 60_000
ROLL = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams, word after word, and how many each word has."""
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.cumsum(size)
    word, left = np.repeat(np.arange(len(words)), size), np.repeat(end, size) - np.arange(len(text))
    owners, places = [np.arange(len(words))], []
    whole, total = np.zeros(len(words), np.uint64), np.cumsum(mix64(text + np.uint64(1)) * _powers(len(text)))
    starts = end - size
    whole = (total[end - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))) * _powers(len(text), inverse=True)[starts]
    places.append(whole)
    h = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(text) - n + 1] * ROLL + text[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            owners.append(word[at])
            places.append(h[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mix64(np.concatenate(places)) % np.uint64(BUCKETS)).astype(np.int32)[order], np.bincount(owner, minlength=len(words))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = pow(int(ROLL), -1, 1 << 64) if inverse else int(ROLL)
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, joined by one space, and their counts."""
    for batch in pieces(batches, 300):
        each = [Counter((t or b"").lower().split()) for t in byte_lists(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b" ".join(c) for c in each], pa.binary()), pa.array([list(c.values()) for c in each], pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "counts"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts of each class hold a bucket."""
    held = np.zeros((2, BUCKETS), np.int32)
    for batch in pieces(batches, 300):
        for toxic, text in zip(batch["toxic"].to_pylist(), batch["words"].to_pylist()):
            if text:
                held[toxic][np.unique(subwords(text.split())[0])] += 1
    for toxic in (0, 1):
        buckets = np.flatnonzero(held[toxic])
        yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), toxic, np.int32)), pa.array(held[toxic][buckets])], names=["bucket", "toxic", "n"])


def _evidence(sample: DataFrame, others: int, toxic: int) -> DataFrame:
    """bucket, evidence: the log ratio of the smoothed shares of toxic and other texts that hold it, shrunk towards 0. Buckets without evidence are left out."""
    of = lambda kind: (F.coalesce(F.sum(F.when(F.col("toxic") == kind, F.col("n"))), F.lit(0)) + 1).cast("double")
    held = sample.select("toxic", "words").mapInArrow(_held, "bucket int, toxic int, n int").groupBy("bucket").agg(of(1).alias("toxic"), of(0).alias("others"))
    ratio = F.log(F.col("toxic") / (toxic + 2)) - F.log(F.col("others") / (others + 2))
    sure = F.abs(ratio) - DOUBT * F.sqrt(1 / F.col("toxic") + 1 / F.col("others"))
    return held.where(sure > 0).select("bucket", (F.signum(ratio) * sure).cast("float").alias("evidence"))


def _bags(evidence) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's buckets with evidence and their weights: the share of the bucket in the text (its words count alike) times SCALE and the evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values = evidence.value
        telling = np.zeros(BUCKETS, np.float32)
        telling[buckets] = SCALE * values
        for batch in pieces(batches, 300):
            ids, weights = [], []
            for text, times in zip(batch["words"].to_pylist(), batch["counts"].to_pylist()):
                distinct, weight = np.zeros(0, np.int32), np.zeros(0, np.float32)
                if text:
                    places, count = subwords(text.split())
                    times = np.array(times, np.float64)
                    part = np.repeat(times / (count * times.sum()), count)
                    some = telling[places] != 0
                    distinct, place = np.unique(places[some], return_inverse=True)
                    weight = (np.bincount(place, part[some], len(distinct)) * telling[distinct]).astype(np.float32)
                ids.append(distinct)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["doc_id", "toxic", "ids", "weights"])

    return run


def train(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, buckets: np.ndarray, evidence: np.ndarray, seed: int = 10) -> tuple[np.ndarray, float]:
    """A number for each bucket and the bias: the margin of the toxic class. Bags are buckets and weights, the former by their place in the sorted `buckets`; all other buckets weigh nothing and have no vectors."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (len(buckets), DIMENSIONS)).astype(np.float32)
    top = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.bincount(toxic, minlength=2) / len(toxic)).astype(np.float32)
    seen, seen_top, seen_bias = np.full_like(vectors, 1e-3), np.full_like(top, 1e-6), np.full_like(bias, 1e-6)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(bags)), RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids, weight = (np.concatenate([bags[r][k] for r in rows]) for k in (0, 1))
            owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            x = _summed(owner, vectors[ids] * weight[:, None], len(rows))
            z = x @ top + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), toxic[rows]] -= 1
            used, place = np.unique(ids, return_inverse=True)
            g = _summed(place, (p @ top.T)[owner] * weight[:, None], len(used))
            seen[used] += g * g
            vectors[used] -= rate * g / np.sqrt(seen[used])
            for value, slope, total in ((top, x.T @ p, seen_top), (bias, p.sum(axis=0), seen_bias)):
                total += slope * slope
                value -= rate * slope / np.sqrt(total)
    value = np.zeros(BUCKETS, np.float32)
    value[buckets] = SCALE * evidence * (vectors @ (top[:, 1] - top[:, 0]))
    return value, float(bias[1] - bias[0])


def _summed(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, rows[:, d], n) for d in range(rows.shape[1])], 1).astype(np.float32)


def _scorer(model, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        value, bias = model.value
        for batch in pieces(batches, 300):
            each = [(t or b"").lower().split() for t in byte_lists(batch, text)]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list(set().union(*each).difference(known))
            for at in range(0, len(new), 5_000):
                ids, count = subwords(part := new[at : at + 5_000])
                known.update(zip(part, (np.add.reduceat(value[ids], np.cumsum(count) - count) / count).tolist()))
            margin = np.array([bias + (np.fromiter(map(known.__getitem__, w), np.float64, len(w)).mean() if w else 0.0) for w in each])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))], names=[*keep, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    """The model of the labelled rows whose crc32(doc_id as text) mod `folds` is not 0, most_rows of them at most, by hash of the id. An id labelled twice is toxic if either label says so; one that repeats in docs counts once."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_counted, f"doc_id {kind}, toxic int, words binary, counts array<int>")
    sample = stored(words.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("words", "counts")).alias("text")).select("doc_id", "toxic", "text.*"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:  # without both classes, a constant
        return np.zeros(BUCKETS, np.float32), 30.0 if 1 in n else -30.0
    found = _evidence(sample, n[0], n[1]).orderBy("bucket").toArrow()
    buckets, evidence = found["bucket"].to_numpy(), found["evidence"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((buckets, evidence))
    rows = sample.mapInArrow(_bags(shared), f"doc_id {kind}, toxic int, ids array<int>, weights array<float>").orderBy("doc_id").select("toxic", "ids", "weights").toArrow()  # in order, so that reruns agree
    places = np.searchsorted(buckets, rows["ids"].combine_chunks().flatten().to_numpy()).astype(np.int32)
    ends = np.cumsum(rows["ids"].combine_chunks().value_lengths().to_numpy())[:-1]
    bags = list(zip(np.split(places, ends), np.split(rows["weights"].combine_chunks().flatten().to_numpy(), ends)))
    return train(bags, rows["toxic"].to_numpy().astype(np.int64), buckets, evidence)


def _scores(docs: DataFrame, text: str, keep: list[str], model: tuple[np.ndarray, float]) -> DataFrame:
    """The columns `keep` and score."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), text, keep), f"{kinds}, score double")


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per document: doc_id and score (0 to 1, of its whole text).

    Labels, ids and all columns but the text are no inputs of a score. Null and empty texts get the score of the bias. Labels other than 0 and 1 or
    without an id are not learned from; without labels of both classes all scores are 0 (or 1, if all labels are toxic). Empty
    tables give no rows, repeated rows equal scores.
    """
    return _scores(docs.select("doc_id", "text"), "text", ["doc_id"], fit(docs, labels, folds, most_rows))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (its label was not learned from), score, predicted (1 from 0.5)."""
    return scores(docs, labels).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold, and all without words, with their columns. Where no weights are learned (labels of one class, or texts that tell nothing), all documents stay."""
    model = fit(docs, labels)
    if not model[0].any():
        return docs
    own, text = numbered(docs), f"c{docs.columns.index('text')}"
    kept = _scores(own, text, own.columns, model).where((F.col("score") < threshold) | (n_words(F.col(text)) == 0))
    return kept.drop("score").toDF(*docs.columns)
