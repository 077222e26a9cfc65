"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier on shape features gives each document a probability of good quality. What is believed of a document is its label where it has one for
training, else this probability. Grouped sums of these beliefs give every host
a posterior rate, shrunk towards the global rate, and every path of a host one shrunk towards its host's; how strongly is estimated from the spread
between the groups (method of moments). A document's score combines its own evidence with the rate of its path, from which its own share is
taken out, so that a lone document rests on its host and a new host on the whole corpus, and no label decides its own document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import byte_lists, pieces, remainder, stored

#: Default bound of the classifier's training sample, by hash of the id.
MOST_ROWS = 20_000
FEATURES = ("words", "word_bytes", "distinct_words", "repeated_lines", "digits", "symbols", "capitals", "lines", "shortness")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 9, 10, 11, 12, 13, 32])
FEATURE_LIST = "array<float>"


def features(text: bytes | None) -> list[float]:
    """Shape of a text; all 0 without words."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    lines, size, n = text.split(b"\n"), len(text), len(words)
    less = lambda gone: 1 - len(text.translate(None, gone)) / size
    return [np.log1p(n), sum(map(len, words)) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines), less(DIGITS), 1 - less(PLAIN), less(UPPER), len(lines) / n, 1 / n]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2_000):
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array([features(t) for t in byte_lists(batch)], pa.list_(pa.float32()))], names=[*names, "features"])


def expanded(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares."""
    z = np.clip((x - middle) / spread, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, z * z])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of a prior: from the spread of the groups' mean rates beyond what their documents' spread explains."""
    mean, within = F.col("good") / F.col("n"), (F.col("squares") / F.col("n") - (F.col("good") / F.col("n")) ** 2) / F.col("n")
    r = groups.agg(F.avg((mean - rate) ** 2 - within).alias("between"), F.avg(rate * (1 - rate)).alias("spread")).first()
    return float(min(max(r.spread / r.between - 1, 1.0), 1e4)) if r.between and r.between > 0 else 1e4


def scores(docs: DataFrame, labels: DataFrame, levels: tuple[str, str] = ("source", "lang"), folds: int = 5, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, evidence (log odds of its own text), host_rate, path_rate, score (0 to 1), kept (score >= 0.5).

    levels name the columns of host and path; at most most_rows labelled rows are learned from. Labels (quality 0 or 1) are learned from only where crc32(doc_id as text) mod `folds` is not 0; an id labelled twice counts as good if any label
    says so; an id that repeats in docs is one row of the sample; without labels of both classes the evidence is 0 and unlabelled documents count as a half. Null and unknown ids have no label. Null hosts and paths are groups of their own. Null and empty texts have all
    features 0. Repeated rows get a row each; empty tables give none; other columns are not read.
    """
    host, path = levels
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "host": docs.schema[host].dataType.simpleString(), "path": docs.schema[path].dataType.simpleString()}
    named = stored(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text").mapInArrow(_described, ", ".join(f"{k} {v}" for k, v in kinds.items()) + f", features {FEATURE_LIST}"))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("quality").alias("quality")).select("features", "quality").toPandas()
    log_odds, prior = F.lit(0.0), 0.5
    if sample["quality"].nunique() == 2:
        x, y = np.stack(sample["features"].to_numpy()).astype(np.float64), sample["quality"].to_numpy(np.float64)
        middle, spread = x.mean(0), x.std(0) + 1e-6
        w, prior = logistic(expanded(x, middle, spread), y), float(y.mean())
        k = len(FEATURES)
        z = [F.least(F.greatest((F.get("features", F.lit(i)).cast("double") - float(middle[i])) / float(spread[i]), F.lit(-8.0)), F.lit(8.0)) for i in range(k)]
        log_odds = sum((float(w[1 + i]) * z[i] + float(w[1 + k + i]) * z[i] * z[i] for i in range(k)), F.lit(float(w[0])))
    base = float(np.log(prior / (1 - prior)))
    bounded = F.greatest(F.least(log_odds, F.lit(20.0)), F.lit(-20.0))
    d = named.join(known, "doc_id", "left").select("doc_id", "host", "path", bounded.alias("log_odds"), "quality")
    d = d.withColumn("p", F.coalesce(F.col("quality").cast("double"), 1 / (1 + F.exp(-F.col("log_odds")))))
    d = d.withColumn("key", F.struct(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("h"), F.col("host").isNull().alias("n"))).withColumn("sub", F.struct(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("p"), F.col("path").isNull().alias("n")))
    sums = [F.sum("p").alias("good"), F.sum(F.col("p") ** 2).alias("squares"), F.count("*").alias("n")]
    paths = stored(d.groupBy("key", "sub").agg(*sums))
    hosts = paths.groupBy("key").agg(F.sum("good").alias("good"), F.sum("squares").alias("squares"), F.sum("n").alias("n"))
    everything = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = (everything.good + 1) / (everything.n + 2) if everything.n else 0.5
    host_strength = _strength(hosts, F.lit(rate))
    host_rate = lambda good, n: (good + host_strength * rate) / (n + host_strength)
    hosts = hosts.withColumnsRenamed({"good": "host_good", "squares": "host_squares", "n": "host_n"})
    paths = paths.join(hosts, "key")
    path_strength = _strength(paths, host_rate(F.col("host_good"), F.col("host_n")))
    out = d.join(paths, ["key", "sub"])
    own = host_rate(F.col("host_good") - F.col("p"), F.col("host_n") - 1)
    sub = (F.col("good") - F.col("p") + path_strength * own) / (F.col("n") - 1 + path_strength)
    out = out.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), (F.col("log_odds") - base).alias("evidence"), own.alias("host_rate"), sub.alias("path_rate"))
    safe = F.greatest(F.least("path_rate", F.lit(1 - 1e-6)), F.lit(1e-6))
    return out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(safe))))).withColumn("kept", F.col("score") >= 0.5)


def url_levels(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL (null where there is none), as levels for pages."""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.nullif(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/([^/]*)", 1), F.lit(""))
