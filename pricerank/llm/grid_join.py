"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are at most sqrt(2 - 2 cos) apart if they link. They are put in the order of their grid cells (edges of that length) on
CELL_AXES leading principal axes, and the sequence of each label is cut into blocks of about BLOCK rows. Intervals of blocks, then blocks, then halves of blocks are joined recursively; any
two whose bounding boxes on BOX_AXES principal axes are further apart than a link are skipped. What is left is compared in full.

Equal vectors of a label are one row with their number first, so that many copies cost no more than one. A task takes one pair of blocks and returns link counts and a spanning forest, never the pairs. The axes are fitted on a
sample of SAMPLE_ROWS vectors by hash of the id; they steer only the skipping, so that any axes give the same links.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.llm.common import intermediate, stored
from pricerank.llm.components import connected_components

BLOCK, INTERVAL, LEAF = 2048, 16, 256
CELL_AXES, BOX_AXES, SAMPLE_ROWS = 4, 16, 5_000
#: Tasks that share the pairs of intervals of a label.
SALTS = 32
SLACK = 1e-9


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Columns: the leading principal axes of a bounded sample's unit vectors (of its commonest dimension)."""
    rows = [np.array(r.v, np.float64) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()]
    if not rows:
        return np.zeros((0, 0))
    size = pd.Series([len(r) for r in rows]).mode()[0]
    x = np.stack([r / np.linalg.norm(r) for r in rows if len(r) == size])
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(size, size) if len(x) > 1 else np.eye(size))
    return axes[:, ::-1][:, : min(BOX_AXES, size)]


def _projected(axes: np.ndarray, x: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit @ axes if unit.shape[1] == len(axes) else unit[:, :BOX_AXES]


def _cells(axes: np.ndarray, eps: float, kind: str) -> Callable:
    def run(batches):
        for p in batches:
            cell = np.zeros((len(p), CELL_AXES), np.int32)
            for size, rows in p.groupby(p["v"].map(len), sort=False).indices.items():
                at = _projected(axes, np.stack(p["v"].to_numpy()[rows]).astype(np.float64))[:, :CELL_AXES]
                cell[rows, : at.shape[1]] = np.floor(at / eps)
            yield p.assign(cell=list(cell))

    return run


def _packed(axes: np.ndarray, dtype: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A block as one row: ids and vectors as bytes in cell order, and its bounding box."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(cell=p["cell"].map(tuple)).sort_values(["cell", "vec_id"])
        x = np.stack(p["v"].to_numpy()).astype(dtype)
        at = _projected(axes, x.astype(np.float64))
        return pd.DataFrame({"label": p["label"].iloc[:1], "size": p["size"].iloc[:1], "block": p["block"].iloc[:1], "low": [at.min(axis=0)], "high": [at.max(axis=0)], "ids": [p["vec_id"].to_numpy(np.int64).tobytes()], "copies": [p["copies"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})

    return run


def joined_sequences(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked places (i in x, j in y; i < j if they are the same sequence)."""
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    found_i, found_j, todo = [], [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a + 1:
            continue
        gap = np.maximum(np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)), 0)
        if (gap * gap).sum() > eps * eps + SLACK:
            continue
        if max(b - a, d - c) > LEAF:
            m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
            todo += [q for q in ((a, m, c, n), (m, b, c, n), (a, m, n, d), (m, b, n, d)) if q[0] < q[1] and q[2] < q[3]]
            continue
        cos = ux[a:b] @ uy[c:d].T
        i, j = np.nonzero(cos >= cosine - SLACK)
        if len(i):
            near = np.abs(cos[i, j] - cosine) < 2 * SLACK  # these few again by the plain formula
            keep = np.ones(len(i), bool)
            u, v = x[a:b][i[near]], y[c:d][j[near]]
            keep[near] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= cosine
            i, j = i[keep] + a, j[keep] + c
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The least rank that each place reaches over the links (i, j)."""
    low = rank.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == before).all():
            return low


def _linked(axes: np.ndarray, dtype: str, cosine: float, eps: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("side")
        ids, copies = ([np.frombuffer(b, np.int64) for b in pair[c]] for c in ("ids", "copies"))
        x = [np.frombuffer(b, dtype).astype(np.float64).reshape(len(k), -1) for b, k in zip(pair["vectors"], ids)]
        p = [_projected(axes, v) for v in x]
        same = len(pair) == 1
        i, j = joined_sequences(x[0], x[-1], p[0], p[-1], same, cosine, eps)
        every, times = (x[0] if same else np.concatenate(x) for x in (ids, copies))
        j = j if same else j + len(ids[0])
        links = np.zeros(len(every), np.int64)
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        root = _forest(i, j, every.copy()) if len(i) else every
        some = np.flatnonzero(links)
        return pd.DataFrame({"vec_id": every[some], "links": links[some], "root": root[some]})

    return run


def _gap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """Squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(low2, high, lambda a, b: a - b), F.zip_with(low, high2, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda total, g: total + g * g)


def components(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable, itself included), kept.

    Only vectors of equal label and dimension are compared. Vectors link with nothing that are null, empty, all zero, or hold a null or non-finite
    component, and those with a null label or id (component_id is then null for a null id, and the row is kept). Rows that repeat whole count
    once, each with the same result; ids must otherwise be distinct whole numbers. Empty tables give no rows; extra columns are not read.
    """
    eps = math.sqrt(2 - 2 * cosine)
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType.simpleString()
    dtype = "float32" if kind == "array<float>" else "float64"
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    with intermediate() as keep:
        valid = stored(embeddings.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("size"), v.alias("v")).dropDuplicates(["vec_id", "label", "v"]))
        label = valid.schema["label"].dataType.simpleString()
        axes = principal_axes(valid)
        classes = stored(valid.groupBy("label", F.xxhash64("v").alias("hash"), "v").agg(F.first("size").alias("size"), F.min("vec_id").alias("first"), F.count("*").alias("copies")))
        celled = stored(classes.select(F.col("first").alias("vec_id"), "label", "size", "v", "copies").mapInPandas(_cells(axes, eps, label), f"vec_id long, label {label}, size int, v array<double>, copies long, cell array<int>"))
        # one row per cell, at most (2 / eps + 2)^CELL_AXES of them a label: where the cell begins in its label's sequence
        before = Window.partitionBy("label", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = celled.groupBy("label", "size", "cell").agg(F.count("*").alias("rows")).withColumn("first", F.sum("rows").over(before) - F.col("rows"))
        place = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("rows"))
        blocked = celled.join(cells, ["label", "size", "cell"]).withColumn("block", F.floor(place / BLOCK))
        blocks = stored(blocked.select("vec_id", "label", "size", "v", "copies", "cell", "block").groupBy("label", "size", "block").applyInPandas(_packed(axes, dtype), f"label {label}, size int, block long, low array<double>, high array<double>, ids binary, copies binary, vectors binary"))
        boxes = blocks.select("label", "size", "block", "low", "high", F.floor(F.col("block") / INTERVAL).alias("interval"))
        wide = boxes.groupBy("label", "size", "interval").agg(F.array(*[F.min(F.get("low", F.lit(k))) for k in range(BOX_AXES)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(k))) for k in range(BOX_AXES)]).alias("high"))
        wide = wide.withColumns({c: F.filter(c, lambda x: x.isNotNull()) for c in ("low", "high")})
        near = lambda of: _gap(F.col("low"), F.col("high"), F.col("low2"), F.col("high2")) <= eps * eps + SLACK
        intervals = _near_pairs(wide, wide, "interval", near).select("label", "size", "interval", "interval2")
        pairs = intervals.join(boxes, ["label", "size", "interval"]).join(boxes.select("label", "size", F.col("interval").alias("interval2"), F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2")), ["label", "size", "interval2"])
        pairs = pairs.where((F.col("block") <= F.col("block2")) & near(None)).select("label", "size", F.col("block").alias("a"), F.col("block2").alias("b"))
        sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b")))).join(blocks.select("label", "size", "block", "ids", "copies", "vectors"), ["label", "size", "block"])
        found = stored(sides.select("label", "size", "a", "b", F.col("block").alias("side"), "ids", "copies", "vectors").groupBy("label", "size", "a", "b").applyInPandas(_linked(axes, dtype, cosine, eps), "vec_id long, links long, root long"))
        counted = found.groupBy(F.col("vec_id").alias("id")).agg(F.sum("links").alias("links"))
        component = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
        several = stored(classes.where("copies > 1").select("label", "hash", "v", "first"))
        copies = valid.select("vec_id", "label", F.xxhash64("v").alias("hash"), "v").join(several, ["label", "hash", "v"]).select("vec_id", "first")
        known = classes.select("first", "copies").join(counted, F.col("first") == F.col("id"), "left").join(component, F.col("first") == F.col("node"), "left")
        known = known.select("first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "first").alias("component"))
        of = keep(stored(copies.union(classes.where("copies = 1").select("first", "first")).toDF("id", "_first")))
        each = of.join(keep(stored(known)), F.col("_first") == F.col("first")).select("id", "links", "component")
    out = embeddings.select("vec_id").join(each, F.col("vec_id") == F.col("id"), "left")
    component_id = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def _near_pairs(x: DataFrame, y: DataFrame, key: str, near: Callable) -> DataFrame:
    """Pairs of a label's rows whose boxes are near. A label's rows on one side are dealt over SALTS tasks, each of which has all rows of the other."""
    other = y.select("label", "size", *[F.col(c).alias(f"{c}2") for c in (key, "low", "high")], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return x.withColumn("salt", (F.col(key) % SALTS).cast("int")).join(other, ["label", "size", "salt"]).where((F.col(key) <= F.col(f"{key}2")) & near(None))
