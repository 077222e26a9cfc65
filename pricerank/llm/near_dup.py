"""MinHash near-dedup with odd sketches.

Each document's set of word shingles gives BANDS * ROWS minima. They make the bands that propose candidates, and, folded into a parity bitmap of
BITS bits (the odd sketch), an estimate of each candidate pair's similarity: the bits in which two sketches differ tell how many minima
differ. Candidates whose sketches differ in more bits than links at the threshold ever do are dropped; the others are confirmed on their full sets.

Equal sets become one class first. Inside a bucket of a band, members are paired with the bucket's least id only, not with each other; the links found give
components. What is left are pairs of one bucket in different components. In buckets of up to SMALL members they are listed; for larger ones, tasks compare
the members outside the bucket's main component with all members and return links only. So every proposed pair is either confirmed, refuted, or inside one
component already. Large buckets go in two steps. Sketches alone (128 bytes a member) meet in pairs of tiles of BLOCK * TILE members, so a member is sent once for
each tile of the other side: a few times in a bucket of thousands. The members of those pairs of blocks in which a link is still open are then sent with their sets, block against
block. Texts that share a band (six minima) without being alike end at the first step and no set of theirs moves; a group of copies has few members outside its main component. What stays
quadratic is the comparing of sketches in a bucket of unlike texts, and the sending of sets among many texts whose similarity is within the sketch's error below the threshold. No pair is written out but links. A pair
at similarity 0.8 shares no band with a chance of (1 - 0.8^6)^46 = 8e-7.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import WordHashes, byte_lists, intermediate, mix64, pieces, stored
from pricerank.llm.components import connected_components

BANDS, ROWS, BITS = 46, 6, 1024
HASHES = BANDS * ROWS
#: Ids broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket whose pairs are listed, members of a block of a larger one, and blocks of a tile.
SMALL, BLOCK, TILE = 16, 256, 16
ROLL = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(5)
FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n consecutive words; of fewer words, the whole sequence as one; of none, nothing."""
    if not len(words):
        return words
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        h = h * ROLL + words[j : j + len(h)]
    return np.unique(mix64(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (np.multiply.outer(FACTORS, x[at : at + 512]) + OFFSETS[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """For each row of minima one 64-bit key a band."""
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        key = mix64(key * ROLL + parts[:, :, j])
    return key


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """For each row of minima the parities of the bits they fall on, as BITS / 64 integers."""
    place = mix64(least.astype(np.uint64) * ROLL + np.arange(HASHES, dtype=np.uint64)) % np.uint64(BITS)
    bits = np.zeros((len(least), BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.arange(len(least))[:, None], place.astype(np.int64)), 1)
    return np.packbits(bits, axis=1).view(np.int64)


def most_differing_bits(similarity: float, deviations: float = 5) -> int:
    """Bits in which the sketches of a pair of that similarity may differ: the mean, and so many standard deviations more."""
    differing = 2 * HASHES * (1 - similarity)
    spread = 2 * math.sqrt(HASHES * similarity * (1 - similarity)) + math.sqrt(differing)
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (differing + deviations * spread / math.sqrt(2))))


def _signatures(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 500):
            sets = [shingle_set(known.of((t or b"").lower().split()), n) for t in byte_lists(batch)]
            least = np.stack([minima(s) for s in sets])
            sums = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + ROLL)) if len(s) else 0] for s in sets], np.uint64).view(np.int64)
            keys, sketch = band_keys(least).view(np.int64), odd_sketches(least)
            some = np.array([len(s) > 0 for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[:, 0]),
                    pa.array(sums[:, 1]),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel(), mask=pa.array(~some)),
                    pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, BITS // 64, dtype=np.int32), sketch.ravel()),
                ],
                names=["doc_id", "n_shingles", "sum", "xor", "bands", "sketch"],
            )

    return run


def _sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 500):
            sets = [shingle_set(known.of((t or b"").lower().split()), n).view(np.int64) for t in byte_lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return run


def restricted(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose doc_id is (left_semi) or is not (left_anti) in the stored table `ids` (column id); broadcast up to BROADCAST_IDS."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["id"], how)


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _confirmed(texts: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as the threshold."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    kind = ids.schema["id"].dataType.simpleString()
    sets = stored(restricted(texts, ids).mapInArrow(_sets(n), f"id {kind}, set array<long>").dropDuplicates(["id"]))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    hundredths = round(threshold * 100)
    return both.where(F.lit(100).cast("long") * shared >= F.lit(hundredths) * union).select("a", "b")


def dealt_tiles(members: DataFrame) -> DataFrame:
    """The members (main, rep, component, outside, sketch) once for each pair of tiles in which they are compared: those outside the main component, by the column block, against all."""
    counts = members.groupBy("main").agg(F.count("*").alias("members"), F.count_if("outside").alias("others"))
    members = members.join(counts, "main")
    block = lambda total: F.pmod(F.xxhash64("rep"), F.ceil(F.col(total) / BLOCK))
    tile = lambda number: F.floor(number / TILE)
    every = lambda total: F.explode(F.sequence(F.lit(0).cast("long"), tile(F.ceil(F.col(total) / BLOCK) - 1)))
    cells = ["main", "rep", "component", "sketch"]
    outside = members.where("outside").select(*cells, "outside", block("others").alias("block"), tile(block("others")).alias("tile_x"), every("members").alias("tile_y"))
    return outside.union(members.select(*cells, F.lit(False), block("members"), every("others"), tile(block("members"))))


def _crowded(texts: DataFrame, placed: DataFrame, split: DataFrame, sketches: DataFrame, n: int, threshold: float, most: int) -> DataFrame:
    """Links between components inside large buckets. All large buckets with the same main component are taken together, so that a group is sent
    once and not once a band."""
    members = placed.join(split.select("band", "main"), "band").select("main", "rep", "component").distinct()
    members = stored(members.withColumn("outside", F.col("component") != F.col("main")).join(sketches, F.col("rep") == F.col("id")).drop("id"))
    kind = members.schema["rep"].dataType.simpleString()
    still_open = dealt_tiles(members).groupBy("main", "tile_x", "tile_y").applyInPandas(_open_blocks(most), f"main {kind}, rep {kind}, component {kind}, i long, j long, outside boolean")
    still_open = stored(still_open)
    ids = stored(still_open.select(F.col("rep").alias("id")).distinct())
    sets = stored(restricted(texts, ids).mapInArrow(_sets(n), f"id {kind}, set array<long>").dropDuplicates(["id"]).join(sketches, "id"))
    return stored(still_open.join(sets, F.col("rep") == F.col("id")).groupBy("main", "i", "j").applyInPandas(_linked(threshold, most), f"a {kind}, b {kind}"))


def _sides(members: pd.DataFrame) -> list[pd.DataFrame]:
    return [members[members["outside"]], members[~members["outside"]]]


def _sketched(members: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What open_pairs() compares: sketches and components."""
    return np.stack(members["sketch"].to_numpy()).view(np.uint64), members["component"].to_numpy()


def open_pairs(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Which pairs may be links by their sketches and are not in one component."""
    differing = np.zeros((len(x[0]), len(y[0])), np.int32)
    for k in range(BITS // 64):
        differing += np.bitwise_count(x[0][:, k, None] ^ y[0][None, :, k])
    return (differing <= most) & (x[1][:, None] != y[1][None, :])


def _open_blocks(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a pair of tiles: for each pair (i, j) of blocks the members that are in an open pair."""

    def run(tiles: pd.DataFrame) -> pd.DataFrame:
        columns = ["main", "rep", "component", "i", "j", "outside"]
        found = [tiles.iloc[:0].assign(i=np.int64(0), j=np.int64(0))[columns]]
        first, second = ([(number, block, _sketched(block)) for number, block in side.groupby("block")] for side in _sides(tiles))
        for i, x, x_sketched in first:
            for j, y, y_sketched in second:
                pairs = open_pairs(x_sketched, y_sketched, most)
                if pairs.any():
                    found += [side[some].assign(i=i, j=j)[columns] for side, some in ((x, pairs.any(1)), (y, pairs.any(0)))]
        return pd.concat(found)

    return run


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets a with the sets b, by products of their incidence matrices, some columns at a time."""
    values = np.intersect1d(np.concatenate(a), np.concatenate(b))
    total = np.zeros((len(a), len(b)), np.float32)
    where = []
    for sets in (a, b):
        flat = np.concatenate(sets)
        column = np.minimum(np.searchsorted(values, flat), max(0, len(values) - 1))
        hit = values[column] == flat if len(values) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column[hit], kind="stable")
        where.append((row[order], column[hit][order]))
    for at in range(0, len(values), 4096):
        blocks = []
        for (row, column), sets in zip(where, (a, b)):
            low, high = np.searchsorted(column, [at, at + 4096])
            block = np.zeros((len(sets), 4096), np.float32)
            block[row[low:high], column[low:high] - at] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total.astype(np.int64)


def _linked(threshold: float, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One link for each outside member and component it is linked with."""
    hundredths = round(threshold * 100)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(block)
        nothing = pd.DataFrame({"a": block["rep"].iloc[:0], "b": block["rep"].iloc[:0]})
        if not len(x) or not len(y):
            return nothing
        open_ = open_pairs(_sketched(x), _sketched(y), most)
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            return nothing
        sets = [[s for s in p["set"].to_numpy()[k]] for p, k in ((x, rows), (y, columns))]
        shared = shared_counts(*sets)
        union = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[1]])[None, :] - shared
        i, j = np.nonzero((100 * shared >= hundredths * union) & open_[np.ix_(rows, columns)])
        links = pd.DataFrame({"a": x["rep"].to_numpy()[rows[i]], "b": y["rep"].to_numpy()[columns[j]], "component": y["component"].to_numpy()[columns[j]]})
        return links.drop_duplicates(["a", "component"])[["a", "b"]]

    return run


def components(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (least doc_id reachable by links, itself included), kept (doc_id = component_id).

    A-Z are lower-cased; words are runs of characters other than ASCII white space. Null and empty texts have no shingles and no links. Rows with a null doc_id are linked with
    nothing: component_id is null and they are kept. Rows that repeat whole get the same result. Empty tables give no rows; extra columns are not read.
    """
    with intermediate() as keep:
        kind = docs.schema["doc_id"].dataType.simpleString()
        texts = docs.select("doc_id", "text")
        signed = keep(stored(texts.mapInArrow(_signatures(n), f"doc_id {kind}, n_shingles long, sum long, xor long, bands array<long>, sketch array<long>")))
        linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = stored(linkable.groupBy("n_shingles", "sum", "xor").agg(F.min("doc_id").alias("rep")))
        classed = keep(stored(linkable.select("doc_id", "n_shingles", "sum", "xor").join(classes, ["n_shingles", "sum", "xor"]).select("doc_id", "rep")))
        reps = classed.where("doc_id = rep").select("rep").distinct()
        banded = linkable.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1").drop("members")
        members = stored(banded.join(buckets, "band"))
        sketches = stored(linkable.join(members.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "sketch"))
        most = most_differing_bits(threshold)
        near = _differing(F.col("sketch_a"), F.col("sketch_b")) <= most
        a, b = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
        led = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        links = stored(_confirmed(texts, led.join(b, "b").join(a, "a").where(near).select("a", "b"), n, threshold))
        component = connected_components(links)
        placed = stored(members.where("rep != leader").join(component, members["rep"] == component["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("component")))
        parts = placed.groupBy("band", "component").agg(F.count("*").alias("part"))
        split = stored(parts.groupBy("band").agg(F.max_by("component", F.struct("part", "component")).alias("main"), F.max("part").alias("most"), F.sum("part").alias("members")).where("most < members"))
        few = placed.join(split.where(F.col("members") <= SMALL).select("band"), "band").join(sketches, F.col("rep") == F.col("id")).select("band", "rep", "component", "sketch")
        x, y = few.select("band", F.col("rep").alias("a"), F.col("component").alias("component_a"), F.col("sketch").alias("sketch_a")), few.select("band", F.col("rep").alias("b"), F.col("component").alias("component_b"), F.col("sketch").alias("sketch_b"))
        crossing = x.join(y, (x["band"] == y["band"]) & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & near).select("a", "b").distinct()
        more = stored(_confirmed(texts, crossing, n, threshold)).union(_crowded(texts, placed, split.where(F.col("members") > SMALL), sketches, n, threshold, most))
        component = keep(connected_components(links.union(more)))
    found = classed.join(component, classed["rep"] == component["node"], "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component")).dropDuplicates(["id"])
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that components() keeps: of each component the one of least id, and of rows that repeat whole one. Rows with a null id and
    documents without shingles all stay; empty tables give no rows."""
    found = stored(components(docs, n, threshold).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"))
    left = restricted(docs, stored(found.where("NOT kept").select("id")), "left_anti")
    twice = stored(found.where("kept").select("id"))
    return restricted(left, twice, "left_anti").union(restricted(left, twice).dropDuplicates())
