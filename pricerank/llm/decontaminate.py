"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of bounded length and builds an FM-index of each: suffix array, Burrows-Wheeler transform in a wavelet
matrix, suffix positions sampled every SAMPLE symbols. All benchmark windows are searched backwards at once, their occurrences
located by walking to the next sampled suffix, and the spans merged per document. Nothing is shuffled but the benchmark.

Before indexing, a shard drops what cannot hold an occurrence: words outside every pair of neighbouring words of the benchmark, each gap
leaving one separator. That loses no occurrence, as an occurrence is a run of such pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import byte_lists, numbered, pieces, stored

#: Words: runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case.
KEPT_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same separators as a pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Symbols of a shard's index, words of the benchmark broadcast at once (a larger benchmark is searched in slices of about this size), and first words of
#: windows in a piece of an item, so that slices of pieces differ little in size.
SHARD, SLICE_WORDS, PIECE_WORDS = 400_000, 2_000_000, 10_000
SAMPLE = 16
SPANS = "array<struct<start:int,end:int>>"


class Windows:
    """Windows of the benchmark: for each length a matrix of symbols; symbols from 2, 0 for unknown words, 1 the separator."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.symbol: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, text in items:
            words = text.translate(KEPT_BYTES).split()
            ids = tuple(self.symbol.setdefault(w, len(self.symbol) + 2) for w in words)
            pairs.update(zip(ids, ids[1:]))
            for at in range(max(1, len(ids) - n + 1) if ids else 0):
                rows.setdefault(ids[at : at + n], set()).update([item] if item is not None else [])
        self.sigma = len(self.symbol) + 2
        self.pairs = np.array(sorted(a * self.sigma + b for a, b in pairs), np.int64)
        windows = sorted(rows, key=lambda w: (len(w), w))
        self.length = np.array([len(w) for w in windows], np.int64)
        self.symbols = np.zeros((len(windows), max([0, *self.length])), np.int64)
        for k, w in enumerate(windows):
            self.symbols[k, : len(w)] = w
        names = sorted({i for s in rows.values() for i in s})
        place = {i: k for k, i in enumerate(names)}
        self.items = np.array(names, dtype=object)
        owners = [[place[i] for i in rows[w]] for w in windows]
        self.first = np.concatenate([[0], np.cumsum([len(o) for o in owners], dtype=np.int64)]).astype(np.int64)
        self.owner = np.array([i for o in owners for i in o], np.int64)


class WaveletMatrix:
    """Ranks and symbols of a sequence, one bit level after another."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        start = np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, s = ones[at], ones[start]
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return at - start

    def at(self, places: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(places)
        for shift, ones, zeros in self.levels:
            a = ones[places]
            one = ones[places + 1] - a == 1
            symbol = symbol | (one.astype(symbol.dtype) << shift)
            places = np.where(one, zeros + a, places - a)
        return symbol


class FMIndex:
    """Index of a sequence of symbols >= 1; a last symbol 0 is added."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        text = np.append(sequence, 0).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.sampled = np.zeros(self.n + 1, np.int32)
        np.cumsum(order % SAMPLE == 0, out=self.sampled[1:])
        self.samples = order[order % SAMPLE == 0]

    def search(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's interval of suffixes, by backward search over all windows at once."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((length > j) & (low < high))
            c = windows[live, j]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk to the left until a sampled one, then add the steps."""
        found, steps, todo, rows = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            here = self.sampled[rows + 1] > self.sampled[rows]
            found[todo[here]] = self.samples[self.sampled[rows[here]]] + steps
            todo, rows, steps = todo[~here], rows[~here], steps + 1
            c = self.wavelet.at(rows)
            rows = self.before[c] + self.wavelet.rank(c, rows)
        return found


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: suffixes by their first 1, 2, 4, ... symbols until all ranks differ."""
    _, rank = np.unique(text, return_inverse=True)
    width, n = 1, len(text)
    while True:
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank.astype(np.int64) * (n + 1) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, width = new, width * 2


def search_shard(texts: list[bytes | None], windows: Windows) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text the number of words, its merged spans of hit words as (start, end) rows, and the items that occur."""
    ids = [np.fromiter(map(windows.symbol.get, w, repeat(0)), np.int64, len(w)) for w in ((t or b"").translate(KEPT_BYTES).split() for t in texts)]
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([*ids, np.zeros(1, np.int64)])
    doc = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(counts) - counts
    nothing = [np.zeros((0, 2), np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    if not len(windows.length) or len(flat) < 2:
        return counts, *nothing
    least = int(windows.length.min())
    if least == 1:
        live = flat[:-1] > 0
    else:
        here = np.flatnonzero((flat[:-2] > 0) & (flat[1:-1] > 0) & (doc[:-1] == doc[1:])) if len(doc) > 1 else np.zeros(0, np.int64)
        code = flat[here] * windows.sigma + flat[here + 1]
        here = here[windows.pairs[np.minimum(np.searchsorted(windows.pairs, code), len(windows.pairs) - 1)] == code] if len(windows.pairs) else here[:0]
        paired = np.zeros(len(doc), bool)
        paired[here] = True  # the word and the next one are neighbours in some item
        edge = np.flatnonzero(np.diff(np.concatenate([[0], paired.view(np.int8), [0]])))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] + 1 >= least]
        live = np.zeros(len(doc) + 1, np.int32)
        np.add.at(live, runs[:, 0], 1)
        np.add.at(live, runs[:, 1] + 1 if len(runs) else runs[:, 1], -1)
        live = np.cumsum(live)[:-1] > 0
    place = np.flatnonzero(live)
    if not len(place):
        return counts, *nothing
    gap = np.flatnonzero((np.diff(place) != 1) | (np.diff(doc[place]) != 0)) + 1
    if least > 1:  # neighbours that are no pair of the benchmark are parted too
        gap = np.union1d(gap, np.flatnonzero(~paired[place[:-1]]) + 1)
    sequence, place = np.insert(flat[place], gap, 1), np.insert(place, gap, -1)
    index = FMIndex(sequence, windows.sigma)
    low, high = index.search(windows.symbols, windows.length)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    at = place[index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))]
    cover = np.zeros(len(flat), np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.length[which], -1)
    covered = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    same = np.concatenate([[False], doc[1:] == doc[:-1], [False]])
    first = np.flatnonzero(covered[1:-1] & ~(covered[:-2] & same[:-1]))
    last = np.flatnonzero(covered[1:-1] & ~(covered[2:] & same[1:])) + 1
    owners = windows.first[which + 1] - windows.first[which]
    item = windows.owner[np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(windows.first[which], owners)]
    pair = np.unique(np.repeat(doc[at], owners) * max(1, len(windows.items)) + item)
    spans, items = nothing[0].copy(), nothing[1].copy()
    for d, part in _parts(doc[first]):
        spans[d] = np.stack([first[part], last[part]], 1) - starts[d]
    for d, part in _parts(pair // max(1, len(windows.items))):
        items[d] = pair[part] % len(windows.items)
    return counts, spans, items


def _parts(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(owner[a]), slice(int(a), int(b))


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts exceed a shard; a longer text is a shard of its own."""
    for batch in pieces(batches, 2_000):
        size = np.cumsum([len(t or b"") // 6 for t in byte_lists(batch, text)])
        edge = [0, *(np.flatnonzero(np.diff(size // (4 * SHARD))) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:]):
            yield batch.slice(a, b - a)


def _item_pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """item, text, size: distinct pieces of the items, which overlap by n - 1 words so that each window of an item is a window of a piece. Items without words have none."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.filter(F.split("text", SEPARATORS), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)), F.lit(PIECE_WORDS))
    cut = words.withColumn("at", F.explode(starts)).select("item", F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + n - 1)).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("text"), F.size("w").alias("size")).distinct()


def find_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of each document with n_words, spans (merged, of hit words: start, end) and items (distinct ids as text).

    A window is n consecutive words of an item, or a shorter item's whole sequence. Null and empty texts have no words, as documents and as items; a
    null item id marks words but is listed nowhere; equal items are all listed. Repeated documents give a row each, empty
    tables none or no hits. Columns outside `keep` are not read. The benchmark is cut into pieces, of which equal ones count once, and broadcast in slices of about SLICE_WORDS words (by hash of the
    piece, after a sum of their sizes); each further slice is a further pass over the documents, which adds its spans.
    """
    spark = docs.sparkSession
    items = stored(_item_pieces(benchmark, n))
    total = items.agg(F.sum("size")).first()[0] or 0
    slices = int(total // SLICE_WORDS) + 1
    own = text in keep  # then the text is carried on anyway, else up to the last pass
    place = f"k{keep.index(text)}" if own else "text"
    state = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if own else [F.col(text).alias("text")]), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        windows = spark.sparkContext.broadcast(Windows([(r.item, r.text.encode()) for r in part.collect()], n))
        last = k == slices - 1
        out = state.drop("text") if last else state
        state = state.mapInArrow(_finder(windows, place, out.columns[:-3]), out.schema)
        if not last:
            state = stored(state)
    return state.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items")


def _finder(windows, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches, text):
            counts, spans, items = search_shard(byte_lists(batch, text), windows.value)
            names = windows.value.items
            old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            spans = [[{"start": int(a), "end": int(b)} for a, b in s] for s in spans]
            items = [[str(x) for x in names[i]] for i in items]
            both = [(_merged(p + s) if p else s, sorted({*q, *i}) if q else i) for s, i, (p, q) in zip(spans, items, old)]
            found = [pa.array(counts), pa.array([s for s, _ in both], kind), pa.array([i for _, i in both], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], names=[*keep, "n_words", "spans", "items"])

    return run


def _merged(spans: list[dict]) -> list[dict]:
    done: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if done and s["start"] <= done[-1]["end"]:
            done[-1]["end"] = max(done[-1]["end"], s["end"])
        else:
            done.append(dict(s))
    return done


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined), contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    ids = F.array_join(F.array_sort("items"), ",")
    return find_spans(docs, benchmark, n).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[dict]) -> str:
    """The text without the words of the spans and what stands between them."""
    plain, edges, place = text.translate(KEPT_BYTES), [], 0
    for w in plain.split():
        place = plain.index(w, place)
        edges.append((place, place + len(w)))
        place += len(w)
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : edges[s["start"]][0]])
        at = edges[s["end"] - 1][1]
    return b"".join([*kept, text[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents with their hit spans cut out of the text; all rows and columns stay, n_chars is counted anew where it exists."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            at, spans = names.index("text"), batch.column("spans").to_pylist()
            new = [cut_spans(t, s) if s else t for t, s in zip(byte_lists(batch, f"c{at}"), spans)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array([x.decode() if isinstance(x, bytes) else x for x in new], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = numbered(docs)
    out = find_spans(own, benchmark, n, keep=tuple(own.columns), text=f"c{names.index('text')}").drop("n_words", "items").mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
