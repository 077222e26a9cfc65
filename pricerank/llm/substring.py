"""Substring dedup with suffix automata of reference shards.

A word goes if a window of `n` words that covers it starts earlier too. Sending every document past an automaton of every shard would
grow with the square of the corpus, so windows are routed: each has one anchor, its k-gram of least hash, and equal windows have equal anchors. Runs of
windows with the same anchor position form fragments of at most 2n - k words. Anchors that occur once need no work. Then

* fragments that are equal as a whole, by two 64-bit hashes of their words, form a class. All of its members but the first go, which takes no automaton: their matching statistic against the
  first is their length. Members are told from the first by document and place, so no class is a hot key, and their words travel nowhere;
* the first members of the classes of one anchor, different fragments that may share windows, meet in one reference shard. They are streamed in order of document and place past the suffix
  automaton of those before, a range of words goes where the matching statistic reaches n, and they are added to it;
* anchors with over ANCHOR_MOST classes would make one task, so their fragments are cut into single windows, which form classes as above.

Rows with a null doc_id are neither references nor judged. Ids must otherwise be distinct, except for rows that repeat whole: those count
as one document and get the same result. Null and empty texts have no words, empty tables no rows. Extra columns are not read by spans().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import WordHashes, byte_lists, mix64, numbered, pieces, stored

#: Words of an anchor; classes of one anchor that meet in one shard; references of a shard, about.
K, ANCHOR_MOST, SHARD_FRAGMENTS = 8, 1_000, 4_000
ROLL, ROLL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class SuffixAutomaton:
    """Online suffix automaton over hashable symbols; texts are parted by symbols that occur once."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.last, self.parts = [-1], [0], 0, 0

    def add_text(self, symbols: list[int]) -> None:
        for s in symbols:
            self._add(s)
        self.parts += 1
        self._add((self.parts,))

    def _add(self, symbol) -> None:
        following, link, length = self.next, self.link, self.length
        new, p = len(length), self.last
        following.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(symbol) == q:
                    following[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def matching_statistics(self, symbols: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        following, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for s in symbols:
            while state and s not in following[state]:
                state = link[state]
                matched = length[state]
            if s in following[state]:
                state, matched = following[state][s], matched + 1
            out.append(matched)
        return out


def word_hashes(texts: list[bytes | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes in one array, and where each text starts in it (with the end)."""
    each = [known.of((t or b"").split()) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), starts


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of each n neighbours, one for each start, by joining runs of 1, 2, 4, ... neighbours."""
    total, done, run, width = h, 0, h, 1
    while n:
        if n & 1:
            total, done = (_joined(total, done, run, width, base) if done else run), done + width
        n >>= 1
        if n:
            run, width = _joined(run, width, run, width, base), width * 2
    return total


def _joined(left: np.ndarray, wide: int, right: np.ndarray, more: int, base: np.uint64) -> np.ndarray:
    """Hashes of `wide` neighbours followed by `more` others."""
    size = max(0, min(len(left), len(right) - wide))
    return left[:size] * np.uint64(pow(int(base), more, 1 << 64)) + right[wide : wide + size]


def fragments(h: np.ndarray, starts: np.ndarray, n: int, k: int = K) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor position: text, start (first word in its text), n (windows), anchor, content."""
    names = ("text", "start", "n", "anchor", "content")
    if len(h) < n:
        return {x: np.zeros(0, np.int64) for x in names}
    wide = n - k + 1
    gram = mix64(rolled(h, k, ROLL))
    best = np.arange(len(gram))
    width = 1
    while width < wide:  # the leftmost least gram of each `width` neighbours
        step = min(width, wide - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(gram[b] < gram[a], b, a)
        width += step
    window = rolled(h, n, ROLL2)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(text[: len(window)] == text[n - 1 : n - 1 + len(window)])
    if not len(at):
        return {x: np.zeros(0, np.int64) for x in names}
    place, owner = best[at], text[at]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(owner) != 0) | (np.diff(at) != 1)]))
    count = np.diff(np.append(edge, len(at)))
    first = at[edge]
    content = mix64(window[first] * ROLL + mix64(window[first + count - 1]) + count.astype(np.uint64))
    owner = owner[edge]
    return {"text": owner, "start": first - starts[owner], "n": count, "anchor": gram[place[edge]].view(np.int64), "content": content.view(np.int64)}


def _fragments(n: int, located: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches, 500):
            f = fragments(*word_hashes(byte_lists(batch), known), n, min(K, n))
            if not located:
                anchor, count = np.unique(f["anchor"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(count.astype(np.int32))], names=["anchor", "n"])
                continue
            ids = batch.column(0).take(pa.array(f["text"]))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(f[c].astype(t)) for c, t in (("start", np.int32), ("n", np.int32), ("anchor", np.int64), ("content", np.int64))]], names=["doc_id", "start", "n", "anchor", "content"])

    return run


def _words_of(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The word hashes of the fragments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        kinds = {"anchor": pa.int64(), "content": pa.int64(), "contents": pa.int64(), "start": pa.int32(), "n": pa.int32()}
        for batch in pieces(batches, 200):
            ids, words, rows = [], [], {c: [] for c in kinds}
            for doc, text, listed in zip(batch.column(0).to_pylist(), byte_lists(batch), batch.column(2).to_pylist()):
                h = known.of((text or b"").split())
                for f in listed:
                    for c in kinds:
                        rows[c].append(f[c])
                    ids.append(doc)
                    words.append(h[f["start"] : f["start"] + f["n"] + n - 1].tobytes())
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[c], kinds[c]) for c in kinds], pa.array(ids, batch.schema.field(0).type), pa.array(words, pa.binary())], names=[*kinds, "doc_id", "words"])

    return run


def _ranges(automaton: SuffixAutomaton, symbols: list[int], n: int) -> list[list[int]]:
    """The maximal ranges of words that windows of the automaton's texts cover."""
    out: list[list[int]] = []
    for end, m in enumerate(automaton.matching_statistics(symbols), 1):
        if m >= n:
            if out and end - n <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([end - n, end])
    return out


def _matched(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard: references in order are streamed past the automaton of those before and added to it."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        references = shard.drop_duplicates(["anchor", "content"]).sort_values(["doc_id", "start"], kind="stable")  # a repeated row gives its references again
        left = references.groupby("anchor")["start"].count().to_dict()
        automaton, seen, out = SuffixAutomaton(), set(), []
        for doc_id, start, anchor, binary in zip(*(references[c].tolist() for c in ("doc_id", "start", "anchor", "words"))):
            symbols = np.frombuffer(binary, np.uint64).tolist()
            found = _ranges(automaton, symbols, n) if anchor in seen else []
            out += [(doc_id, start + a, start + b) for a, b in found]
            left[anchor] -= 1
            if left[anchor] and found != [[0, len(symbols)]]:
                automaton.add_text(symbols)
                seen.add(anchor)
        return pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return run


def _windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of a fragment as a fragment of its own: two hashes of its words (anchor, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1_000):
            ids, at, keys, keys2 = [], [], [], []
            for k, (start, words) in enumerate(zip(batch.column("start").to_pylist(), batch.column("words").to_pylist())):
                h = np.frombuffer(words, np.uint64)
                a, b = rolled(h, n, ROLL), rolled(h, n, ROLL2)
                ids += [k] * len(a)
                at += range(start, start + len(a))
                keys.append(a.view(np.int64))
                keys2.append(b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(keys2)), batch.column("doc_id").take(pa.array(ids, pa.int32())), pa.array(at, pa.int32()), pa.array(np.ones(len(ids), np.int32))], names=["anchor", "content", "doc_id", "start", "n"])

    return run


def _classes(members: DataFrame) -> DataFrame:
    """anchor, content, copies, first, n of each class."""
    return stored(members.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "start")).alias("first"), F.first("n").alias("n")))


def _but_first(members: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Ranges of all members of the classes but the first ones. A member is the first if its document and place are."""
    others = members.join(classes.select("first.*"), ["doc_id", "start"], "left_anti")
    return others.select("doc_id", "start", (F.col("start") + F.col("n") + (n - 1)).alias("end"))


def spans(docs: DataFrame, n: int = 20) -> DataFrame:
    """doc_id, start, end: ranges of words (from 0, end excluded, they may overlap) that windows with an earlier equal cover."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    # stored, so that the join below has exchanges of its own on both sides, and Spark may split a hot anchor's rows
    repeated = stored(texts.mapInArrow(_fragments(n, False), "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    every = texts.mapInArrow(_fragments(n, True), f"doc_id {kind}, start int, n int, anchor long, content long")
    several = stored(every.join(repeated, "anchor"))
    classes = _classes(several)
    contested = stored(classes.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"))
    fragment = F.struct("anchor", "content", "contents", F.col("first.start").alias("start"), "n")
    listed = stored(classes.join(contested, "anchor").select(F.col("first.doc_id").alias("doc_id"), fragment.alias("f")).groupBy("doc_id").agg(F.collect_list("f").alias("listed")))
    worded = stored(texts.join(listed, "doc_id").mapInArrow(_words_of(n), f"anchor long, content long, contents long, start int, n int, doc_id {kind}, words binary"))
    few = worded.where(F.col("contents") <= ANCHOR_MOST)
    shards = int(few.count() // SHARD_FRAGMENTS) + 1
    judged = few.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "content", "doc_id", "start", "words")
    matched = judged.groupBy("shard").applyInPandas(_matched(n), f"doc_id {kind}, start int, end int")
    found = _but_first(several, classes, n).unionByName(matched)
    crowded = worded.where(F.col("contents") > ANCHOR_MOST)
    if crowded.isEmpty():
        return found
    windows = stored(crowded.select("doc_id", "start", "words").mapInArrow(_windows(n), f"anchor long, content long, doc_id {kind}, start int, n int"))
    return found.unionByName(_but_first(windows, _classes(windows), n))


def _with_spans(docs: DataFrame, n: int) -> DataFrame:
    ranges = spans(docs, n).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    own = numbered(docs)
    return own.join(ranges, own[f"c{docs.columns.index('doc_id')}"] == F.col("_id"), "left").drop("_id")


def _kept(text: bytes | None, ranges: list[dict] | None) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    if not ranges:
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, [r["start"] for r in ranges], 1)
    np.add.at(cover, [r["end"] for r in ranges], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)], len(words)


def report(docs: DataFrame, n: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            each = [_kept(t, r) for t, r in zip(byte_lists(batch, "c1"), batch.column(2).to_pylist())]
            sums = [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for _, m in each], pa.int64()), pa.array([m - len(w) for w, m in each], pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text"), n).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, n: int = 20) -> DataFrame:
    """The documents without the removed words: texts that lose words become the kept ones joined by one space, others stay as they are.
    All rows and columns stay, those of a null id unchanged; rows that repeat whole get the same text; n_chars is counted anew where it exists."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            at, ranges = names.index("text"), batch.column(len(names)).to_pylist()
            new = [b" ".join(_kept(t, r)[0]) if r else t for t, r in zip(byte_lists(batch, f"c{at}"), ranges)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array([None if t is None else t.decode() for t in new], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = _with_spans(docs, n).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
