"""Ranked lexical search over bit-sliced Bloom signatures.

build_index() reads every text once. Documents of about as many terms form blocks, and a block is a matrix of bits: a column for each document, a row for each hash value. A term
sets HASHES bits in the columns of the documents that hold it; a term that occurs 2, 3, 5, ... times (TIERS) also sets those of its higher tiers. The AND of a term's rows is a bitmap
of the documents that may hold it: it lacks none and has few too many.

search() takes the queries in slices of bounded size. For each block, the bitmaps of a tier, summed with the weights of a query's terms, and the sums of the tiers, each times what the tier adds
at most to a document of that length, give an upper bound of every document's score:

1. the documents with the greatest bounds are scored exactly, which gives the score that a result must reach at least;
2. every document whose bound reaches it (equal bounds: whose id may still come first) is scored exactly, out of its text. All others are provably no result.

Tasks hold a block and the sums of a slice's queries for it. What leaves a task is k rows a query in step 1, candidates in step 2, of equal texts k a query at most, as no
more of them can be results. Documents without terms (null and empty texts too) are not indexed and never found; repeated rows are documents of their own; a null doc_id comes last
among equal scores. Rows of one item_id are one query with the terms of all; items without terms have no results. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricerank.llm.common import WordHashes, byte_lists, mix64, pieces, stored

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case. As a table of bytes and as a pattern.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Occurrences from which a term counts for a tier.
TIERS = (1, 2, 3, 5, 9, 17)
#: Bits that a term and tier sets; rows of a block for each of a document's (about 0.5 % of the bits of other documents are set by chance).
HASHES, ROWS_EACH = 5, 12
#: Documents of a block at most, and their terms and tiers (a longer document is a block of its own). Terms and queries of a slice of queries, about. Candidates that are broadcast at most.
BLOCK_DOCS, BLOCK_SLOTS, SLICE_TERMS, SLICE_ITEMS, BROADCAST_PAIRS = 2_048, 1 << 19, 100_000, 2_000, 200_000
#: Terms whose counts a task sums up before it passes them on.
COUNTED = 300_000


class Index(NamedTuple):
    """blocks: doc_ids, hashes (of the texts), sizes (terms with repeats), slices (rows of bits), bits. terms: term, df. n_docs, n_terms: totals."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def bit_rows(keys: np.ndarray, slices: int) -> np.ndarray:
    """The rows (one line of HASHES for each key) that a term and tier has in a block."""
    step = mix64(keys) | np.uint64(1)
    return np.stack([((keys + np.uint64(k) * step) % np.uint64(slices)).astype(np.int64) for k in range(HASHES)], axis=1)


def tier_keys(hashes: np.ndarray, tier: int) -> np.ndarray:
    return mix64(hashes + np.uint64(tier))


def _slices(slots: int) -> tuple[int, int]:
    """Length class of a document and the rows of a block of that class."""
    most = 1 << max(4, (slots - 1).bit_length())
    return most, ROWS_EACH * most


def block_bits(keys: list[np.ndarray], slices: int) -> bytes:
    """The bits of documents with these keys, row after row, eight documents a byte."""
    bits = np.zeros((slices, -(-len(keys) // 8) * 8), bool)
    column = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    for row in bit_rows(np.concatenate(keys), slices).T:
        bits[row, column] = True
    return np.packbits(bits, axis=1).tobytes()


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = {"term": pa.string(), "df": pa.int64(), "doc_ids": None, "hashes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "slices": pa.int64(), "bits": pa.binary()}

    def rows(**columns) -> pa.RecordBatch:
        length = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * length), t) for c, t in fields.items()], names=list(fields))

    def block(docs: list[tuple], slices: int) -> pa.RecordBatch:
        ids, hashes, sizes, keys = zip(*docs)
        return rows(doc_ids=[list(ids)], hashes=[list(hashes)], sizes=[list(sizes)], slices=[slices], bits=[block_bits(keys, slices)])

    known, df, open_blocks = WordHashes(), Counter(), {}
    for batch in batches:
        fields["doc_ids"] = pa.list_(batch.schema.field(0).type)
        for doc, text, content in zip(batch.column(0).to_pylist(), byte_lists(batch), batch.column(2).to_pylist()):
            tf = Counter(words := terms_of(text))
            if not tf:
                continue
            df.update(tf.keys())
            hashes, number = known.of(list(tf)), np.fromiter(tf.values(), np.int64, len(tf))
            keys = np.concatenate([tier_keys(hashes[number >= least], tier) for tier, least in enumerate(TIERS)])
            most, slices = _slices(len(keys))
            docs = open_blocks.setdefault(slices, [])
            docs.append((doc, content, len(words), keys))
            if len(docs) >= BLOCK_DOCS or len(docs) * most >= BLOCK_SLOTS:
                yield block(open_blocks.pop(slices), slices)
        if len(df) > COUNTED:
            yield rows(term=[t.decode() for t in df], df=list(df.values()))
            df.clear()
    for slices, docs in open_blocks.items():
        yield block(docs, slices)
    if df:
        yield rows(term=[t.decode() for t in df], df=list(df.values()))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))


def build_index(docs: DataFrame) -> Index:
    """The signatures of all documents and the document frequency of all terms, as stored tables."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stored(_keyed(docs).mapInArrow(_indexer, f"term string, df long, doc_ids array<{kind}>, hashes array<long>, sizes array<long>, slices long, bits binary"))
    blocks = made.where("slices IS NOT NULL").select("doc_ids", "hashes", "sizes", "slices", "bits")
    terms = made.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    total = blocks.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Index(blocks, terms, total[0] or 0, total[1] or 0)


class Queries:
    """A slice of queries: their terms, of those that documents hold, with weights."""

    def __init__(self, index: Index, items: list[tuple[object, list[str]]], df: dict[str, int]):
        self.n_docs, self.n_terms = index.n_docs, index.n_terms
        held = sorted(df)
        place = {t: k for k, t in enumerate(held)}
        self.items = [i for i, _ in items]
        self.terms = [np.array(sorted(place[t] for t in terms if t in place), np.int64) for _, terms in items]
        self.weight = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df[t] + 1))) for t in held], np.int64)
        self.names = [t.encode() for t in held]
        self.hashes = WordHashes().of(self.names)

    def norm(self, size):
        """m of documents of this many terms."""
        return 50 + (50 * size * self.n_docs) // self.n_terms

    def part(self, tf, size):
        """What a term that occurs so often adds, per weight."""
        return (1_000_000_000 * tf) // (1_000 * tf + 20 * self.norm(size))

    def bounds(self, slices: int, bits: bytes, sizes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, by query and document of a block."""
        rows = np.frombuffer(bits, np.uint8).reshape(slices, -1)
        out, below = np.zeros((len(self.items), len(sizes)), np.int64), 0
        for tier, _ in enumerate(TIERS):
            upto = self.part(TIERS[tier + 1] - 1, sizes) if tier + 1 < len(TIERS) else np.full(len(sizes), 1_000_000)
            place = bit_rows(tier_keys(self.hashes, tier), slices)
            there = rows[place[:, 0]]
            for k in range(1, HASHES):
                there &= rows[place[:, k]]
            some = there.any(axis=1)
            for k, terms in enumerate(self.terms):
                mine, total = terms[some[terms]], 0
                for at in range(0, len(mine), 1_000):
                    part = mine[at : at + 1_000]
                    total = total + self.weight[part].astype(np.float64) @ np.unpackbits(there[part], axis=1, count=len(sizes)).astype(np.float64)
                if len(mine):
                    out[k] += (upto - below) * total.astype(np.int64)
            below = upto
        return out

    def score(self, tf: Counter, size: int, query: int) -> int:
        return sum(int(self.weight[t]) * self.part(n, size) for t in self.terms[query].tolist() if (n := tf.get(self.names[t])))


def _scan(queries, k: int, least: dict[int, tuple] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query, bound, doc_id, content: without `least` the k greatest bounds of each query in this task, with it (score and id that a query's k-th result has at least) all that may be results."""

    def rows(batch: pa.RecordBatch, picked: dict[int, list[tuple]]) -> pa.RecordBatch:
        flat = [(q, bound, doc, content) for q, found in picked.items() for bound, doc, content in found]
        columns = zip(*flat) if flat else [[]] * 4
        kinds = pa.int32(), pa.int64(), batch.schema.field("doc_ids").type.value_type, pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["query", "bound", "doc_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        equal: Counter = Counter()
        last = None
        for batch in pieces(batches, 1):
            last = batch
            ids, contents, sizes = (batch.column(c)[0].as_py() for c in ("doc_ids", "hashes", "sizes"))
            bounds = queries.value.bounds(batch.column("slices")[0].as_py(), batch.column("bits")[0].as_py(), np.array(sizes, np.int64))
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            picked: dict[int, list[tuple]] = {}
            for q, row in enumerate(bounds):
                if least is None:
                    at = np.flatnonzero(row)
                    if len(at) > k:
                        at = at[np.argpartition(-(row[at] * len(ids) - rank[at]), k - 1)[:k]]
                    own = best.setdefault(q, [])
                    own += [(int(row[i]), ids[i], contents[i]) for i in at.tolist()]
                    if len(own) > 4 * k:
                        best[q] = _top(own, k)
                    continue
                bar, bar_id = least.get(q, (1, None))
                at = np.flatnonzero(row >= bar)
                at = at[np.argsort(rank[at])]
                found = []
                for i in at.tolist():
                    if row[i] == bar and bar_id is not None and (ids[i] is None or ids[i] > bar_id):
                        continue
                    found.append((int(row[i]), ids[i], contents[i]))
                picked[q] = found
            if least is not None:
                yield rows(batch, {q: _first_of_equal(found, k) for q, found in picked.items() if found})
        if least is None and last is not None:
            yield rows(last, {q: _top(found, k) for q, found in best.items()})

    return run


def _top(found: list[tuple], k: int) -> list[tuple]:
    """The k greatest, equal ones by least id, null last."""
    return heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))


def _first_of_equal(found: list[tuple], k: int) -> list[tuple]:
    """Of equal texts, which come by id, the first k: before any other stand k results that are as good."""
    seen: Counter = Counter()
    out = []
    for x in found:
        seen[x[2]] += 1
        if seen[x[2]] <= k:
            out.append(x)
    return out


def _scorer(queries, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query, doc_id, score: the exact scores of each document's listed queries, of a task's the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text, listed in zip(batch.column(0).to_pylist(), byte_lists(batch), batch.column(2).to_pylist()):
                tf = Counter(words := terms_of(text))
                for q in listed:
                    if score := queries.value.score(tf, len(words), q):
                        own = best.setdefault(q, [])
                        own.append((score, doc))
                        if len(own) > 20 * k:
                            best[q] = _top(own, k)
        if best:
            flat = [(q, doc, score) for q, found in best.items() for score, doc in _top(found, k)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flat), (pa.int32(), kind, pa.int64()))], names=["query", "doc_id", "score"])

    return run


def _scored(docs: DataFrame, pairs: DataFrame, queries, k: int) -> DataFrame:
    """query, doc_id, score, rank of the pairs (query, doc_id, content): the k best of each query."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = stored(pairs.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.collect_set("query").alias("queries")))
    few = listed.agg(F.sum(F.size("queries"))).first()[0] or 0
    own = _keyed(docs)
    chosen = own.join(F.broadcast(listed) if few <= BROADCAST_PAIRS else listed, (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "queries")
    found = chosen.mapInArrow(_scorer(queries, k), f"query int, doc_id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0; docs is what the index was built of."""
    spark = docs.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("item_id", items), ("doc_id", docs))}
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    asked = stored(asked)
    size = asked.agg(F.count("*").alias("terms"), F.approx_count_distinct("item_id").alias("items")).first()
    slices = max(size.terms // SLICE_TERMS, size["items"] // SLICE_ITEMS) + 1
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    parts = []
    for s in range(slices):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s)
        df = {r.term: r.df for r in index.terms.join(mine.select("term").distinct(), "term").collect()}
        listed = sorted(((r.item_id, r.terms) for r in mine.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).collect()), key=lambda x: (x[0] is None, x[0]))
        if not df:
            continue
        queries = spark.sparkContext.broadcast(Queries(index, listed, df))
        scanned = f"query int, bound long, doc_id {kinds['doc_id']}, content long"
        greatest = Window.partitionBy("query").orderBy(F.col("bound").desc(), F.col("doc_id").asc_nulls_last())
        seeds = stored(index.blocks.mapInArrow(_scan(queries, k, None), scanned)).withColumn("_n", F.row_number().over(greatest)).where(F.col("_n") <= k)
        reached = _scored(docs, seeds.select("query", "doc_id", "content"), queries, k).where(F.col("rank") == k).collect()
        least = {r["query"]: (r["score"], r["doc_id"]) for r in reached}
        candidates = stored(index.blocks.mapInArrow(_scan(queries, k, least), scanned))
        found = _scored(docs, candidates.select("query", "doc_id", "content"), queries, k)
        names = spark.createDataFrame(list(enumerate(queries.value.items)), f"query int, item_id {kinds['item_id']}")
        parts.append(stored(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))
    for part in parts:
        out = out.unionByName(part)
    return out


def report(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    return search(build_index(docs), docs, items, k)
