"""Document fingerprints by context-triggered piecewise hashing.

A hash of each byte with the 15 before it tells where a text is cut: a place ends a chunk at block size 2^j if the lowest j bits of its hash are ones, so that an edit moves only the cuts about it. The block
size is the least, from 4, that gives CHUNKS chunks at most, whatever the text's length; where that would be less than a quarter of them, as in texts that repeat one line, it is the size before, with
all that follows the first chunks as the last one. A chunk is written as one of 64 characters, by a hash of its bytes; a fingerprint is the block size, the
characters of its chunks, and those at twice the size: `64:aB3...:x9...`. Two fingerprints are compared where their block sizes are the same, or one is twice the other, by the edit
distance (insertions and deletions) of the characters.

A text's hash is of all its bytes (UTF-8). Null and empty texts have the fingerprint `4::`, very long ones one as short as others; they take about 40 bytes of memory a byte. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricerank.llm.common import byte_lists, mix64, numbered, stored

#: Bytes of the rolling hash (a power of two); chunks of a fingerprint at most; least exponent of the block size; characters in a row that two fingerprints must share to be alike at all.
WINDOW, CHUNKS, LEAST_BITS, SHARED = 16, 64, 2, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BASE = 0x9E3779B97F4A7C15
ROLL = 0x01000193
#: Powers of the bases are kept up to this length of text.
KEPT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... up to n, modulo 2^64."""
    if n > KEPT or base not in _powers:
        made = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, KEPT), base, np.uint64)]))
        if n > KEPT:
            return made
        _powers[base] = made
    return _powers[base]


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of each byte and those before it, WINDOW in all; before the text stand zeros."""
    total, width = data.astype(np.uint32) + np.uint32(1), 1
    while width < min(WINDOW, len(data)):
        more = total.copy()
        more[width:] += total[:-width] * np.uint32(pow(ROLL, width, 1 << 32))
        total, width = more, 2 * width
    total ^= total >> np.uint32(16)
    total *= np.uint32(0x85EBCA6B)
    total ^= total >> np.uint32(13)
    return total


def _signature(sums: np.ndarray, cuts: np.ndarray, size: int) -> str:
    """A character for each chunk; cuts are the last bytes of chunks, what follows the last is one more."""
    edges = np.concatenate([[0], cuts + 1, [size]] if not len(cuts) or cuts[-1] != size - 1 else [[0], cuts + 1]).astype(np.int64)
    value = (sums[edges[1:]] - sums[edges[:-1]]) * _power(pow(BASE, -1, 1 << 64), size)[edges[:-1]]
    return ALPHABET[(mix64(value) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes | None) -> str:
    """`block size:characters:characters at twice the size`."""
    if not text:
        return f"{1 << LEAST_BITS}::"
    data = np.frombuffer(text, np.uint8)
    hashes, bits = rolling(data), LEAST_BITS
    low = np.uint32((1 << bits) - 1)
    cuts = np.flatnonzero((hashes & low) == low)
    finer = lambda at, bit: at[(hashes[at] >> np.uint32(bit)) & np.uint32(1) == 1] if bit < 32 else at[:0]
    coarse = finer(cuts, bits)
    while len(cuts) >= CHUNKS and len(coarse) >= CHUNKS // 4:
        cuts, bits = coarse, bits + 1
        coarse = finer(cuts, bits)
    cuts, coarse = cuts[: CHUNKS - 1], coarse[: CHUNKS - 1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data))[: len(data)])])
    return f"{1 << bits}:{_signature(sums, cuts, len(data))}:{_signature(sums, coarse, len(data))}"


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that make b of a, by the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def _alike(a: str, b: str) -> float:
    """1 less the distance as a share of both lengths; 0 if no SHARED characters in a row (or as many as the shorter has) stand in both."""
    run = min(SHARED, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def likeness(a: str | None, b: str | None) -> float | None:
    """0 to 1, of two fingerprints; 1 for equal ones, null if one is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (size, one, two), (size2, one2, two2) = ((int(s), x, y) for s, x, y in (f.split(":") for f in (a, b)))
    if size == size2:
        return max(_alike(one, one2), _alike(two, two2))
    return _alike(one, two2) if size == 2 * size2 else _alike(two, one2) if size2 == 2 * size else 0.0


def fingerprinted(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """All rows and columns of docs, with the fingerprint of `text`; a column of that name is replaced."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t) for t in byte_lists(batch, f"c{names.index('text')}")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "f"])

    own = numbered(docs)
    out = own.mapInArrow(run, StructType([*own.schema.fields, StructField("f", StringType())]))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != column]
    return out.select(*kept, F.col("f").alias(column))


def compared(pairs: DataFrame, a: str = "a", b: str = "b", column: str = "likeness") -> DataFrame:
    """Adds the likeness of the fingerprints in the columns a and b."""
    alike = F.udf(likeness, "double", useArrow=True)
    return pairs.withColumn(column, alike(F.col(a), F.col(b)))


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(text: bytes | None, after: bytes | None, own: str, following: str) -> dict:
    """A document's result, from its text and the next one's, and both fingerprints."""
    chars = (text or b"").decode()
    n = len(chars)
    edited = (chars[: n - n // 4] + (after or b"").decode()[: n // 4]).encode()
    other = fingerprint(edited)
    return {"n_chars": n, "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": own, "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, following)}


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: results of all rows but the last, which has its text instead, and the text of the first as a row of its own (edge: first, last)."""
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()]
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]

    def rows(ids: pa.Array, found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *[pa.array([f.get(c) for f in found], t) for c, t in zip(names, kinds)]], names=["doc_id", *names])

    last = None
    for batch in batches:
        found, texts = [], byte_lists(batch)
        marks = [fingerprint(t) for t in texts]
        part = batch.column(2)[0].as_py() if batch.num_rows else None
        if last is None and texts:
            yield rows(batch.column(0).slice(0, 1), [{"part": part, "edge": "first", "text": (texts[0] or b"").decode()}])
        held = ([last] if last else []) + list(zip(texts, marks))
        for (text, mark), (after, following) in zip(held, held[1:]):
            found.append(_row(text, after, mark, following))
        if texts:
            before = batch.column(0).slice(0, len(texts) - 1)
            ids = pa.concat_arrays([last_id, before]) if last else before
            yield rows(ids, found)
            last, last_id = held[-1], batch.column(0).slice(len(texts) - 1, 1)
    if last:
        yield rows(last_id, [{"part": part, "edge": "last", "text": (last[0] or b"").decode()}])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_row(t, a, fingerprint(t), fingerprint(a)) for t, a in zip(byte_lists(batch), byte_lists(batch, "after"))]
        columns = RESULT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[c] for f in found], t) for c, t in zip(columns, kinds)]], names=["doc_id", *columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each document against its text with the last quarter replaced by
    the start of the next document, and against that document.

    Next is the row that follows by doc_id (null last, then by the text's hash; rows that repeat whole in any order), after the last the first. Rows are dealt by ranges of that order, once, with
    their texts; a task works along its range, and only the texts at its two ends are kept, to be paired with those of the ranges beside it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_last(), F.col("_hash").asc(), F.col("_n").asc()]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_n"))
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = stored(dealt.mapInArrow(_in_order, f"doc_id {kind}, {RESULT}, part int, edge string, text string"))
    first = made.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = made.where("edge = 'last'").select("doc_id", "text", "part")
    # a row for each range
    along = last.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    ends = last.join(along, "part").join(first, "next").select("doc_id", "text", "after").mapInArrow(_pairs, f"doc_id {kind}, {RESULT}")
    return made.where("edge IS NULL").drop("part", "edge", "text").unionByName(ends)
