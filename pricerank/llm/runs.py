"""Periodic runs of words, found in a grammar.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, EXPONENT * q) words that no neighbouring word extends. Each task takes its documents in
batches of bounded length and works on all of a batch at once, in numpy:

* repair(): Re-Pair of each document's word ids. A round replaces the pairs that are more frequent in their document than both pairs that overlap them, until no pair of a
  document repeats. What is left of a document is its start rule, taken as a balanced binary tree;
* crossing(): the runs that cross the boundary between a nonterminal's two parts, once for each nonterminal, in one of its expansions. Of a run of exponent 4 or more, one
  side of the boundary holds two periods, so four words about the boundary occur again one period further: those places are the candidates, a hash of one period tells most of the
  wrong ones, and the words themselves decide;
* translated(): each such run at all places where its nonterminal is derived;
* merged(): intervals of one period that share a period become one. A run stands whole in the lowest nonterminal that derives all of it, so what is cut at the edge of
  a nonterminal merges into it.

Documents have nothing to do with each other, so nothing is shuffled. Null and empty texts have no words and no runs; a very long text is a batch of its own, which takes about
200 bytes a word; repeated rows give a row each; empty tables none. Ids of any type, nulls included, and extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import WORD, byte_lists, mix64

#: A run has this many words, and this many periods, at least.
LEAST, EXPONENT = 6, 4
#: Words and documents of a batch; a longer document is a batch of its own. Candidates that are tested at once.
BATCH_WORDS, BATCH_DOCS, TESTED = 300_000, 2_000, 2_000_000
#: Words that stand about a boundary and must occur again one period on; shorter periods are looked at directly.
GRAM = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


class Grammar(NamedTuple):
    """Symbols below `terminals` are words, others rules. start: the symbols left and where each begins in the batch's words; left, right, first (where a rule's
    first expansion begins): by rule; size: by symbol; rounds: the last rule of each round, so that parts of a rule come from earlier rounds."""

    terminals: int
    start: tuple[np.ndarray, np.ndarray]
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    size: np.ndarray
    rounds: list[int]


def repair(words: np.ndarray, doc: np.ndarray) -> Grammar:
    """The grammar of each document (equal numbers in doc, in one piece) of the word ids; rules are of one document."""
    terminals = int(words.max(initial=-1)) + 1
    most = terminals + len(words)
    symbol, place = words.astype(np.int64), np.arange(len(words))
    live = np.ones(len(words), bool)  # whether the pair that begins here may repeat
    left, right, first, size, rounds, done = [], [], [], [np.ones(terminals, np.int64)], [], []
    sizes = size[0]
    while True:
        owner = doc[place]
        live[:-1] &= owner[:-1] == owner[1:]
        live[-1:] = False
        at = np.flatnonzero(live)
        at = at[_alternate(at, symbol)]
        key = (owner[at] * most + symbol[at]) * most + symbol[at + 1]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=-1))
        group = np.empty(len(at), np.int64)
        group[order] = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(at)))
        count = np.bincount(group, minlength=len(edge))
        twice = count[group] > 1
        live[at[~twice]] = False
        at, group = at[twice], group[twice]
        if not len(at):
            break
        rank = np.zeros(len(symbol) + 1, np.int64)
        rank[at] = count[group] * (len(edge) + 1) + len(edge) - group
        chosen = (rank[at] > rank[at + 1]) & (rank[at] > rank[at - 1])
        at, group = at[chosen], group[chosen]
        again = np.bincount(group, minlength=len(edge))[group] > 1
        at, group = at[again], group[again]
        _, one, rule = np.unique(group, return_index=True, return_inverse=True)
        left.append(symbol[at[one]])
        right.append(symbol[at[one] + 1])
        first.append(place[at[one]])
        size.append(sizes[left[-1]] + sizes[right[-1]])
        symbol[at] = len(sizes) + rule
        sizes = np.concatenate([sizes, size[-1]])
        rounds.append(len(sizes) - terminals)
        live[at] = live[at - 1] = True  # these pairs are new; at -1, of the last place, there is none
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        active = np.zeros(int(owner[-1]) + 1, bool)
        active[owner[live]] = True
        ended = keep & ~active[owner]
        if 2 * ended.sum() > len(keep):  # documents without a pair that repeats go, so that rounds get shorter
            done.append((symbol[ended], place[ended]))
            keep &= ~ended
        symbol, place, live = symbol[keep], place[keep], live[keep]
    symbol, place = (np.concatenate(x) for x in zip(*done, (symbol, place)))
    order = np.argsort(place)
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Grammar(terminals, (symbol[order], place[order]), joined(left), joined(right), joined(first), sizes, rounds)


def _alternate(at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Of the pairs that begin at these places: whether one counts. Of overlapping pairs of one symbol every other does."""
    same = symbol[at] == symbol[at + 1]
    begins = same & ~(np.concatenate([[False], same[:-1]]) & (np.diff(at, prepend=-2) == 1))
    start = np.maximum.accumulate(np.where(begins, at, 0))
    return ~same | ((at - start) % 2 == 0)


def nodes(grammar: Grammar, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rule (-1: of the start rule's tree), begin, middle, end of each nonterminal's expansion, those of LEAST words at least."""
    _, place = grammar.start
    owner = doc[place]
    opening = np.maximum.accumulate(np.where(np.diff(owner, prepend=-1) != 0, np.arange(len(place)), 0))
    number = np.arange(len(place)) - opening
    symbols = np.bincount(owner, minlength=int(doc[-1]) + 2)
    ends = np.append(place, len(doc))
    at = np.flatnonzero(number)
    half = number[at] & -number[at]
    last = opening[at] + np.minimum(number[at] + half, symbols[owner[at]])
    right = grammar.first + grammar.size[grammar.terminals :]
    rule = np.concatenate([np.full(len(at), -1), np.arange(len(grammar.left))])
    begin = np.concatenate([place[at - half], grammar.first])
    middle = np.concatenate([place[at], grammar.first + grammar.size[grammar.left]])
    end = np.concatenate([ends[last], right])
    long = end - begin >= LEAST
    return rule[long], begin[long], middle[long], end[long]


def crossing(words: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, start, length, period) of the runs of each node's expansion that cross its middle, as long as they are within it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for node, period, inside in _candidates(words, begin, middle, end):
        known = found.setdefault(node, [])
        # what a run of a divisor of the period holds has that smaller period, as far as it goes
        if any(period % q == 0 and start <= inside and inside + period < stop for start, stop, q in known):
            continue
        start, stop = _stretch(words, period, inside, int(begin[node]), int(end[node]))
        if stop - start >= max(LEAST, EXPONENT * period) and _smallest(words[start:stop], period):
            known.append((start, stop, period))
    return [(node, start, stop - start, period) for node, known in found.items() for start, stop, period in known]


def _candidates(words: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(node, period, place that equals the one a period on)."""
    same = lambda x, y: (x >= begin) & (y < end) & (words.take(x, mode="clip") == words.take(y, mode="clip"))
    one, two = ([same(middle + k, middle + k + q) for k in range(-3, 2)] for q in (1, 2))
    near = [(1, -1, one[2] & (one[0] & one[1] | one[3] & one[4])), (2, -1, two[2] & two[3]), (2, -2, two[0] & two[1])]
    for period, shift, fits in near:
        for node in np.flatnonzero(fits).tolist():
            yield node, period, int(middle[node]) + shift
    if len(words) < 2 * GRAM:
        return
    n = len(words)
    h = mix64(words.astype(np.uint64) + np.uint64(1))
    gram = h[: n - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = gram * BASE + h[k : n - GRAM + 1 + k]
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
    order = np.argsort(gram, kind="stable")
    group_of_sorted = np.cumsum(np.diff(gram[order], prepend=gram[order[:1]]) != 0)
    group = np.empty(len(gram), np.int64)
    group[order] = group_of_sorted
    several = np.bincount(group)[group] > 1
    place = group_of_sorted * n + order  # in ascending order
    # one period further on (to the right), or back (to the left)
    for right in (True, False):
        most = ((end - middle) if right else (middle - begin)) // 2
        at = middle - (1 if right else GRAM - 1)
        node = np.flatnonzero(most >= GRAM - 1)
        node = node[several[np.minimum(at[node], len(gram) - 1)] & (at[node] < len(gram))]
        own, far = group[at[node]] * n + at[node], most[node]
        low = np.searchsorted(place, own + GRAM - 1 if right else own - far)
        high = np.searchsorted(place, own + far if right else own - GRAM + 1, "right")
        node, low, number = node[high > low], low[high > low], (high - low)[high > low]
        for part in _parts(number):
            k = np.repeat(node[part], number[part])
            t = np.repeat(low[part] - np.concatenate([[0], np.cumsum(number[part])[:-1]]), number[part]) + np.arange(len(k))
            period = np.abs(order[t] - at[k])
            x = middle[k] - 1 if right else middle[k] - 2 * period
            y, length = x + period, period + 1
            equal = np.flatnonzero((total[x + length] - total[x]) * power[period] == total[y + length] - total[y])
            equal = equal[np.argsort(period[equal], kind="stable")]
            inside = x if right else middle[k] - period
            yield from zip(k[equal].tolist(), period[equal].tolist(), inside[equal].tolist())


def _parts(number: np.ndarray) -> Iterator[slice]:
    """Slices with about TESTED in all of these numbers."""
    cut = np.concatenate([[-1], np.cumsum(number) // TESTED])
    edge = [*np.flatnonzero(np.diff(cut)).tolist(), len(number)]
    yield from (slice(a, b) for a, b in zip(edge, edge[1:]) if b > a)


def _stretch(words: np.ndarray, period: int, inside: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch within begin and end that keeps the period and holds `inside` and the place a period on; empty if these differ."""
    if words[inside] != words[inside + period]:
        return inside, inside
    start, stop, step = inside, inside + 1, 32
    while stop < end - period:
        upto = min(stop + step, end - period)
        odd = np.flatnonzero(words[stop:upto] != words[stop + period : upto + period])
        stop = stop + int(odd[0]) if len(odd) else upto
        if len(odd):
            break
        step *= 2
    step = 32
    while start > begin:
        down = max(start - step, begin)
        odd = np.flatnonzero(words[down:start] != words[down + period : start + period])
        start = down + int(odd[-1]) + 1 if len(odd) else down
        if len(odd):
            break
        step *= 2
    return start, stop + period


def _smallest(stretch: np.ndarray, period: int) -> bool:
    """Whether a stretch of several periods has no smaller one; that would divide it."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            q = period // factor
            if (stretch[:-q][:32] == stretch[q:][:32]).all() and (stretch[:-q] == stretch[q:]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def translated(grammar: Grammar, rule: np.ndarray, begin: np.ndarray, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of crossing() at all places where their nodes are derived."""
    out, by_rule = [], {}
    for node, start, length, period in found:
        if rule[node] < 0:
            out.append((start, length, period))
        else:
            by_rule.setdefault(int(rule[node]) + grammar.terminals, []).append((start - int(begin[node]), length, period))
    if not by_rule:
        return out
    own = np.zeros(len(grammar.size), bool)
    own[list(by_rule)] = True
    holds, low = own.copy(), 0
    for high in grammar.rounds:
        k = np.arange(low, high)
        holds[grammar.terminals + k] |= holds[grammar.left[k]] | holds[grammar.right[k]]
        low = high
    symbol, place = grammar.start
    while len(symbol):
        symbol, place = symbol[holds[symbol]], place[holds[symbol]]
        for s, p in zip(symbol[own[symbol]].tolist(), place[own[symbol]].tolist()):
            out += [(p + start, length, period) for start, length, period in by_rule[s]]
        rules = symbol - grammar.terminals
        left = grammar.left[rules]
        symbol, place = np.concatenate([left, grammar.right[rules]]), np.concatenate([place, place + grammar.size[left]])
        symbol, place = symbol[symbol >= grammar.terminals], place[symbol >= grammar.terminals]
    return out


def merged(intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period: intervals of one period that share at least a period are one."""
    done: list[list[int]] = []
    for period, start, length in sorted((q, s, n) for s, n, q in intervals):
        if done and done[-1][2] == period and start + period <= done[-1][0] + done[-1][1]:
            done[-1][1] = max(done[-1][1], start + length - done[-1][0])
        else:
            done.append([start, length, period])
    return sorted((s, n, q) for s, n, q in done)


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, a list of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    ids = _Ids()
    words = np.fromiter((i for t in texts for i in map(ids.__getitem__, t)), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(texts)), lengths)
    opening = np.cumsum(lengths) - lengths
    grammar = repair(words, doc)
    rule, begin, middle, end = nodes(grammar, doc)
    for start, length, period in merged(translated(grammar, rule, begin, crossing(words, begin, middle, end))):
        k = int(doc[start])
        out[k].append((start - int(opening[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
    return b" ".join(words)


def _batches(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    part, total = [], 0
    for words in ((t or b"").split() for t in texts):
        if part and (total + len(words) > BATCH_WORDS or len(part) == BATCH_DOCS):
            yield part
            part, total = [], 0
        part.append(words)
        total += len(words)
    if part:
        yield part


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        at = 0
        for texts in _batches(byte_lists(batch)):
            each = find(texts)
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in each], kind)
            kept = pa.array([collapsed(t, runs).decode() for t, runs in zip(texts, each)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])
            at += len(texts)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without the words that repeat a period) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth of the documents, told by crc32 of the id, end in a repeated passage: from word a on they repeat p words. Null ids and texts without words stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, w).alias("w")).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    placed = some.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    edited = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document of find_runs(): n_runs, the longest run (ties: first start, least period) with exponent_milli, and sha256 of the runs as lines and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = find_runs(docs).withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )


def brute_force(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a short text from the definition, for tests."""
    found, n = {}, len(words)
    for q in range(1, n // EXPONENT + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop - start + q >= max(LEAST, EXPONENT * q) and not any(q % p == 0 and s <= start and stop + q <= s + m for s, m, p in found):
                found[start, stop - start + q, q] = None
            start = stop + 1
    return sorted(found)
