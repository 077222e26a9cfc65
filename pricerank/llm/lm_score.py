"""LM scoring with a hidden Markov language model.

Words are counted over all training documents, and each of them is a symbol of the model with emissions of its own. Words that training lacks share the
smoothing alone. Emissions of the most frequent words (at most MODEL_WORDS and TABLE_WORDS) go out by broadcast; those of others are a stored table keyed by
word, joined to the documents for each iteration, so that the bound is one of memory and not of the model.
Baum-Welch runs over all training documents: each task adds up the expected counts of its texts, a grouped sum adds the tasks'. A word seen fewer
than LATE times tells the states nothing at first: up to the last iteration its emission is its share of the tokens in every state (which leaves the states' posteriors as
they are), and the last iteration learns it from its expected counts like all others. The rule goes by a word's count, whatever the size of the corpus. Texts
are run as segments side by side, whose transfer matrices carry the messages from one to the next in both directions.
Scoring multiplies scaled transfer matrices of segments, which is the forward recursion of the whole text, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricerank.llm.common import byte_lists, discard, mix64, pieces, remainder, stored

STATES, ITERATIONS, SEGMENT = 6, 6, 128
#: Texts of more segments are run as segments side by side; all others step by step, each beside the others.
LOCKSTEP = 16
#: Words whose emissions and counts are broadcast, at most; where the two are cut changes no result.
MODEL_WORDS, TABLE_WORDS = 400_000, 400_000
#: Words seen less often are learned in the last iteration only.
LATE = 16
#: Added to a word's expected emissions in each state.
SMOOTH = 0.05
#: Training tokens of a task, about: each task sends the sums of all its words.
TASK_TOKENS = 16_000_000
#: Symbols whose sums travel as one row, and tokens of the corpus for each bucket of the words outside the broadcast.
CHUNK, BUCKET_TOKENS = 1024, 500_000
#: Tokens of the texts that are run beside each other, about.
BESIDE = 1_500_000
#: Bins of a power of two of the count, by which the tables are cut.
BINS = 16
#: Words that a task numbers at once.
KNOWN_WORDS = 300_000
WEIGHTS = [f"s{k}" for k in range(STATES)]


class Numbers(dict):
    """word -> a number by first appearance, for the words of some texts; hashes() has their 64-bit hashes."""

    def __init__(self):
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.words)
        self.words.append(word)
        return value

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts (words, then an end each: the empty word, which no text has) and where each text begins."""
        each = [[*(t or b"").lower().split(), b""] for t in texts]
        size = np.array([len(x) for x in each], np.int64)
        return np.fromiter(map(self.__getitem__, chain.from_iterable(each)), np.int64, size.sum()), np.cumsum(size) - size

    def hashes(self, first: int = 0) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, islice(self.words, first, None)), np.uint64, len(self.words) - first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, counts = Numbers(), np.zeros(0, np.int64)
    for batch in pieces(batches, 1_000):
        more = np.bincount(known.of(byte_lists(batch))[0], minlength=len(counts))
        more[: len(counts)] += counts
        counts = more
        if len(known) > KNOWN_WORDS:
            yield pa.RecordBatch.from_arrays([pa.array(known.hashes().view(np.int64)), pa.array(counts)], names=["word", "n"])
            known, counts = Numbers(), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(known.hashes().view(np.int64)), pa.array(counts)], names=["word", "n"])


class Counts:
    """What one broadcast holds of the counts: words with a count above a bound, by their number; `others` is the table of those below it that are seen LATE times at least."""

    def __init__(self, counts: DataFrame):
        bin_of = F.floor(F.log2("n") * BINS).cast("int")
        bins = sorted(((r.bin, r.words) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
        low = max(_lowest(bins, min(MODEL_WORDS, TABLE_WORDS)), math.ceil(math.log2(LATE) * BINS))
        rows = counts.where(bin_of >= low).select("word", "n").toArrow()
        word = rows["word"].to_numpy().view(np.uint64)
        order = np.argsort(word)
        self.word, self.n = word[order], rows["n"].to_numpy()[order]
        self.often = np.argsort(-self.n, kind="stable")  # the symbols' words: small numbers are frequent ones, which compress well
        self.symbol = np.empty(len(word), np.int32)
        self.symbol[self.often] = np.arange(len(word), dtype=np.int32)
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("words")).first()
        self.total, self.words = totals.n, totals.words
        self.others = counts.where(bin_of < low).where(F.col("n") >= LATE).select("word", "n")
        self.n_others = self.others.count()

    def __getstate__(self) -> dict:
        return {"word": self.word, "n": self.n, "symbol": self.symbol}


def _planes(symbols: np.ndarray) -> bytes:
    """The symbols' first bytes, then their second ones, and so on, as the last are mostly 0."""
    return symbols.view(np.uint8).reshape(-1, 4).T.tobytes()


def _symbols(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _lowest(bins: list[tuple[int, int]], most: int) -> int:
    """The lowest bin down to which no more than `most` words lie."""
    low, words = (bins[0][0] + 1 if bins else 0), 0
    for b, n in bins:
        if (words := words + n) > most:
            break
        low = b
    return low


def _encoded(counts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = counts.value, None
        for batch in pieces(batches, 1_000):
            if known is None or len(known) > KNOWN_WORDS:
                known, word, symbol_of, base_of = Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0)
            ids, start = known.of(byte_lists(batch))
            if len(known) > len(word):
                new = known.hashes(len(word))
                at = np.minimum(np.searchsorted(c.word, new), max(0, len(c.word) - 1))
                there = c.word[at] == new if len(c.word) else np.zeros(len(new), bool)
                word = np.concatenate([word, new])
                symbol_of = np.concatenate([symbol_of, np.where(there, c.symbol[at], len(c.word)) if len(c.word) else np.zeros(len(new))]).astype(np.int32)
                base_of = np.concatenate([base_of, np.where(there, np.log10(c.n[at] + 1), 0.0) if len(c.word) else np.zeros(len(new))])
            symbol = symbol_of[ids]
            found = symbol < len(c.word)
            size = np.diff(np.append(start, len(ids)))
            rare = np.add.reduceat((~found).astype(np.int64), start)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(size),
                    pa.array(np.add.reduceat(found.astype(np.int64), start)),
                    pa.array(np.add.reduceat(base_of[ids], start)),
                    pa.array([_planes(symbol[a:b]) for a, b in zip(start, ends)], pa.binary()),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rare)]).astype(np.int32), word[ids[~found]].view(np.int64)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "symbols", "rare"],
            )

    return run


Texts = list[bytes] | list[np.ndarray]


def _segments(symbols: Texts, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of SEGMENT symbols (arrays, or bytes of uint16), filled up with `pad`; each row's text and length."""
    each = [np.frombuffer(s, np.uint16) if isinstance(s, bytes) else s for s in symbols]
    size = np.array([len(x) for x in each], np.int64)
    rows = -(-size // SEGMENT)
    out = np.full(rows.sum() * SEGMENT, pad, np.int32)
    first = (np.cumsum(rows) - rows) * SEGMENT
    out[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.concatenate(each)
    text = np.repeat(np.arange(len(each)), rows)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    return out.reshape(-1, SEGMENT), text, np.minimum(size[text] - rank * SEGMENT, SEGMENT)


def noise(words: np.ndarray) -> np.ndarray:
    """Log-normal factors (words x STATES) by which the states differ at first, from the words alone."""
    bits = [mix64(words.astype(np.uint64)[:, None] ^ mix64(np.arange(at, at + STATES, dtype=np.uint64))) for at in (1, 1 + STATES)]
    u, v = ((x >> np.uint64(11)).astype(np.float64) + 0.5 for x in bits)
    return np.exp(np.sqrt(-2 * np.log(u / 2**53)) * np.cos(2 * np.pi * v / 2**53))


class Model:
    """start (STATES), move (STATES x STATES), emit (symbols + 1 for padding, STATES).

    The symbols are the words of the broadcast. `total` is what the weights of all words add up to, so that emissions of others follow from theirs (extra).
    """

    def __init__(self, share: np.ndarray, words: np.ndarray | None = None, rest: np.ndarray | float = 0.0):
        """share: the symbols' counts, of any scale; words: their hashes; rest: the sum of the other words' first weights."""
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        self._emit(share[:, None] * noise(np.arange(len(share)) if words is None else words), rest, 0, 0.0)

    def _emit(self, weight: np.ndarray, rest: np.ndarray | float, others: int, smooth: float) -> None:
        self.smooth, self.total = smooth, weight.sum(axis=0) + rest + smooth * (len(weight) + others)
        self.emit = np.vstack([(weight + smooth) / self.total, np.ones(STATES)])

    def extra(self, weight: np.ndarray) -> np.ndarray:
        """Emissions of words outside the broadcast by their weights, which are 0 for words that training lacks."""
        return (weight + self.smooth) / self.total

    def _with(self, extra: np.ndarray | None) -> np.ndarray:
        return self.emit if extra is None or not len(extra) else np.vstack([self.emit[:-1], extra, self.emit[-1:]])

    def _forward(self, b: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward recursion of segments side by side, by their emissions (places x segments x STATES); `left` is the states' prior at their first place."""
        forward, scale, ones = np.empty(b.shape), np.empty(b.shape[:2]), np.ones(STATES)
        for t in range(len(b)):
            a = forward[t]
            if t:
                np.matmul(forward[t - 1], self.move, out=a)
            else:
                a[:] = left
            a *= b[t]
            np.matmul(a, ones, out=scale[t])
            a *= (1 / scale[t])[:, None]
        return forward, scale

    def _backward(self, b: np.ndarray, live: np.ndarray, forward: np.ndarray, scale: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Turns `forward` into the states' posteriors; the expected moves within the segments (without the factor move), and the likelihood of each
        segment and what follows by the state at its first place, scaled. `live` are the places that hold a token."""
        moves, full, back_move = np.zeros((STATES, STATES)), live.all(axis=1), np.ascontiguousarray(self.move.T)
        back = after / (forward[-1] * after).sum(axis=1)[:, None]
        for t in range(len(b) - 1, 0, -1):
            forward[t] *= back
            back *= b[t]
            back *= (1 / scale[t])[:, None]
            moves += forward[t - 1].T @ back if full[t] else forward[t - 1][live[t]].T @ back[live[t]]
            back = back @ back_move
        forward[0] *= back
        return moves, b[0] * back / scale[0][:, None]

    def _by_steps(self, emit: np.ndarray, rows: np.ndarray, begin: np.ndarray, count: np.ndarray, size: np.ndarray, found: list) -> None:
        """Adds to `found` the symbols with their posteriors, the moves and the starts of texts of few segments: forward from segment to segment, and back."""
        done: list[tuple] = []
        for rank in range(int(count.max()) if len(count) else 0):
            texts = np.flatnonzero(count > rank)
            row = begin[texts] + rank
            part = rows[row, : int(size[row].max())].T
            left = done[-1][1][-1][count[done[-1][3]] > rank] if rank else None
            forward, scale = self._forward(np.take(emit, part, axis=0), left @ self.move if rank else np.tile(self.start, (len(row), 1)))
            done.append((part, forward, scale, texts, left))
        message = np.zeros((0, STATES))
        while done:
            part, forward, scale, texts, left = done.pop()
            after = np.ones((len(texts), STATES))
            after[count[texts] > len(done) + 1] = message
            moves, at_first = self._backward(np.take(emit, part, axis=0), part != len(emit) - 1, forward, scale, after)
            if left is not None:
                moves += left.T @ at_first  # over the cut
                message = at_first @ self.move.T
            found.append((part, forward, moves, forward[0].sum(axis=0) if left is None else 0))

    def _by_segments(self, emit: np.ndarray, rows: np.ndarray, first: np.ndarray, size: np.ndarray, found: list) -> None:
        """The same for texts of many segments, side by side."""
        before, after = self._messages(emit, rows, first, size)
        for at in range(0, len(rows), 2048):
            part, begin, left = rows[at : at + 2048].T, first[at : at + 2048], before[at : at + 2048]
            b = np.take(emit, part, axis=0)
            forward, scale = self._forward(b, np.where(begin[:, None], self.start, left @ self.move))
            moves, at_first = self._backward(b, part != len(emit) - 1, forward, scale, after[at : at + 2048])
            found.append((part, forward, moves + left[~begin].T @ at_first[~begin], forward[0][begin].sum(axis=0)))

    def expected(self, symbols: Texts, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected emissions (symbols x STATES), moves and starts of the texts, over all cuts between segments. Symbols beyond the
        broadcast's have their emissions in `extra`."""
        emit = self._with(extra)
        pad = len(emit) - 1
        rows, text, size = _segments(symbols, pad)
        first = np.concatenate([[True], np.diff(text) != 0])[: len(text)]
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(rows)))
        few, found = count <= LOCKSTEP, []
        self._by_steps(emit, rows, begin[few], count[few], size, found)
        if not few.all():
            many = np.repeat(~few, count)
            self._by_segments(emit, rows[many], first[many], size[many], found)
        symbol = np.concatenate([part.ravel() for part, *_ in found])
        emissions = np.stack([np.bincount(symbol, np.concatenate([f[:, :, k].ravel() for _, f, *_ in found]), pad + 1)[:pad] for k in range(STATES)], 1)
        return emissions, sum(moves for *_, moves, _ in found) * self.move, sum(starts for *_, starts in found)

    def learn(self, emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray, rest: np.ndarray | float = 0.0, others: int = 0) -> None:
        """rest: the sum of the expected emissions of other words; others: how many more words are smoothed."""
        self._emit(emissions, rest, others, SMOOTH)
        self.move = (moves + 0.5) / (moves + 0.5).sum(axis=1, keepdims=True)
        self.start = (starts + 0.5) / (starts + 0.5).sum()

    def _transfer(self, emit: np.ndarray, rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's transfer matrix, all segments side by side, and the logarithm of its scale."""
        matrix, logs = np.empty((len(rows), STATES, STATES)), np.zeros(len(rows))
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(rows), 2048):
            some = order[at : at + 2048]
            m = np.where(first[some][:, None, None], np.eye(STATES), self.move) * emit[rows[some, 0]][:, None, :]
            for t in range(1, int(size[some[0]])):
                live = int(np.searchsorted(-size[some], -t, side="left"))
                m[:live] = (m[:live].reshape(-1, STATES) @ self.move).reshape(-1, STATES, STATES) * emit[rows[some[:live], t]][:, None, :]
                scale = m[:live].sum(axis=(1, 2))
                m[:live] /= scale[:, None, None]
                logs[some[:live]] += np.log(scale)
            matrix[some] = m
        return matrix, logs

    def _messages(self, emit: np.ndarray, rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the states at the end of the text's segments before it, and the scaled likelihood of those after it by the state at its end."""
        before, after = np.ones((len(rows), STATES)), np.ones((len(rows), STATES))
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(rows)))
        many = np.flatnonzero(np.repeat(count > 1, count))
        matrix = np.empty((len(rows), STATES, STATES))
        matrix[many] = self._transfer(emit, rows[many], first[many], size[many])[0]
        most = int(count.max()) if len(count) else 0
        for rank in range(1, most):
            row = begin[count > rank] + rank
            v = np.einsum("dk,dkj->dj", before[row - 1] if rank > 1 else np.tile(self.start, (len(row), 1)), matrix[row - 1])
            before[row] = v / v.sum(axis=1)[:, None]
        for rank in range(most - 1, 0, -1):
            row = begin[count > rank] + rank
            v = np.einsum("dkj,dj->dk", matrix[row], after[row])
            after[row - 1] = v / v.sum(axis=1)[:, None]
        return before, after

    def log10(self, symbols: Texts, extra: np.ndarray | None = None) -> np.ndarray:
        """The texts' log10 probabilities: the scaled forward recursion from segment to segment, or the product of the transfer matrices along long texts."""
        emit = self._with(extra)
        rows, text, size = _segments(symbols, len(emit) - 1)
        first = np.concatenate([[True], np.diff(text) != 0])[: len(text)]
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(rows)))
        total, state, few = np.zeros(len(symbols)), np.tile(self.start, (len(symbols), 1)), count <= LOCKSTEP
        for rank in range(int(count[few].max()) if few.any() else 0):
            texts = np.flatnonzero(few & (count > rank))
            row = begin[texts] + rank
            part = rows[row, : int(size[row].max())].T
            forward, scale = self._forward(np.take(emit, part, axis=0), state[texts] @ self.move if rank else state[texts])
            live = np.arange(len(part))[:, None] < size[row]
            total[texts] += np.where(live, np.log(scale), 0).sum(axis=0)
            state[texts] = forward[-1]
        if few.all():
            return total / math.log(10)
        many = np.flatnonzero(np.repeat(~few, count))
        matrix, logs = np.empty((len(rows), STATES, STATES)), np.empty(len(rows))
        matrix[many], logs[many] = self._transfer(emit, rows[many], first[many], size[many])
        for rank in range(int(count.max())):
            texts = np.flatnonzero(~few & (count > rank))
            row = begin[texts] + rank
            v = np.einsum("dk,dkj->dj", state[texts], matrix[row])
            scale = v.sum(axis=1)
            state[texts] = v / scale[:, None]
            total[texts] += np.log(scale) + logs[row]
        return total / math.log(10)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BESIDE tokens, as short batches leave the recursion's steps narrow."""
    held, size = [], 0
    for batch in pieces(batches, 200):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("symbols"))).as_py() or 0
        if size >= 4 * BESIDE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _local(model: Model, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols, in which the words outside the broadcast are numbered after its own; these words, their weights (0 if `found` lacks them),
    how often training has them, and the places of the words of `found`. Without the column `rare` they are one word of no weights."""
    n = len(model.emit) - 1
    flat = [_symbols(x) for x in batch.column("symbols").to_pylist()]
    ends = np.cumsum([len(x) for x in flat])
    flat = np.concatenate(flat)
    if "rare" not in batch.schema.names:
        return np.split(flat, ends[:-1]), np.zeros(1, np.int64), np.zeros((1, STATES)), np.zeros(1, np.int64), np.zeros(0, np.int64)
    rare = batch.column("rare").flatten().to_numpy(zero_copy_only=False)
    words, number = np.unique(rare, return_inverse=True)
    flat[flat == n] = n + number
    weight, count, at = np.zeros((len(words), STATES)), np.zeros(len(words), np.int64), np.zeros(0, np.int64)
    if "found" in batch.schema.names and len(found := batch.column("found").flatten()):
        at = np.searchsorted(words, found.field("word").to_numpy(zero_copy_only=False))
        rows = np.frombuffer(b"".join(found.field("w").to_pylist()), WEIGHT)
        weight[at], count[at] = rows["w"], rows["n"]
    return np.split(flat, ends[:-1]), words, weight, count, np.unique(at)


#: A word's row in the table of weights.
WEIGHT = np.dtype([("n", np.int64), ("w", np.float32, STATES)])
SUMS = "own boolean, bucket long, keys binary, sums binary"


def _sums(own: bool, keys: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of sums, one for each bucket: of symbols CHUNK neighbours (bucket -1: the moves, the start and the rest), of other words those of one remainder."""
    bucket = np.where(keys < 0, -1, keys // CHUNK) if own else (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, rows, bucket = keys[order], rows[order], bucket[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    parts = list(zip(edge[:-1], edge[1:]))
    for at in range(0, len(parts), 1_000):
        some = parts[at : at + 1_000]
        yield pa.RecordBatch.from_arrays([pa.array([own] * len(some)), pa.array([int(bucket[a]) for a, _ in some], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in some], pa.binary()), pa.array([rows[a:b].tobytes() for a, b in some], pa.binary())], names=["own", "bucket", "keys", "sums"])


def _added(table: pa.Table) -> pa.Table:
    """The sums of a bucket over all tasks."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
    rows = np.frombuffer(b"".join(table["sums"].to_pylist())).reshape(-1, STATES)
    keys, place = np.unique(keys, return_inverse=True)
    total = np.stack([np.bincount(place, rows[:, k], len(keys)) for k in range(STATES)], 1)
    return pa.table({"own": table["own"][:1], "bucket": table["bucket"][:1], "keys": pa.array([keys.tobytes()], pa.binary()), "sums": pa.array([total.tobytes()], pa.binary())})


def _expected(model, buckets: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the task for each symbol and, with numbers below 0, for the moves, the start and the other words that are learned; a batch's sums for each of these.
    Words without weights take part in every state alike, and are learned if this is the last iteration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = model.value, None
        n = len(m.emit) - 1
        for batch in _beside(batches):
            symbols, words, weight, _, at = _local(m, batch)
            extra = np.ones((len(words), STATES))
            extra[at] = m.extra(weight[at])
            emissions, *others = m.expected(symbols, extra)
            learned = np.arange(len(words)) if last else at
            if len(learned):
                yield from _sums(False, words[learned], emissions[n + learned], buckets)
            found = [emissions[:n], *others, emissions[n + learned].sum(axis=0)]
            if total is None:
                total = found
            else:
                for x, y in zip(total, found):
                    x += y
        if total is not None:
            emissions, moves, starts, rest = total
            some = np.flatnonzero(emissions.any(axis=1))
            yield from _sums(True, np.concatenate([some, -1 - np.arange(STATES + 2)]), np.vstack([emissions[some], moves, starts[None, :], rest[None, :]]), buckets)

    return run


def _scored(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in _beside(batches):
            symbols, _, weight, count, _ = _local(m, batch)
            owner, word = np.repeat(np.arange(len(symbols)), [len(s) for s in symbols]), np.concatenate(symbols) - (len(m.emit) - 1)
            times = count[word[word >= 0]]
            known, more = (np.bincount(owner[word >= 0], x, len(symbols)) for x in (times > 0, np.log10(times + 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy() + known.astype(np.int64)), pa.array(batch.column("base").to_numpy() + more), pa.array(m.log10(symbols, m.extra(weight)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model"],
            )

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first weights of words outside the broadcast, as a row of the table of weights and as numbers."""
    for batch in batches:
        word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        weight = n[:, None] * noise(word.view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_weights(n, weight), pa.binary()), *[pa.array(weight[:, k]) for k in range(STATES)]], names=["word", "w", *WEIGHTS])


def _weights(n: np.ndarray, weight: np.ndarray) -> list[bytes]:
    rows = np.empty(len(n), WEIGHT)
    rows["n"], rows["w"] = n, weight
    return [r.tobytes() for r in rows]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of weights out of the buckets' sums. What a word's expected emissions add up to is how often training has it."""
    for batch in batches:
        for keys, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weight = np.frombuffer(sums).reshape(-1, STATES)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(_weights(np.rint(weight.sum(axis=1)).astype(np.int64), weight), pa.binary())], names=["word", "w"])


def _with_weights(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """The documents with `found`: the words outside the broadcast with their weights, as far as the table has them."""
    need = docs.select("row", F.explode(F.array_distinct("rare")).alias("word"))
    found = need.join(weights, "word").groupBy("row").agg(F.collect_list(F.struct("word", "w")).alias("found"))
    return docs.join(found, "row", "left").select(*docs.columns, F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def train(docs: DataFrame, counts: Counts) -> tuple[Model, DataFrame]:
    """Baum-Welch over all training rows: the model and the table of the weights of all words outside its broadcast. What returns to the driver is bounded by the broadcast's words."""
    spark = docs.sparkSession
    start = counts.others.mapInArrow(_first, "word long, w binary, " + ", ".join(f"{w} double" for w in WEIGHTS))
    weights = stored(start.select("word", "w"))
    if not counts.words:
        model = Model(np.ones(1))
        model.learn(np.zeros((0, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), others=1)
        return model, weights
    first = start.agg(*[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in WEIGHTS]).first()
    model = Model(counts.n[counts.often], counts.word[counts.often], np.array([first[w] for w in WEIGHTS]))
    tasks, buckets = max(spark.sparkContext.defaultParallelism, counts.total // TASK_TOKENS), counts.total // BUCKET_TOKENS + 1
    training = docs.where("NOT held_out").select("row", "symbols", "rare")
    for k in range(ITERATIONS):
        last, sent = k == ITERATIONS - 1, spark.sparkContext.broadcast(model)
        given = _with_weights(training, weights) if counts.n_others else training if last else training.drop("rare")
        found = given.drop("row").coalesce(tasks).mapInArrow(_expected(sent, buckets, last), SUMS)
        sums = stored(found.groupBy("own", "bucket").applyInArrow(_added, SUMS))
        sent.unpersist()
        own = sums.where("own").select("keys", "sums").toArrow()
        key, rows = np.frombuffer(b"".join(own["keys"].to_pylist()), np.int64), np.frombuffer(b"".join(own["sums"].to_pylist())).reshape(-1, STATES)
        emissions, more = np.zeros((len(counts.word), STATES)), np.zeros((STATES + 2, STATES))
        emissions[key[key >= 0]], more[-1 - key[key < 0]] = rows[key >= 0], rows[key < 0]
        others = counts.words - len(counts.word) + 1 if last else counts.n_others
        model.learn(emissions, more[:STATES], more[STATES], more[STATES + 1], others)
        discard(weights)
        weights = stored(sums.where("NOT own").select("keys", "sums").mapInArrow(_words, "word long, w binary"))
        discard(sums)
    return model, weights


def scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z are lower-cased; tokens are the words and one end. Documents whose crc32(doc_id as text) mod `folds` is `held` are not learned from. base_score
    is the log10 probability under word counts smoothed by one, score that under the model. Null and empty texts are one end. Repeated rows and null
    ids (hashed as the empty text) get a row each; an empty table gives none; without training documents every token has probability 1 in base_score.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    counts = stored(d.where("NOT held_out").select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    table = Counts(counts)
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, symbols binary, rare array<long>"
    encoded = stored(d.mapInArrow(_encoded(spark.sparkContext.broadcast(table)), columns).withColumn("row", F.monotonically_increasing_id()))
    model, weights = train(encoded, table)
    part = _with_weights(encoded, weights).mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double")
    return part.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(table.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(table.total + table.words + 1))).alias("base_score"), F.col("model").alias("score"),
    )
