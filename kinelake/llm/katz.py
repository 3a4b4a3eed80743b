"""Katz back-off model of any order: trained on some documents, scoring all of them.

Tokens of a text are its words (A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``) and one
end token; a begin mark stands before the first.  Counts up to ``K`` are
discounted after Good and Turing, order by order, the others kept.  With h' for
the history h without its first word,

    p(w | h) = d(c(h w)) c(h w) / c(h)     where h w was seen
             = alpha(h) p(w | h')          where h was seen, h w was not
             = p(w | h')                   where h was not
    p(w)     = d(c(w)) c(w) / N, and what discounting leaves for one unknown word

and alpha(h) is the mass left by the seen successors of h over one minus their
p(w | h'), both summed exactly, so each distribution over vocabulary and unknown
word sums to one.  Where no successor of h can be discounted, c(h) + 1 replaces
c(h) (and N + 1 replaces N).  Where counts of counts give no valid Good-Turing
discount, half a count is taken off.

Execution.  Documents are tokenised in batches of some million tokens; a batch
keeps its distinct words and each token's place among them.  Words, then n-grams
of two words, then of three, are dealt into buckets by a hash of their history.
A bucket adds up the counts, keeps them as its part of the order's table together
with where each batch's n-grams stand in it, and, once the discounts of the order
are known, answers each batch with counts and back-off weights.  A batch collects
the answers of all orders and evaluates the recursion token by token.  What a task
has for one bucket or batch travels as one row.  Histories with a large share of
the tokens are split over buckets by the next word; their sums, a bounded number,
are added up and broadcast.  An order's n-grams are sorted and counted in ``ROUNDS`` shares
of the buckets, so that the shuffle files of one share exist at a time.  Texts are
read once and never shuffled; each phase is a table in the shared folder.

N-grams are told apart by 64-bit hashes of word numbers.  Ids are cast to long.
Null and empty texts are the end token alone; repeated rows count and score each
for itself; a null training flag counts as training; without training tokens all
of the mass is the unknown word's; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, bounded
from kinelake.llm.text import as_bytes, hash_words, mix

ORDER = 3
K = 5
BATCH_TOKENS = 750_000
BUCKET_TOKENS = 750_000
#: Bytes of messages that a task gathers before it hands them on.
GATHER = 16 << 20
#: Shares of the buckets that are asked one after the other.
ROUNDS = 2
#: Largest number of histories of an order that are split over buckets.
MOST_SPLIT = 1_000_000
END = np.uint64(0x5EEDED0FD0C5)
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_ROW = "key bigint, kind int, ids array<bigint>, data array<binary>, stats array<bigint>"
_RESULT = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def squeeze(a: np.ndarray, near: bool = False) -> bytes:
    """An unsigned or float array as zstandard-compressed byte planes; of ``near`` values the differences."""
    if near and len(a):
        d = np.diff(a, prepend=a.dtype.type(0)).view(np.int64)
        a = ((d << 1) ^ (d >> 63)).view(_U)
    if a.dtype == _U and (not len(a) or a.max() < 1 << 32):
        a = a.astype(np.uint32)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return bytes([a.dtype.itemsize]) + _COMPRESS.compress(planes)


def unsqueeze(data: bytes, near: bool = False, dtype: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(_DECOMPRESS.decompress(data[1:]), dtype=np.uint8)
    raw = np.ascontiguousarray(planes.reshape(data[0], -1).T).reshape(-1)
    a = raw.view(np.float64) if dtype is np.float64 else raw.view(np.uint32 if data[0] == 4 else _U).astype(_U)
    return np.cumsum((a >> _U(1)) ^ (_U(0) - (a & _U(1))), dtype=_U) if near else a


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "kind", "ids", "data", "stats"])


class _Post:
    """Messages of a task, gathered by addressee."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[list[int], list[bytes]]] = {}
        self.size = 0

    def add(self, to: int, sender: int, data: list[bytes]) -> None:
        ids, parts = self.held.setdefault(to, ([], []))
        ids.append(sender)
        parts.extend(data)
        self.size += sum(map(len, data))

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.held and self.size >= least:
            rows = [(to, 2, ids, parts, None) for to, (ids, parts) in sorted(self.held.items())]
            self.held, self.size = {}, 0
            yield from _rows(rows).to_batches(max_chunksize=256)


def _messages(rows: list[dict], width: int) -> list[tuple[int, list[bytes]]]:
    """(sender, data) of the messages in gathered rows, by sender."""
    out = [(i, r["data"][k * width : (k + 1) * width]) for r in rows for k, i in enumerate(r["ids"])]
    return sorted(out, key=lambda m: m[0])


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0..K) and, for all larger counts, d(K + 1) = 1; ``counts_of_counts`` holds n_1..n_{K+1}."""
    n = np.concatenate([[0], np.asarray(counts_of_counts, dtype=float)])
    d = np.array([0.0, *((r - 0.5) / r for r in range(1, K + 1)), 1.0])
    if (n[1:] > 0).all():
        a = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        good = ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - a) / (1 - a) if a != 1 else np.zeros(K)
        valid = (good > 0) & (good < 1)
        d[1 : K + 1] = np.where(valid, good, d[1 : K + 1])
    return d


@dataclass(frozen=True)
class Model:
    """Global numbers: training tokens, vocabulary and the discounts of each order known so far."""

    tokens: int
    words: int
    discounted: bool
    known_mass: float
    orders: list[np.ndarray] = field(default_factory=list)

    def left(self, order: int, c: np.ndarray) -> np.ndarray:
        """What discounting leaves of counts ``c`` of an order."""
        return self.orders[order - 1][np.minimum(c, K + 1).astype(np.int64)] * c

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        """p(w) of words with training counts ``c``; 0 is the unknown word."""
        total = self.tokens + (0 if self.discounted else 1)
        return np.where(c > 0, self.left(1, c) / total, 1 - self.known_mass)


def _tokenise(df: DataFrame) -> DataFrame:
    """A row for each batch: documents (id flags, ids, tokens, training), places of the tokens, distinct words, their training counts; stats [tokens]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []

        def flush() -> pa.Table:
            nonlocal number
            ids, train, words, lengths, flags = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            distinct, place = np.unique(words, return_inverse=True)
            counts = np.bincount(place[np.repeat(train, lengths)], minlength=len(distinct)).astype(_U)
            docs = flags.tobytes() + ids.tobytes() + lengths.tobytes() + train.tobytes()
            number += 1
            return _rows([(part + number, 0, None, [docs, squeeze(place.astype(_U)), squeeze(distinct, True), squeeze(counts)], [len(words)])])

        for b in batches:
            words, counts = hash_words(as_bytes(b.column(1)), lower=True)
            words = np.insert(words, np.cumsum(counts), END)
            ids = b.column(0)
            held.append((np.array(ids.fill_null(0)), b.column(2).to_numpy(zero_copy_only=False).astype(bool), words, counts + 1, np.array(ids.is_valid().to_numpy(zero_copy_only=False))))
            if sum(len(h[2]) for h in held) >= BATCH_TOKENS:
                yield from flush().to_batches()
        if held:
            yield from flush().to_batches()

    return df.mapInArrow(run, _ROW)


def _ask_words(batches: DataFrame, buckets: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Post()
        for b in rows:
            for r in b.to_pylist():
                words, counts = unsqueeze(r["data"][2], True), unsqueeze(r["data"][3])
                cuts = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1)).tolist()
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if j > i:
                        post.add(k, r["key"], [squeeze(words[i:j], True), squeeze(counts[i:j])])
                yield from post.flush(GATHER)
        yield from post.flush()

    return batches.mapInArrow(run, _ROW)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, ascending with them."""
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def _count_words(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("key")[0].as_py()
        asked = _messages(table.to_pylist(), 2)
        words = [unsqueeze(m[0], True) for _, m in asked]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unsqueeze(m[1]) for _, m in asked]).astype(float), minlength=len(distinct)).astype(_U)
        rank = np.empty(len(distinct), dtype=_U)
        rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(distinct), dtype=_U)
        number = rank * _U(buckets) + _U(bucket) + _U(1)  # frequent words get small numbers; 0 is the begin mark and any unknown word
        seen = total[total > 0]
        stats = [int(seen.sum()), len(seen), int(seen[seen > K].sum()), *(int((seen == r).sum()) for r in range(1, K + 2))]
        out, at = [(bucket, 1, None, [squeeze(distinct, True), squeeze(total), squeeze(number)], stats)], 0
        for (batch, _), w in zip(asked, words, strict=True):
            own = place[at : at + len(w)]
            out.append((batch, 2, [bucket], [squeeze(number[own]), squeeze(total[own])], None))
            at += len(w)
        return _rows(out)

    return count


def _with_words(table: pa.Table) -> pa.Table:
    """A batch with its words' numbers and training counts in place of the words."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    answers = _messages([r for r in rows if r["kind"] == 2], 2)
    join = lambda c: np.concatenate([unsqueeze(m[c]) for _, m in answers])
    return _rows([(own["key"], 0, None, [*own["data"][:2], squeeze(join(0)), squeeze(join(1))], None)])


class _Batch:
    """A batch's tokens and what it knows of the n-grams that end at each."""

    def __init__(self, row: dict) -> None:
        docs, place, number, count, *levels = row["data"]
        n = len(docs) // 18
        self.valid, self.ids = np.frombuffer(docs[:n], bool), np.frombuffer(docs[n : 9 * n], np.int64)
        self.lengths, train = np.frombuffer(docs[9 * n : 17 * n], np.int64), np.frombuffer(docs[17 * n :], bool)
        self.train = np.repeat(train, self.lengths)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        place, count = unsqueeze(place).astype(np.int64), unsqueeze(count)
        self.number = np.where(count > 0, unsqueeze(number), _U(0))[place]
        #: counts[k - 1]: training count of the k words that end at each token.
        self.counts = [count[place]]
        #: For each order from two: the history's count, one where it is to be added, the back-off weight of unseen n-grams.
        self.history, self.plus, self.alpha = [], [], []
        for times, plus, alpha in zip(levels[0::3], levels[1::3], levels[2::3], strict=True):
            history = self._history_count()
            times = unsqueeze(times)
            weight = np.ones(len(times))
            weight[(history > 0) & (times == 0)] = unsqueeze(alpha, dtype=np.float64)
            self.history.append(history)
            self.plus.append(_flags(plus, len(times)))
            self.alpha.append(weight)
            self.counts.append(times)

    def _before(self, values: np.ndarray, at_begin: int) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_begin
        return out

    def _history_count(self) -> np.ndarray:
        """Training count of each token's history for the next order; the begin mark was seen as often as the end token."""
        ends = int(self.counts[0][self.lengths[0] - 1]) if len(self.counts) == 1 else 0
        return self._before(self.counts[-1], ends)

    def grams(self, buckets: int, split_from: int) -> Iterator[_Grams]:
        """The next order's n-grams, share after share."""
        keys = self.keys(buckets, split_from)
        return (_Grams(self, keys, buckets, turn) for turn in range(ROUNDS))

    def keys(self, buckets: int, split_from: int) -> _Keys:
        """Of the tokens whose history was seen."""
        history, order = self._history_count(), len(self.counts) + 1
        key = mix(self.number)
        before = self._before(key, 0)
        before[self.first] = mix(np.zeros(1, _U))[0]
        for _ in range(order - 2):
            key = mix(before * _FACTOR + self.number)
            before = self._before(key, 0)
        token = np.flatnonzero(history > 0)
        before = before[token]
        gram = mix(before * _FACTOR + self.number[token])
        split = history[token] >= split_from
        return _Keys(token, before, gram, split, _bucket(np.where(split, gram, before), buckets))

    def probability(self, model: Model) -> np.ndarray:
        """p of each token: the recursion from single words up."""
        p = model.word_probability(self.counts[0])
        for k, (times, history, plus, alpha) in enumerate(zip(self.counts[1:], self.history, self.plus, self.alpha, strict=True), start=2):
            p = np.where(times > 0, model.left(k, times) / np.maximum(history + plus, 1), alpha * p)
        return p


@dataclass(frozen=True)
class _Keys:
    """Tokens, the hashes of their histories and n-grams, whether their histories are split, and their buckets."""

    token: np.ndarray
    before: np.ndarray
    gram: np.ndarray
    split: np.ndarray
    bucket: np.ndarray


class _Grams:
    """The distinct n-grams of a batch's next order whose history was seen and whose bucket is of one share, in the order of its requests."""

    def __init__(self, b: _Batch, keys: _Keys, buckets: int, turn: int) -> None:
        own = np.flatnonzero(keys.bucket % _U(ROUNDS) == turn)
        self.token = keys.token[own]
        distinct, self.inverse = np.unique(keys.gram[own], return_inverse=True)
        at = np.empty(len(distinct), np.int64)
        at[self.inverse] = np.arange(len(own))
        self.times = np.bincount(self.inverse, weights=b.train[self.token], minlength=len(distinct)).astype(_U)
        own, at = own[at], self.token[at]
        self.before, self.split, bucket = keys.before[own], keys.split[own], keys.bucket[own]
        self.word, self.lower = b.number[at], b.counts[-1][at]
        self.divisor = b.history[-1][at] + b.plus[-1][at].astype(_U) if b.history else np.zeros(len(at), _U)
        bits = max(1, int(buckets).bit_length())
        self.order = np.argsort(bucket << _U(64 - bits) | _place(self.before, distinct) >> _U(bits))
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1)).tolist()

    def requests(self) -> Iterator[tuple[int, np.ndarray]]:
        for k, (i, j) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if j > i:
                yield k, self.order[i:j]


def _place(before: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Sort key of n-grams: by history, then by hash."""
    low = _U((1 << 24) - 1)
    return (before & ~low) | (gram & low)


def _ask_grams(batches: DataFrame, buckets: int, split_from: int, turn: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Post()
        for b in rows:
            for r in b.to_pylist():
                own = _Batch(r)
                g = _Grams(own, own.keys(buckets, split_from), buckets, turn)
                for k, at in g.requests():
                    post.add(k, r["key"], [squeeze(g.before[at], True), *(squeeze(x[at]) for x in (g.word, g.times, g.lower, g.divisor)), _bits(g.split[at])])
                del g, own
                yield from post.flush(GATHER)
        yield from post.flush()

    return batches.mapInArrow(run, _ROW)


def _runs(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of n-grams by history, and where each history begins in it."""
    by = np.argsort(before, kind="stable")
    b = before[by]
    return by, np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))


def _by_gram(before: np.ndarray, word: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by ``key`` in which equal n-grams stand together, also where others have the same key."""
    by = np.argsort(key)
    k, b, w = key[by], before[by], word[by]
    apart = (k[1:] == k[:-1]) & ((b[1:] != b[:-1]) | (w[1:] != w[:-1]))
    if apart.any():
        shared = np.unique(k[1:][apart])
        edge = np.zeros(len(k) + 1, np.int8)
        edge[np.searchsorted(k, shared)] += 1
        edge[np.searchsorted(k, shared, "right")] -= 1
        at = np.flatnonzero(np.cumsum(edge[:-1]))
        by[at] = by[at][np.lexsort((w[at], b[at], k[at]))]
    return by


def _count_grams(model: Model, order: int):
    def count(table: pa.Table) -> pa.Table:
        """A bucket's part of an order's table (histories, words, counts, which are split, p of the successors one order lower where it is needed) and the places of each batch's n-grams in it."""
        bucket = table.column("key")[0].as_py()
        asked = _messages(table.to_pylist(), 6)
        before = [unsqueeze(m[0], True) for _, m in asked]
        sizes = [len(x) for x in before]
        split = np.concatenate([_flags(m[5], n) for (_, m), n in zip(asked, sizes, strict=True)])
        before = np.concatenate(before)
        word, times = (np.concatenate([unsqueeze(m[c]) for _, m in asked]) for c in (1, 2))
        by = _by_gram(before, word, _place(before, mix(before * _FACTOR + word)))
        b, w = before[by], word[by]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1])])
        place = np.empty(len(by), dtype=_U)
        place[by] = np.cumsum(new) - 1
        new = np.flatnonzero(new)
        times, first = np.add.reduceat(times[by], new), by[new]
        before, word, split = before[first], word[first], split[first]
        lower, divisor = (np.concatenate([unsqueeze(m[c]) for _, m in asked])[first] for c in (3, 4))
        below = model.word_probability(lower) if order == 2 else model.left(order - 1, lower) / np.maximum(divisor, 1)

        by, at = _runs(before)
        successors = np.add.reduceat(np.where(times > 0, below, 0.0)[by], at)
        needed = np.logical_or.reduceat((split | (times == 0))[by], at)
        stats = [int((times == r).sum()) for r in range(1, K + 2)]
        own = [squeeze(before, True), squeeze(word), squeeze(times), _bits(split), squeeze(np.where(needed, successors, 0.0))]
        places = [squeeze(x, True) for x in np.split(place, np.cumsum(sizes)[:-1])]
        return _rows([(bucket, 1, [i for i, _ in asked], own + places, stats)])

    return count


class _Table:
    """A bucket's part of an order's table, and the sums of its histories."""

    def __init__(self, row: dict, model: Model, order: int) -> None:
        before, _, times, split, successors, *self.places = row["data"]
        self.batches = row["ids"]
        before, self.times = unsqueeze(before, True), unsqueeze(times)
        by, at = _runs(before)
        self.run = np.empty(len(by), dtype=np.int64)
        self.run[by] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(by))))
        add = lambda x: np.add.reduceat(x[by], at)
        self.key, self.split = before[by[at]], _flags(split, len(by))[by[at]]
        #: Tokens, discounted tokens, p of the successors one order lower, successors that can be discounted.
        self.sums = [add(self.times.astype(float)), add(model.left(order, self.times)), unsqueeze(successors, dtype=np.float64).copy(), add(((self.times > 0) & (self.times <= K)).astype(float))]


def _split_sums(grams: DataFrame, model: Model, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of the split histories, ascending, and their sums over the buckets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                t = _Table(r, model, order)
                yield pa.RecordBatch.from_arrays([pa.array(t.key[t.split].view(np.int64)), *(pa.array(x[t.split]) for x in t.sums)], names=["history", "a", "b", "c", "d"])

    sums = grams.mapInArrow(run, "history bigint, a double, b double, c double, d double").groupBy("history").agg(*(F.sum(c).alias(c) for c in "abcd")).toPandas()
    key = sums["history"].to_numpy(dtype=np.int64).view(_U)
    by = np.argsort(key)
    return key[by], [sums[c].to_numpy(dtype=float)[by] for c in "abcd"]


def _answer_grams(grams: DataFrame, model: Model, order: int, split) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = _Post()
        for b in rows:
            for r in b.to_pylist():
                t = _Table(r, model, order)
                keys, sums = split.value
                at = np.searchsorted(keys, t.key[t.split])
                for own, all_ in zip(t.sums, sums, strict=True):
                    own[t.split] = all_[at]
                tokens, left, successors, low = t.sums
                plus = low == 0
                alpha = (1 - left / np.maximum(tokens + plus, 1)) / (1 - successors)
                for batch, places in zip(t.batches, t.places, strict=True):
                    place = unsqueeze(places, True).astype(np.int64)
                    times, run_ = t.times[place], t.run[place]
                    post.add(batch, r["key"], [squeeze(times), _bits(plus[run_]), squeeze(alpha[run_[times == 0]])])
                yield from post.flush(GATHER)
        yield from post.flush()

    return grams.mapInArrow(run, _ROW)


def _collected(table: pa.Table, buckets: int, split_from: int) -> tuple[dict, list[bytes]]:
    """A batch's own row and its next level: per token the n-gram's count, the added one, and the weights where it is unseen."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    answers = dict(_messages([r for r in rows if r["kind"] == 2], 3))
    b = _Batch(own)
    level, added, weight = np.zeros(len(b.number), _U), np.zeros(len(b.number), bool), np.ones(len(b.number))
    for g in b.grams(buckets, split_from):
        times, plus, alpha = np.zeros(len(g.times), _U), np.zeros(len(g.times), bool), np.ones(len(g.times))
        for k, at in g.requests():
            t, p, a = answers[k]
            times[at], plus[at] = unsqueeze(t), _flags(p, len(at))
            alpha[at[times[at] == 0]] = unsqueeze(a, dtype=np.float64)
        level[g.token], added[g.token], weight[g.token] = times[g.inverse], plus[g.inverse], alpha[g.inverse]
    return own, [squeeze(level), _bits(added), squeeze(weight[(b._history_count() > 0) & (level == 0)])]


def _with_level(buckets: int, split_from: int):
    def collect(table: pa.Table) -> pa.Table:
        own, level = _collected(table, buckets, split_from)
        return _rows([(own["key"], 0, None, [*own["data"], *level], None)])

    return collect


def _scores(row: dict, model: Model) -> pa.Table:
    b = _Batch(row)
    base = np.log10((b.counts[0] + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
    add = lambda x: np.add.reduceat(x, b.first)
    return pa.table({"id": pa.array(b.ids, mask=~b.valid), "n_tokens": pa.array(b.lengths), "n_known": pa.array(add((b.counts[0] > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(b.probability(model))))})


def _score_grams(model: Model, buckets: int, split_from: int):
    def score(table: pa.Table) -> pa.Table:
        own, level = _collected(table, buckets, split_from)
        return _scores({"data": [*own["data"], *level]}, model)

    return score


def _score_words(batches: DataFrame, model: Model) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                yield from _scores(r, model).to_batches()

    return batches.mapInArrow(run, _RESULT)


def _added(rows: DataFrame, n: int) -> list[int]:
    row = rows.agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n))).first()
    return [int(x or 0) for x in row]


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_col: str = "training", *, order: int = ORDER, scratch: Scratch | None = None) -> DataFrame:
    """Train on the rows where ``training_col`` holds and score all: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is the number of words of the longest n-grams.  The result is a table
    of the scratch folder; the tables it was made from are removed.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(training_col, F.lit(True)).alias("training"))
    batches = scratch.table(_tokenise(docs), "batches", rows=500)
    (tokens,) = _added(batches, 1)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))

    words = scratch.table(_ask_words(batches, buckets).groupBy("key").applyInArrow(_count_words(buckets), _ROW), "words", rows=4)
    total, vocabulary, often, *of_words = _added(words.filter("kind = 1"), K + 4)
    left = discounts(np.array(of_words))
    discounted = sum(of_words[:K]) > 0
    mass = float((left[1 : K + 1] * np.arange(1, K + 1) * of_words[:K]).sum() + often) / (total + (0 if discounted else 1))
    model = Model(total, vocabulary, discounted, mass, [left])
    known = scratch.table(batches.unionByName(words.filter("kind = 2")).groupBy("key").applyInArrow(_with_words, _ROW), "order-1", rows=4)
    scratch.drop("batches", "words")

    split_from = max(1, -(-total // min(8 * buckets, MOST_SPLIT)))
    result = None
    for k in range(2, order + 1):
        shares = [scratch.table(_ask_grams(known, buckets, split_from, t).groupBy("key").applyInArrow(_count_grams(model, k), _ROW), f"grams-{k}-{t}", rows=4) for t in range(ROUNDS)]
        grams = reduce(DataFrame.union, shares)
        model.orders.append(discounts(np.array(_added(grams, K + 1))))
        with bounded(spark, rows=4):
            split = spark.sparkContext.broadcast(_split_sums(grams, model, k))
        answered = known.unionByName(_answer_grams(grams, model, k, split)).groupBy("key")
        if k < order:
            known = scratch.table(answered.applyInArrow(_with_level(buckets, split_from), _ROW), f"order-{k}", rows=4)
        else:
            result = answered.applyInArrow(_score_grams(model, buckets, split_from), _RESULT)
            result = scratch.table(result, "scores", rows=4)
        scratch.drop(*(f"grams-{k}-{t}" for t in range(ROUNDS)), f"order-{k - 1}")
        split.destroy()
    if result is None:
        result = scratch.table(_score_words(known, model), "scores", rows=4)
        scratch.drop("order-1")
    return result.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
