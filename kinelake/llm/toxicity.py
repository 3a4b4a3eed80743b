"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct byte n-grams (``GRAMS``) of the lower-cased text with
white space as one space, hashed into ``2**BITS`` buckets.  On the training
sample each bucket gets the log ratio of its smoothed document counts in toxic
and clean rows; the ``FEATURES`` buckets whose ratio is best supported are
candidates.  How much support a bucket needs is chosen from ``SUPPORTS`` by the
loss over ``FOLDS`` folds of the training sample; no other row takes part.
A ridge-penalised logistic regression on the ratios of the buckets that a text
holds gives the weights.  A text's score is the calibrated probability; since a
bucket counts once and rare evidence is not divided by length, a long text is
scored over its whole length.

The sample is bounded: at most ``SAMPLE`` labelled rows of each class, those of
smallest hash of their id.  Class weights restore the classes' true shares.
Buckets are counted by the executors; the driver gets the ``FEATURES`` candidates
and which of them each sample row holds, so its memory has a bound whatever the
length of the texts.

A null label or a label without document teaches nothing; without both classes
every score is the share of toxic labels (0 without labels).  Null and empty
texts score by the intercept, texts of any length by all their n-grams.  Repeated rows score alike; a document with several
labels counts once for each.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, bounded, parts
from kinelake.llm.text import _LOWER, _SEP, BYTE_VALUES, as_bytes, joined, mix, powers, slices

GRAMS = (3, 4, 5)
BITS = 20
FEATURES = 1 << 15
SAMPLE = 3000
SMOOTHING = 1.0
RIDGE = 1.0
#: Support (in standard deviations of the difference of shares) below which a bucket is dropped: the choices.
SUPPORTS = (3.0, 4.0, 5.0)
FOLDS = 3
THRESHOLD = 0.3
#: Bytes whose n-grams are hashed at a time: arrays of this length stay in a core's cache.
STEP = 1 << 16
_U = np.uint64


def _buckets(part: list[bytes], grams: tuple[int, ...], bits: int, use: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram within the texts of ``part`` whose bucket ``use`` marks (all without it), for each length."""
    data, begin = joined(part)
    sep = _SEP[data]
    keep = ~(sep & np.concatenate([[False], sep[:-1]]))  # one space for a run
    doc = np.repeat(np.arange(len(part) + 1), np.diff(np.concatenate([[0], begin])))[: len(data)]
    doc = np.concatenate([doc, np.full(len(data) - len(doc), len(part))]) - 1
    text = np.where(sep, np.uint8(32), _LOWER[data])[keep]
    doc = doc[keep]
    run = np.zeros(len(text) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[text] * powers(len(text)), out=run[1:])
        inverse = powers(len(text) + 1, True)
        for n in grams:
            count = len(text) - n + 1
            if count <= 0:
                continue
            h = mix((run[n:] - run[:count]) * inverse[:count] + _U(n))
            bucket = (h >> _U(64 - bits)).view(np.int64)
            hit = (doc[:count] == doc[n - 1 :]) & (doc[:count] >= 0)
            if use is not None:
                hit &= use[bucket]
            at = np.flatnonzero(hit)
            yield doc[at], bucket[at]


def _overlapping(texts: list[bytes], reach: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """``slices`` in which a cut text's later parts begin with the last ``reach`` bytes, or one more, of the normalised part before.

    So an n-gram of up to ``reach + 1`` bytes lies whole in one of the parts.
    """
    before, end = -1, b""
    for part, owner in slices(texts, STEP):
        if owner[0] == before:
            part = [end + part[0], *part[1:]]
        before, last = owner[-1], part[-1]
        near = b" ".join(last[-4096:].split()) + b" "
        if len(near) <= reach + 1 < len(last):
            near = b" ".join(last.split()) + b" "
        at = max(0, len(near) - reach)
        end = near[max(0, at - 1) if near[at : at + 1] == b" " else at :]
        yield part, owner


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, ascending; sorts in place."""
    keys.sort()
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


def features(texts: list[bytes], grams: tuple[int, ...] = GRAMS, bits: int = BITS, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, restricted to buckets that ``use`` marks."""
    keys, before, shared = [np.empty(0, np.int64)], -1, False
    for part, owner in _overlapping(texts, max(grams) - 1):
        own = np.array(owner, dtype=np.int64) << bits
        found = [own[doc] | bucket for doc, bucket in _buckets(part, grams, bits, use)]
        if found:
            keys.append(_distinct(np.concatenate(found)))
        shared, before = shared or owner[0] == before, owner[-1]
    # Parts come in the order of the texts, so only a text cut in parts needs them merged.
    key = np.concatenate(keys)
    if shared:
        key = _distinct(key)
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Model:
    """Score = sigmoid(intercept + sum of the weights of a text's distinct buckets)."""

    intercept: float
    weights: np.ndarray
    grams: tuple[int, ...] = GRAMS
    bits: int = BITS
    constant: float | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        doc, bucket = features(texts, self.grams, self.bits, self.weights != 0)
        z = self.intercept + np.bincount(doc, weights=self.weights[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(group: np.ndarray, member: np.ndarray, n_groups: int):
    """A function of a vector: for each group the sum over its members; pairs are dealt by ``group`` once."""
    order = np.argsort(group, kind="stable")
    member = member[order]
    size = np.bincount(group, minlength=n_groups)
    held = np.flatnonzero(size)
    start = (np.cumsum(size) - size)[held]

    def sums(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n_groups)
        if len(held):
            out[held] = np.add.reduceat(v[member], start)
        return out

    return sums


def _logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge-penalised weighted logistic regression by conjugate-gradient Newton steps; the intercept is free.

    A row holds each of its ``columns`` with that column's value.
    """
    n, n_columns = len(y), len(values)
    w, b = np.zeros(n_columns), 0.0
    of_row, of_column = _sums(rows, columns, n), _sums(columns, rows, n_columns)
    times = lambda v: of_row(values * v)
    back = lambda r: values * of_column(r)
    objective = lambda w, b: float(weight @ np.logaddexp(0, -(2 * y - 1) * (times(w) + b)) + ridge / 2 * w @ w)
    value = objective(w, b)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w) + b, -40, 40)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.append(back(r) + ridge * w, r.sum())
        if np.abs(g).max() < 1e-4 * max(1.0, weight.sum()) / 100:
            break
        x, res = np.zeros(n_columns + 1), -g
        d, rr = res.copy(), res @ res
        for _ in range(40):
            t = h * (times(d[:-1]) + d[-1])
            hd = np.append(back(t) + ridge * d[:-1], t.sum())
            a = rr / max(d @ hd, 1e-300)
            x += a * d
            res -= a * hd
            new = res @ res
            if new < 1e-8 * (g @ g):
                break
            d = res + new / rr * d
            rr = new
        step = 1.0
        while step > 1e-6 and (trial := objective(w + step * x[:-1], b + step * x[-1])) > value:
            step /= 2
        w, b = w + step * x[:-1], b + step * x[-1]
        if value - trial < 1e-7 * max(1.0, value):
            break
        value = trial
    return w, float(b)


def _support(p, q, pos: int, neg: int, root=np.sqrt, size=np.abs):
    """By how many standard deviations the shares p / pos and q / neg differ."""
    return size(p / pos - q / neg) / root((p + q) / (pos + neg) * (1 / pos + 1 / neg) + 1e-12)


def _fit_columns(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, n_columns: int, share: float, least: float) -> tuple[np.ndarray, float]:
    """Weight of each column and intercept, from (row, column) pairs; columns with less than ``least`` support weigh nothing."""
    pos, neg = int(toxic.sum()), int((1 - toxic).sum())
    p = np.bincount(columns[toxic[rows] == 1], minlength=n_columns).astype(float)
    q = np.bincount(columns[toxic[rows] == 0], minlength=n_columns).astype(float)
    ratio = np.log((p + SMOOTHING) / (pos + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (neg + 2 * SMOOTHING))
    chosen = _support(p, q, pos, neg) >= least
    number = np.cumsum(chosen) - 1
    use = chosen[columns]
    weight = np.where(toxic == 1, share / pos, (1 - share) / neg) * (pos + neg)
    w, intercept = _logistic(rows[use], number[columns[use]], ratio[chosen], toxic.astype(float), weight, RIDGE)
    weights = np.zeros(n_columns)
    weights[chosen] = w * ratio[chosen]
    return weights, intercept


def fit(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, buckets: np.ndarray, share: float, bits: int = BITS) -> Model:
    """A model from the (row, column) pairs of the candidate ``buckets``; ``share`` is the toxic share of all labels.

    Rows are dealt into folds in their order; the support with the least weighted
    loss on the folds left out is used for all rows (the greatest on ties).
    """
    fold = np.arange(len(toxic)) % FOLDS
    weight = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum()))
    losses = []
    for least in SUPPORTS:
        loss = 0.0
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            if not toxic[train].sum() or toxic[train].all() or not test.any():
                continue
            place = np.cumsum(train) - 1
            own = train[rows]
            w, intercept = _fit_columns(place[rows[own]], columns[own], toxic[train], len(buckets), share, least)
            z = intercept + np.bincount(rows, weights=w[columns], minlength=len(toxic))[test]
            loss += float(weight[test] @ np.logaddexp(0, -(2 * toxic[test] - 1) * z))
        losses.append(loss)
    least = max(zip(SUPPORTS, losses, strict=True), key=lambda x: (-x[1], x[0]))[0]
    w, intercept = _fit_columns(rows, columns, toxic, len(buckets), share, least)
    weights = np.zeros(1 << bits)
    weights[buckets] = w
    return Model(intercept, weights, bits=bits)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = SAMPLE, scratch: Scratch | None = None) -> Model:
    """Fit on at most ``sample`` labelled rows of each class."""
    spark = documents.sparkSession
    own = scratch or Scratch(spark)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64("id")
    chosen = [rows.filter(F.col("toxic") == c).orderBy(order, "id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, bucket = features(as_bytes(b.column(2)))
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bucket[i:j].astype("<u4").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["toxic", "h", "buckets"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for toxic, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[toxic, np.frombuffer(raw, dtype="<u4")] += 1  # a row holds a bucket once
        held = np.flatnonzero(both.any(axis=0))
        for i in range(0, len(held), 65536):
            at = held[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[1, at]), pa.array(both[0, at])], names=["bucket", "p", "q"])

    found = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id").select("toxic", F.xxhash64("id", "text").alias("h"), "text").mapInArrow(run, "toxic int, h bigint, buckets binary")
    found = own.table(found, "sample")
    sizes = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(0.0, np.zeros(1), constant=share)
    totals = found.select("toxic", "buckets").mapInArrow(count, "bucket bigint, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    support = _support(F.col("p"), F.col("q"), pos, neg, F.sqrt, F.abs)
    best = totals.select("bucket", support.alias("support")).filter(F.col("support") >= min(SUPPORTS)).orderBy(F.desc("support"), "bucket").limit(FEATURES)
    with bounded(spark):
        buckets = np.sort(best.toPandas()["bucket"].to_numpy(dtype=np.int64))
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[buckets] = np.arange(len(buckets))
    shared = spark.sparkContext.broadcast(number)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shared.value[np.frombuffer(raw, dtype="<u4")] for raw in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[x >= 0].astype("<u2").tobytes() for x in held], pa.binary())], names=["toxic", "h", "columns"])

    # A row holds at most FEATURES candidates of two bytes each.
    with bounded(spark):
        rows = found.mapInArrow(pick, "toxic int, h bigint, columns binary").orderBy("h", "toxic").toPandas()
    shared.destroy()
    if scratch is None:
        own.delete()
    lists = [np.frombuffer(c, dtype="<u2") for c in rows["columns"]]
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit(of, np.concatenate(lists).astype(np.int64), rows["toxic"].to_numpy(dtype=np.int64), buckets, share)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted of every row; the model (8 bytes a bucket) is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(as_bytes(b.column(1))), pa.float64())], names=["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
