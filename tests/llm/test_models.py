import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinelake.llm import katz, mixing, toxicity, topk_search
from tests.llm.cases import LOWER, frame, texts, words


def vectors(spark, n=300, dims=8):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, dims) / 256 + 0.001], 0, 1, 2) for i in range(n)]
    rows += [(1000, None, 0, 1, 2), (1001, [1.0, None], 0, 1, 2), (1002, [float("nan")], 0, 1, 2), (1003, [float("inf")], 0, 1, 2), (None, [0.5] * dims, 0, 1, 2), (1004, [], 0, 1, 2), (1005, [1.0, -2.0], 0, 1, 2), (50, rows[50][1], 0, 1, 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, weights int, score int").repartition(3)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 40)])
def test_search_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", blocks[1])
    rows, df = vectors(spark)
    v = topk_search.integer_vectors(df, "vec_id", "embedding")
    got = topk_search.search(v.filter("id % 50 = 0").dropDuplicates(["id"]), v).collect()
    usable = [(i, [math.floor(np.float64(np.float32(x)) * 256) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, a in {i: w for i, w in usable if i % 50 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in usable if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_search_without_candidates(spark):
    v = topk_search.integer_vectors(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk_search.search(v, v).count() == 0 and topk_search.search(v.limit(0), v.limit(0)).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    bad = ["zorgle", "fnarp", "quibzot", "drelk"]
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 200)).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "s", ","])
        rows.append((10_000 + i, " ".join(w), "a"))
        labels.append((10_000 + i, int(toxic), "x"))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(500, 1)
    table = spark.createDataFrame([*labels[:350], (None, 1, "x"), (10_001, None, "x"), (999_999, 1, "x")], "doc_id long, toxic int, text string")
    docs = frame(spark, rows + texts())
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].score, t) for i, t, _ in labels[350:]]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([[(p > q) + 0.5 * (p == q) for q in neg] for p in pos])
    assert auc > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)


def test_classifier_without_both_classes(spark):
    docs = frame(spark, texts())
    for rows, score in (([], 0.0), ([(10, 1)], 1.0), ([(10, 0), (11, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {score}
    assert toxicity.score(docs.limit(0), toxicity.Model(0.0, np.zeros(1))).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50, 500])
def test_features_do_not_depend_on_slices(monkeypatch, size):
    rng = random.Random(size)
    long = [(words(rng, 300) + "\n").encode(), "".join(rng.choice("ab \n\t\u00e9") for _ in range(2000)).encode(), b"  \n" * 300 + b"x yz" + b" " * 900 + b"end"]
    some = [b"a", *long, b"", b"b c"]
    one = toxicity.features(some)
    monkeypatch.setattr(toxicity, "STEP", size)
    other = toxicity.features(some)
    assert [x.tolist() for x in one] == [x.tolist() for x in other]


def plain_grams(text):
    t = b" ".join((text or "").translate(LOWER).encode().split())
    t += b" " if t else b""
    return {t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}


def plain_classifier(rows, labels):
    """Log-count ratios and a gradient-descent logistic regression over sets of n-grams; scores of all rows."""
    of = {i: plain_grams(t) for i, t, _ in rows}
    train = [(of[i], t) for i, t, _ in labels]
    pos, neg = sum(t for _, t in train), sum(1 - t for _, t in train)
    p, q = Counter(g for x, t in train if t for g in x), Counter(g for x, t in train if not t for g in x)
    support = lambda g: abs(p[g] / pos - q[g] / neg) / math.sqrt((p[g] + q[g]) / (pos + neg) * (1 / pos + 1 / neg) + 1e-12)
    chosen = sorted(g for g in {*p, *q} if support(g) >= toxicity.SUPPORTS[0])
    ratio = np.array([math.log((p[g] + 1) / (pos + 2)) - math.log((q[g] + 1) / (neg + 2)) for g in chosen])
    x = np.array([[g in s for g in chosen] for s, _ in train]) * ratio
    y, share = np.array([t for _, t in train], float), pos / (pos + neg)
    weight = np.where(y == 1, share / pos, (1 - share) / neg) * (pos + neg)
    w, b = np.zeros(len(chosen)), 0.0
    step = 1 / (0.25 * np.linalg.eigvalsh((x * weight[:, None]) @ x.T).max() + 0.25 * weight.sum() + 1)
    for _ in range(60_000):
        r = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - step * (x.T @ r + w), b - step * r.sum()
    return {i: 1 / (1 + math.exp(-(sum(a * c for g, a, c in zip(chosen, w, ratio, strict=True) if g in of[i]) + b))) for i in of}


def test_scores_against_a_plain_classifier(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SUPPORTS", (3.0,))
    rows, labels = labelled(120, 2)
    rows += [(20_000, None, "a"), (20_001, "", "a"), (20_002, "x", "a")]
    table = spark.createDataFrame(labels[:90], "doc_id long, toxic int, text string")
    docs = frame(spark, rows)
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, table)).collect()}
    want = plain_classifier(rows, labels[:90])
    assert max(abs(got[i] - want[i]) for i in want) < 0.01


def plain_katz(rows, held, order):
    """The model by dictionaries of histories; a history is a tuple, None the unknown word."""
    end, begin = object(), object()
    docs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [end] for _, t, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for w, h in zip(docs, held, strict=True):
        if not h:
            counts[1].update((x,) for x in w)
            for k in range(2, order + 1):
                marked = [begin, *w]
                counts[k].update(tuple(marked[i : i + k]) for i in range(len(marked) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    d = [None] + [katz.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])) for c in counts[1:]]
    cut = lambda k, c: d[k][min(c, katz.K + 1)] * c
    total = n if any(c <= katz.K for c in counts[1].values()) else n + 1
    unknown = 1 - sum(cut(1, c) / total for c in counts[1].values())
    after = defaultdict(dict)
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[g[:-1]][g[-1]] = c
    back = {}

    def p(h, y):
        if not h:
            return cut(1, counts[1][(y,)]) / total if (y,) in counts[1] else unknown
        if h not in after:
            return p(h[1:], y)
        if h not in back:
            c = sum(after[h].values())
            div = c if any(x <= katz.K for x in after[h].values()) else c + 1
            low = h[1:] if h[0] is not begin or len(h) > 1 else ()
            back[h] = ((1 - sum(cut(len(h) + 1, x) for x in after[h].values()) / div) / (1 - sum(p(low, z) for z in after[h])), div)
        if y in after[h]:
            return cut(len(h) + 1, after[h][y]) / back[h][1]
        return back[h][0] * p(h[1:], y)

    rng = random.Random(1)
    for h in [(begin,), *rng.sample(list(after), min(25, len(after)))]:  # each distribution sums to one
        assert abs(sum(p(h, y) for (y,) in counts[1]) + p(h, None) - 1) < 1e-9
    out = []
    for (i, _, _), w in zip(rows, docs, strict=True):
        base = sum(math.log10((counts[1].get((y,), 0) + 0.1) / (n + 0.1 * (v + 1))) for y in w)
        marked = [begin, *w]
        score = sum(math.log10(p(tuple(marked[max(0, j - order + 1) : j]), marked[j])) for j in range(1, len(marked)))
        out.append((i, len(w), sum((y,) in counts[1] for y in w), n, base, score))
    return out


@pytest.mark.parametrize(("order", "size", "split"), [(3, 1_000_000, 1_000_000), (3, 200, 1_000_000), (3, 200, 1), (2, 200, 1_000_000), (4, 700, 1_000_000), (1, 200, 1_000_000)])
def test_katz_against_plain_model(spark, monkeypatch, order, size, split):
    monkeypatch.setattr(katz, "BATCH_TOKENS", size)
    monkeypatch.setattr(katz, "MOST_SPLIT", split)
    if size < 1000:
        monkeypatch.setattr(katz, "GATHER", 1)
    rows = [r for r in texts() if r[0] != 60] + [(900 + i, "the same words again " * 8, "a") for i in range(7)]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in rows]
    from pyspark.sql import functions as F

    docs = frame(spark, rows).withColumn("training", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0, F.lit(True)))
    got = katz.score_documents(docs, order=order).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 4))
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(plain_katz(rows, held, order), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and a[5] == pytest.approx(b[5], abs=1e-6)


def test_katz_shares_split_the_work():
    """Each share sorts the n-grams of its own buckets alone, and the shares hold each n-gram once."""
    rng = np.random.default_rng(5)
    n, lengths = 4000, np.array([1500, 1, 2499])
    docs = np.ones(3, bool).tobytes() + np.arange(3).tobytes() + lengths.tobytes() + np.array([True, True, False]).tobytes()
    number = np.arange(1, 61, dtype=np.uint64)
    place = rng.integers(0, 60, n).astype(np.uint64)
    b = katz._Batch({"data": [docs, *(katz.squeeze(x) for x in (place, number, np.full(60, 9, np.uint64)))]})
    shares = list(b.grams(12, 100))
    pairs = {(int(x), int(w)) for g in shares for x, w in zip(g.before, g.word, strict=True)}
    of_share = [sorted({k for k, _ in g.requests()}) for g in shares]
    assert [{k % katz.ROUNDS for k in x} for x in of_share] == [{0}, {1}]
    assert len(pairs) == sum(len(g.times) for g in shares) and max(len(g.times) for g in shares) < len(pairs)
    assert sorted(np.concatenate([g.token for g in shares])) == list(range(n))
    assert sum(int(g.times.sum()) for g in shares) == 1501


def test_katz_grams_with_one_key_are_counted_apart_and_whole():
    """The sort key holds 24 bits of an n-gram's hash; others with the same ones must not come between its requests."""
    rng = np.random.default_rng(2)
    before, word = rng.integers(0, 3, 900).astype(np.uint64), rng.integers(0, 7, 900).astype(np.uint64)
    for key in (before // np.uint64(2), np.zeros(900, np.uint64), before * np.uint64(8) + word):
        by = katz._by_gram(before, word, key)
        grams = [(int(before[i]), int(word[i])) for i in by]
        assert sorted(by) == list(range(900)) and (np.diff(key[by].astype(int)) >= 0).all()
        assert 1 + sum(x != y for x, y in zip(grams, grams[1:], strict=False)) == len(set(grams))


def test_katz_edges(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, texts()).withColumn("training", F.lit(False))
    assert katz.score_documents(docs.limit(0)).count() == 0
    nothing = katz.score_documents(docs).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-9 for r in nothing)
    one = katz.score_documents(frame(spark, [(1, "", "a"), (2, "a a a", "a")]).withColumn("training", F.lit(True))).collect()
    assert all(math.isfinite(r.score) for r in one)


def test_squeezed_arrays():
    for a in (np.array([], np.uint64), np.array([1, 2, 2, 9], np.uint64), np.array([1 << 40, 1 << 50], np.uint64)):
        assert katz.unsqueeze(katz.squeeze(a)).tolist() == a.tolist() == katz.unsqueeze(katz.squeeze(a, True), True).tolist()
    x = np.array([0.5, math.pi])
    assert katz.unsqueeze(katz.squeeze(x), dtype=np.float64).tolist() == x.tolist()


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [r for r in texts() if r[0] != 60] + [(5000 + i, words(rng, rng.randrange(1, 400)), "abcdefg"[min(6, int(rng.expovariate(1)))]) for i in range(400)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(dict(sizes))
    source = {i: s for i, _, s in rows if i != 62}
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id in source:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for (_, target), n in taken.items():
        assert abs(n - target) <= 2 * mixing.BLOCK


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [r for r in texts() if r[0] not in (61, 62, None)]
    docs = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    found = Counter()
    whole = {i: (t or "").split() for i, t, _ in rows}
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        found[r.doc_id] += len(w)
        assert set(w) <= set(re.findall(r"[^\x20\x09-\x0D]+", dict((i, t) for i, t, _ in rows)[r.doc_id])) and r.n_chars == len(r.text)
    assert {i: n for i, n in taken.items() if n} == dict(found) and whole


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1013):
        p = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()]
        assert sorted(p) == list(range(n)) and (n < 100 or p != list(range(n)))


def test_mix_of_nothing(spark):
    docs = frame(spark, texts())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}
