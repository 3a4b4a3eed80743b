import random
import re

import numpy as np
import pytest

from kinelake.llm import ngram_join
from kinelake.llm.components import connected_components
from kinelake.llm.storage import Scratch
from tests.llm.cases import LOWER, frame, texts


def plain_classes(rows, n=4, percent=85):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=str)


def family(rng, size, length, edits, first_id):
    """Near copies of one text at various distances."""
    base = ["f%d_%d" % (first_id, k) for k in range(length)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = "e%d" % rng.randrange(10**6)
        out.append((first_id + k, " ".join(w), "a"))
    return out


@pytest.mark.parametrize("small,block", [(128, 512), (2, 8)])
def test_against_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rng = random.Random(1)
    rows = [r for r in texts() if r[0] != 60] + family(rng, 40, 90, 6, 1000) + family(rng, 15, 30, 3, 2000) + family(rng, 12, 200, 20, 3000)
    got = ngram_join.classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_classes(rows)


def test_a_posting_of_near_copies_is_sent_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    # Two large classes, a few small ones, a long text; a posting that is one class.
    rows = [(1, k, 100, 0) for k in range(200)] + [(1, 200 + k, 100, 200) for k in range(50)] + [(1, 300 + k, 100, 300 + k) for k in range(8)] + [(1, 400, 5 * ngram_join.UNIT, 400)] + [(2, k, 100, 0) for k in range(40)]
    members = spark.createDataFrame(rows, "token long, node long, n int, class long")
    dealt = ngram_join.deal_blocks(members).collect()
    assert {r.token for r in dealt} == {1}
    groups = {}
    for r in dealt:
        groups.setdefault((r.i, r.j), set()).add(r.node)
    of = {node: c for t, node, _, c in rows if t == 1}
    together = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert all((a, b) in together for a in of for b in of if a < b and of[a] != of[b])
    assert not any(i == j and len({of[x] for x in g}) == 1 and len(g) > 1 for (i, j), g in groups.items())
    assert len(dealt) <= 200 * 7 + 50 * 22 + 9 * 27


def test_long_texts_in_one_posting(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "LOCAL", 2)
    rng = random.Random(9)
    rows = family(rng, 6, 6000, 40, 1000) + family(rng, 6, 6000, 2000, 2000)
    got = ngram_join.classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_classes(rows)


def test_keep_one_decides_each_row(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text, "a"), (7, text, "b"), (None, text, "c"), (3, text + " eleven", "a"), (None, "quite another text of some more words", "a"), (None, "quite another text of some more words", "b"), (9, "", "a"), (9, None, "a")]
    kept = ngram_join.keep_one(frame(spark, rows), n=5, percent=80).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(3, text + " eleven"), (0, "quite another text of some more words"), (9, ""), (9, "")])
    assert kept[0].asDict().keys() == set(frame(spark, rows).columns)


def test_keep_one_leaves_one_of_each_class(spark):
    rng = random.Random(2)
    rows = family(rng, 10, 90, 2, 1000) + [(5, None, "a"), (6, "", "b"), (7, "alone in the world of texts", "b")]
    kept = {r.doc_id for r in ngram_join.keep_one(frame(spark, rows), n=5, percent=80).collect()}
    classes = {d: c for d, _, c in plain_classes(rows, 5, 80)}
    assert kept == {d for d, c in classes.items() if d == c or c is None}


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 20))).astype(np.uint64)]))
        if len(b) and ngram_join.links(a, b, 85):
            assert ngram_join.may_link(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b), 85)


def test_block_links_reach_as_far_as_pairs():
    rng = random.Random(4)
    sets = [np.unique(np.array([hash(x) for x in t.split()], dtype=np.int64).view(np.uint64)) for _, t, _ in family(rng, 30, 60, 8, 1)]
    root = ngram_join.link_block(sets, 85)
    parent = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            for j in range(len(sets)):
                if ngram_join.links(sets[i], sets[j], 85):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert root.tolist() == parent


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    random.Random(5).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, Scratch(spark)).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_empty_table(spark):
    assert ngram_join.classes(frame(spark, texts()).limit(0)).count() == 0
    assert ngram_join.keep_one(frame(spark, texts()).limit(0)).count() == 0
