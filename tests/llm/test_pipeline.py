import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kinelake.llm import secret_scan, tokens
from kinelake.llm.storage import Scratch, bounded, lean, numbered, shared_root
from tests.llm.cases import frame, texts, words


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    rng = random.Random(3)
    base = words(rng, 150, 3000)
    rows = [(i, words(rng, 120, 3000), "ab"[i % 2]) for i in range(40)]
    rows += [(50, base, "a"), (51, base, "a"), (52, base + " more", "b"), (60, "too short", "a"), (61, None, None), (62, words(rng, 90, 3000) + " password=b7db7aa4a5fcc78305 " + words(rng, 20, 3000), "b")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    tables, ids = Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables.table(stage(spark, docs, ""), name)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packed":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids["quality_rules"] == {i for i, _, _ in rows} - {60, 61}
    assert ids["near_duplicates"] == ids["quality_rules"] - {51, 52} == ids["secrets"]
    assert ids["source_mix"] <= ids["secrets"] and len(ids["source_mix"]) > 35 and ids["packed"] == ids["source_mix"]


def test_secrets_are_masked_and_counted(spark):
    docs = frame(spark, [(1, "a password=b7db7aa4a5fcc78305 b", "a"), (2, "plain", "a")]).select("doc_id", "text", "lang", "source", "n_chars")
    out = {r.doc_id: r for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert out[1].text == "a [SECRET] b" and out[1].n_chars == 12 and out[2].text == "plain"


def test_run_over_a_folder(spark, tmp_path):
    rng = random.Random(4)
    docs = frame(spark, [(i, words(rng, 100, 3000), "ab"[i % 2]) for i in range(20)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 20


def test_frequent_lines_go_on_hosts_of_any_size(spark):
    def own(i):
        return " ".join(f"o{i}w{j}" for j in range(55))

    for size in (30, 2200):  # the limit does not follow the host
        rows = [(i, own(i) + ("\nboilerplate of the host" if i < 21 else ""), "a") for i in range(size)]
        out = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), "").collect()}
        assert len(out) == size
        assert [i for i, r in out.items() if "boilerplate" in r.text] == [0]
        assert all(r.n_chars == len(r.text) for r in out.values())


def copies(rows, column):
    return sorted((str(r[column]) for r in rows))


def awkward(rng):
    """Nulls, repeated rows, a repeated and a null id with different texts, ties, a very long text."""
    long = "\n".join(words(rng, 25, 5000) for _ in range(2500))
    return [*texts(), (None, words(rng, 90, 3000), None), (None, words(rng, 95, 3000), "b"), (61, words(rng, 70, 3000), "c"), (500, long, "a"), (501, long, "b"), (502, "x" * 200_000, "a"), (503, "only " * 60, "a")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, awkward(random.Random(6)))  # twelve columns, with names that operators use themselves
    out = stage(spark, docs, "")
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "packed":
        assert out.count() > 0
        return
    assert out.columns == docs.columns
    rows, given = out.collect(), docs.collect()
    assert {(r.lang, r.id, r.key, r.n, r.spans, r["size"], r.host, r.toxic) for r in rows} == {("en", 7, "k", 3, "s", 9, "h", 1)}
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and name != "near_duplicates")
    if name == "quality_rules":
        assert {r.doc_id for r in rows if len(r.text.split()) < 50} == set()
        assert sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id == 61 for r in rows) == 3 and sum(r.doc_id == 500 for r in rows) == 1
        assert not any(r.doc_id in (1, 2, 3, 4, 503) for r in rows)
    elif name == "near_duplicates":
        assert sorted(r.doc_id for r in rows if r.doc_id in (7, 8, 9, 62, 500, 501)) == [7, 500]
        assert sum(r.doc_id is None for r in rows) == 3 and sum(r.doc_id == 61 for r in rows) == 3 and sum(not r.text for r in rows) == 2
    elif name == "secrets":
        plain = [r.text for r in given]
        assert sorted(map(str, (r.text for r in rows))) == sorted(str(t) if not t or not secret_scan.find_secrets(t) else "masked" for t in plain)
    else:
        assert all(r.text for r in rows) and sum(r.doc_id is None for r in rows) >= 3
        source = {}
        for r in given:
            source.setdefault((r.doc_id, r.source), []).append((r.text or "").split())
        for r in rows:  # every row is made of one of its id's texts
            assert any(set(r.text.split()) <= set(t) for t in source[(r.doc_id, r.source)])


def test_long_texts_are_mixed_in_time_that_grows_with_them(spark):
    took = []
    for n in (40_000, 160_000):
        docs = frame(spark, [(1, " ".join(f"w{k}" for k in range(n)), "a"), (2, "b " * n, "b")]).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1)
        began = time.perf_counter()
        rows = corpus_pipeline.source_mix(spark, docs, "").collect()
        took.append(time.perf_counter() - began)
        assert sum(len(r.text.split()) for r in rows) == pytest.approx(3 * n, rel=0.02)
    assert took[1] < 4 * took[0] + 5


def test_results_live_side_by_side_and_settings_stay(spark, tmp_path):
    rng = random.Random(5)
    docs = frame(spark, [(i, words(rng, 100, 3000), "ab"[i % 2]) for i in range(20)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.sources.fileCompressionFactor")}
    one, two = (corpus_pipeline.quality_rules(spark, docs, "") for _ in range(2))
    runs = [corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2)]
    assert one.count() == two.count() == 20 and runs[0].count() == runs[1].count() > 0
    assert before == (dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k, None) for k in before[1]})


def test_scratch_folders_are_removed_by_their_owner(spark):
    scratch = Scratch(spark)
    folder = scratch.root.removeprefix("file://")
    scratch.table(spark.range(3), "a")
    scratch.table(spark.range(3), "b")
    from pathlib import Path

    scratch.keep_only("b")
    assert [p.name for p in Path(folder).iterdir() if not p.name.startswith(".")] == ["b"]
    scratch.delete()
    assert not Path(folder).exists() and shared_root(spark) in scratch.root
    with pytest.raises(KeyError), bounded(spark):
        raise KeyError
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor", None) is None


def plain_pipeline(rows):
    """The first three stages by hand; what the mix makes of them is checked by its words."""
    def norm(line):
        return " ".join(line.lower().split())

    kept = []
    holders = {}
    for i, t, s in rows:
        for h in {norm(x) for x in (t or "").split("\n") if x.split()}:
            holders.setdefault((s, h), []).append(i)
    often = {k: min(v) for k, v in holders.items() if len(v) > 20}
    for i, t, s in rows:
        w = (t or "").split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = {x for x in windows if windows.count(x) > 1}
        covered = {k + j for k, x in enumerate(windows) if x in seen for j in range(3)}
        lines = [x for x in (t or "").split("\n") if often.get((s, norm(x)), i) == i]
        left = len(" ".join(lines).split())
        if len(w) >= 50 and 2 * len(covered) <= len(w) and left >= 50 and left >= 0.3 * len(w):
            kept.append((i, "\n".join(lines), s))
    out = []
    shingles = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    root = {i: i for i, _, _ in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t, _ in kept}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i, t, s in kept:
        if find(i) == i:
            spans = []
            for a, b, _ in secret_scan.find_secrets(t):
                if spans and a < spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in reversed(spans):
                t = t[:a] + "[SECRET]" + t[b:]
            out.append((i, t, s))
    return out


def test_pipeline_against_a_plain_one(spark, tmp_path):
    rng = random.Random(11)
    base = words(rng, 120, 3000).split(" ")
    rows = [(i, words(rng, rng.randrange(30, 150), 3000) + ("\nread more on this page of ours\n" if i % 2 else "\n") + words(rng, 20, 3000), "ab"[i % 2]) for i in range(60)]
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "a") for k in range(0, 40, 5)]
    rows += [(200, words(rng, 80, 3000) + " password=b7db7aa4a5fcc78305 end", "b"), (201, "spam spam " * 40, "a"), (202, "short", "b")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline(rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = Scratch(spark).table(stage(spark, docs, ""), name)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((i, t) for i, t, _ in want)

    # The whole run: the mix gives each source its words, and packing holds each of its documents whole.
    mixed = Scratch(spark).table(corpus_pipeline.source_mix(spark, docs, ""), "mix").collect()
    size = {s: sum(len(t.split()) for _, t, x in want if x == s) for s in "ab"}
    total = 1.5 * sum(size.values())
    target = {s: min(2 * size[s], total * w / 7) for s, w in (("a", 5), ("b", 2))}
    target = {s: min(2 * size[s], total - target["ab".replace(s, "")]) if target["ab".replace(s, "")] == 2 * size["ab".replace(s, "")] else target[s] for s in "ab"}
    for s in "ab":
        assert sum(len(r.text.split()) for r in mixed if r.source == s) == pytest.approx(target[s], abs=130)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4") for r in mixed]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    whole = sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole == sorted((r.doc_id, len(x)) for r, x in zip(mixed, ids, strict=True))
    one_piece = {(r.doc_id, r.ids_crc32) for r in got if r.length == r.doc_tokens}
    assert one_piece <= {(r.doc_id, zlib.crc32(x.tobytes())) for r, x in zip(mixed, ids, strict=True)} and one_piece
    assert re.fullmatch(r"[0-9]+", str(max(r.sequence_id for r in got)))


def test_rows_are_numbered_alike_in_every_run(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    made = spark.range(5000).selectExpr("id % 7 as doc_id", "id as file", "id as uid", "'m' as _metadata", "id as row")
    made.repartition(5).write.parquet(path)
    scratch = Scratch(spark)
    of_files = numbered(spark.read.parquet(path), scratch)
    sizes = [{r.uid: r.doc.file for r in of_files.select("uid", "doc").collect()} for _ in range(2)]
    assert len(sizes[0]) == 5000 and sizes[0] == sizes[1] and set(sizes[0].values()) == set(range(5000))
    with bounded(spark):  # other splits, other columns, the same numbers
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert {r.uid: r.f for r in of_files.select("uid", of_files.doc["file"].alias("f")).collect()} == sizes[0]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = numbered(spark.read.parquet(path, path), Scratch(spark))
    joined = numbered(spark.read.parquet(path).crossJoin(spark.range(2)), Scratch(spark))
    for rows in (twice, joined):
        assert rows.select("uid").distinct().count() == 10_000
    assert numbered(spark.read.parquet(path).limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "source_mix"])
def test_stages_read_files_and_frames_alike(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, awkward(random.Random(6)))
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    out = stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
    # Of rows that share the smallest id of a class, any may stay.
    assert copies(out.collect(), "doc_id") == copies(stage(spark, docs, "").collect(), "doc_id")
    (empty := docs.limit(0)).write.parquet(str(tmp_path / "e"))
    assert stage(spark, spark.read.parquet(str(tmp_path / "e")), "").count() == 0 and empty.columns == out.columns


def test_a_worker_is_small_after_a_task():
    """What packing keeps is dropped by another stage's task, and memory that is freed goes back to the system."""

    def size():
        return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

    def run(batches):
        nonlocal full, last
        assert not tokens._encoders
        held = [bytes([1]) * 50_000 for _ in range(6000)]
        last, full = bytes([2]) * 50_000, size()
        yield from batches
        del held

    full, last = 0, b""
    tokens.worker_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    before = size()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert full > before + 200 and size() < before + 60 and last


def test_tables_are_written_without_checksum_files(spark):
    """Hadoop would start three processes more for each file that has one."""
    scratch = Scratch(spark)
    table = scratch.table(spark.range(20, numPartitions=4), "t")
    files = sorted(p.name for p in Path(scratch.path("t").removeprefix("file://")).iterdir())
    assert table.count() == 20 and len(files) == 5 and files[0] == "_SUCCESS" and not any(f.endswith(".crc") for f in files)
