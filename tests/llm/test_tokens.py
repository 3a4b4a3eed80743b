import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinelake.llm import bitplane, packing, tokens
from tests.llm.cases import frame, texts, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4")


AWKWARD = ["", " ", "\n", "a  b", "a \n b", " a", "a ", "\n\n  x\t\ty\r\n", "it's don't 'S", "word, end. ok.,\nß. É, x.", "日本語 テキスト", "a b  c　", "\x1c\x1d a\x85b", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n", "<|endoftext|", "é. x", "1,2. 3", ".,", "a,\n", "a.", "a,b", " ,", "x ​ y", "end\n"]


def test_chunks_give_the_ids_of_whole_texts(plain):
    encoder = tokens.ChunkEncoder(PATH)
    some = AWKWARD + [t or "" for _, t, _ in texts()] + [" ".join(AWKWARD)]
    for text, got in zip(some, encoder.encode(some), strict=True):
        assert got == plain(text).tobytes(), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=20), st.sampled_from(["<|endoftext|>", " <|endoftext|>", "<|endoftext|> ", "<|endoftext|", "\n<|endoftext|>,"])), max_size=6))
def test_chunks_on_any_text(parts):
    t = Tokenizer.from_file(PATH)
    text = " ".join(parts) + ",".join(parts) + "\n".join(parts)
    encoder = tokens.worker_encoder(PATH)
    assert encoder.encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    encoder = tokens.ChunkEncoder(PATH)
    rng = random.Random(1)
    some = [words(rng, 60) for _ in range(20)] + ["y" * 500]
    first = [encoder.encode([t])[0] for t in some]
    assert first == tokens.ChunkEncoder(PATH).encode(some) and max(map(len, encoder.cache), default=0) <= tokens.CACHED_CHARS


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_file_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << b, n).astype("<u4").tobytes() for b, n in ((4, 0), (16, 7), (31, 70_001), (1, 3))]
    ids, lengths, got = bitplane.read_shard(bitplane.write_shard([None, 1, -5, 1 << 60], docs, kind))
    assert (ids, lengths.tolist()) == ([None, 1, -5, 1 << 60], [len(d) // 4 for d in docs]) and got.tobytes() == b"".join(docs)
    with pytest.raises(ValueError):
        bitplane.read_shard(b"x" * 40)


def expected(plain, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, at = [], 0
    for i, t, _ in order:
        ids = np.append(plain(t or ""), np.uint32(0)).astype("<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_ids_are_written_and_read_back(spark, plain):
    rows = [*texts(), (70, "a <|endoftext|> b", "a")]
    got = bitplane.round_trip(frame(spark, rows), PATH).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(plain, rows)
    assert bitplane.round_trip(frame(spark, rows).limit(0), PATH).count() == 0


def test_special_tokens_can_be_ordinary_text():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    text = "a <|endoftext|> b"
    assert tokens.ChunkEncoder(PATH, True).encode([text])[0] == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_one_id_repeated_is_spread_over_writers_and_files(spark, plain, tmp_path):
    # A third of the rows share an id, another third have none.
    kinds = spark.range(100_000).selectExpr("case id % 3 when 0 then 5 when 1 then null else id end as doc_id", "concat('w', id % 997, ' text') as text")
    folder = f"file://{tmp_path}/planes"
    files = bitplane.write_ids(kinds, folder, PATH, writers=12, file_ids=5000).collect()
    assert sum(f.n_docs for f in files) == 100_000 and len({f.part for f in files}) > 6
    assert max(f.n_ids for f in files) < 5000 + 10 and max(f.n_docs for f in files) < 3000
    manifest = spark.createDataFrame(files)
    got = bitplane.read_ids(manifest, folder).orderBy("start").collect()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = {f"w{k} text": plain(f"w{k} text").tobytes() + b"\0\0\0\0" for k in range(997)}
    crc = {t: zlib.crc32(b) for t, b in want.items()}
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, crc[r.text]) for r in kinds.collect())


def test_packing_cuts_every_id_once(spark, plain):
    rows = [r for r in texts() if r[0] not in (61, 62)]
    got = packing.pack(frame(spark, rows), PATH, length=64).collect()
    pieces = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in pieces:
        assert s * 64 + o == at and 0 < n <= 64 - o
        at += n
    ids = {i: np.append(plain(t or ""), np.uint32(0)).astype("<u4") for i, t, _ in rows}
    assert at == sum(map(len, ids.values()))
    covered = {}
    for r in got:
        d = ids[r.doc_id]
        assert r.doc_tokens == len(d) and r.ids_crc32 == zlib.crc32(d[r.start : r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, spans in covered.items():
        assert [s for s, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) == len(ids[i])
    last = max(r.sequence_id for r in got)
    assert {r.padded_length for r in got if r.sequence_id < last} <= {64} and all(r.padded_length & (r.padded_length - 1) == 0 for r in got)
    assert packing.pack(frame(spark, rows).limit(0), PATH).count() == 0
    assert packing.pack(frame(spark, texts()), PATH).count() > 0
