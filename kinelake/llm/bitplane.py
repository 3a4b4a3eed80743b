"""Token-id files of bit-shuffled planes.

A file holds the ids of successive documents in ascending id order (null first;
equal ids by text), and closes once it has ``FILE_IDS`` ids:

    b"KLPLANE1"
    for each block of ``BLOCK`` ids (the last may be shorter): its planes, each
        a zstandard frame; planes of zeros only are left out
    the document table: one zstandard frame of id flags, ids and lengths
    the chunk index: JSON {"width", "kind", "blocks": [[ids, [[offset, length], ...]], ...], "docs": [offset, length, documents]}
    8 bytes: length of the index, little-endian; b"KLPLANE1"

Planes are the four bytes of the ids (kind "byte") or their 32 bits, eight ids a
byte (kind "bit").  Any block can be read by itself through the index.

Documents are dealt to writers by ranges of id, then of the beginning of the text,
so that rows of a repeated or null id are spread too, and sorted by the JVM; a
writer streams and holds one file's ids.  Memory follows the file size and the
longest text, not the number of documents or of rows of one id.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, parts
from kinelake.llm.tokens import encode_documents, worker_encoder

MAGIC = b"KLPLANE1"
BLOCK = 1 << 16
#: Ids after which a file closes, and documents for each writer.
FILE_IDS = 1 << 22
WRITER_DOCS = 16_384
#: Characters of the text that decide, with the id, to which writer a document goes.
KEY_CHARS = 24
LEVEL = 1


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids; an empty one stands for zeros only."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(raw[:, i]) for i in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i]) for i in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of ``to_planes``."""
    raw = np.zeros((n, 4), dtype=np.uint8)
    if kind == "byte":
        for i, p in enumerate(planes):
            if p:
                raw[:, i] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[:, i] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def write_shard(doc_ids: list[int | None], docs: list[bytes], kind: str = "byte") -> bytes:
    """A file's bytes; ``docs`` are ids as little-endian unsigned 32-bit integers."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    out, at, blocks = [MAGIC], len(MAGIC), []

    def put(data: bytes) -> list[int]:
        nonlocal at
        frame = pack.compress(data) if data else b""
        out.append(frame)
        at += len(frame)
        return [at - len(frame), len(frame)]

    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK]
        blocks.append([len(block), [put(p) for p in to_planes(block, kind)]])
    table = bytes(x is not None for x in doc_ids) + np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array([len(x) // 4 for x in docs], dtype="<i8").tobytes()
    index = json.dumps({"width": 4, "kind": kind, "blocks": blocks, "docs": [*put(table), len(docs)]}).encode()
    return b"".join([*out, index, struct.pack("<Q", len(index)), MAGIC])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a plane file")
    size = struct.unpack("<Q", data[-16:-8])[0]
    index = json.loads(data[-16 - size : -16])
    unpack = zstandard.ZstdDecompressor()
    get = lambda at, n: unpack.decompress(data[at : at + n]) if n else b""
    ids = [from_planes([get(*p) for p in planes], n, index["kind"]) for n, planes in index["blocks"]]
    at, n, docs = index["docs"]
    table = get(at, n)
    doc_ids = [i if known else None for known, i in zip(table[:docs], np.frombuffer(table[docs : 9 * docs], dtype="<i8").tolist(), strict=True)]
    return doc_ids, np.frombuffer(table[9 * docs :], dtype="<i8"), np.concatenate([np.empty(0, "<u4"), *ids])


def _system(folder: str):
    from pyarrow import fs

    parsed = urlparse(folder)
    return (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all; a repeated task writes the same bytes."""
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{path}/{name}")


def file_name(part: int, number: int) -> str:
    return f"part-{part:08d}-{number:06d}.klp"


def write_ids(df: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, kind: str = "byte", writers: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise every text into plane files below ``folder``; returns (part, number, n_docs, n_ids) of each file, not yet run.

    Files ascend in id by part, then number.  Texts are shuffled once.  Ids are
    cast to long.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not writers:
        writers = max(-(-rows.count() // WRITER_DOCS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, docs, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            put_file(folder, file_name(part, number), write_shard(ids, docs, kind))
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, len(docs), size)], names=["part", "number", "n_docs", "n_ids"])
            ids.clear()
            docs.clear()
            number, size = number + 1, 0
            return row

        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), encode_documents(encoder, b.column(1).to_pylist()), strict=True):
                ids.append(i)
                docs.append(d)
                size += len(d) // 4
                if size >= file_ids:
                    yield close()
        if docs:
            yield close()

    first = F.col("id").asc_nulls_first()
    dealt = rows.repartitionByRange(writers, first, F.substring("text", 1, KEY_CHARS)).sortWithinPartitions(first, "text")
    return dealt.mapInArrow(write, "part bigint, number bigint, n_docs bigint, n_ids bigint")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files of a written ``manifest``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, over all files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _system(folder)
        for b in parts(batches, 1):
            part, number, base = (c[0].as_py() for c in b.columns)
            with system.open_input_stream(f"{path}/{file_name(part, number)}") as f:
                doc_ids, lengths, ids = read_shard(f.read())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(base + starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, 0)
    files = manifest.select("part", "number", (F.sum("n_ids").over(before) - F.col("n_ids")).alias("base"))  # a row for each file
    tasks = max(1, min(manifest.count(), 8 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(tasks, "part", "number").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, kind: str = "byte", scratch: Scratch | None = None) -> DataFrame:
    """Write every text's ids and read them back.

    Null and empty texts are the end id alone; rows that repeat an id keep their
    own ids, in order of text; a text of any length lies in one file; an empty
    table gives an empty result; other columns are not read.
    """
    scratch = scratch or Scratch(df.sparkSession)
    folder = scratch.path("planes")
    manifest = scratch.table(write_ids(df, folder, tokenizer_path, id_col, text_col, kind=kind), "manifest")
    return read_ids(manifest, folder)
