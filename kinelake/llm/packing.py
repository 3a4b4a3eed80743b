"""Packing documents into fixed windows of tokens: concatenate and cut.

Pass one tokenises each partition and writes its documents with their offset in
the partition; the partitions' token totals, summed up in partition order, give
every document its place in one endless row of tokens.  Pass two cuts that row
every ``length`` tokens and returns a boundary record for each piece of a
document.  Only the last window is short; it is padded to the next power of two
up to ``length``.

No text and no id is shuffled.  Null and empty texts are the end id alone,
repeated rows are packed each for itself, an empty table packs to nothing, other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, lean, parts
from kinelake.llm.tokens import encode_documents, worker_encoder

LENGTH = 1024
#: Partitions whose offsets (24 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_PARTS = 200_000


def tokenise_partitions(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, at (ids before it in its partition), id, n, ids (two or four bytes each) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            docs = encode_documents(encoder, b.column(1).to_pylist())
            n = np.array([len(x) // 4 for x in docs], dtype=np.int64)
            ends = at + np.cumsum(n)
            narrow = []
            for x in docs:
                ids = np.frombuffer(x, dtype="<u4")
                narrow.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else x)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array(ends - n), b.column(0), pa.array(n), pa.array(narrow, pa.binary())], names=["part", "at", "id", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"part bigint, at bigint, id {kind}, n bigint, ids binary")


def cut(start: int, n: int, length: int) -> list[tuple[int, int]]:
    """Pieces (offset in the document, length) of ``n`` tokens whose first stands at ``start`` of the row."""
    edges = [0, *range(length - start % length, n, length), n]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """Boundary records: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    scratch = scratch or Scratch(df.sparkSession)
    docs = scratch.table(tokenise_partitions(df, tokenizer_path, id_col, text_col), "tokens")
    totals = docs.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    base = totals.select("part", (F.sum("total").over(ahead) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            of, rows = [], []
            for i, (at, n, raw, whole) in enumerate(zip(b.column("at").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), b.column("all_tokens").to_pylist(), strict=True)):
                ids = memoryview(raw if len(raw) == 4 * n else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes())
                for s, size in cut(at, n, length):
                    place = at + s
                    tail = whole - place // length * length
                    of.append(i)
                    rows.append((s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, place // length, place % length, length if tail >= length else min(length, 1 << (tail - 1).bit_length())))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    kind = df.schema[id_col].dataType.simpleString()
    base = scratch.table(base, "bases")  # a row for each partition: broadcast while that is a few megabytes
    placed = docs.join(F.broadcast(base) if base.count() <= BROADCAST_PARTS else base, "part").select("id", (F.col("base") + F.col("at")).alias("at"), "n", "ids", "all_tokens")
    return placed.mapInArrow(lean(run), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint").withColumnRenamed("id", id_col)
