"""Exact top-k inner-product search, term at a time.

Vectors are sparse integer rows: the terms are the component numbers, weights are
``floor(scale * x)``, zero weights have no posting.  Queries and candidates are
dealt into blocks by a hash of their id, and every query block meets every
candidate block in one task.  There the candidates' weights are laid out as
posting lists; each query scatters weight times posting into a dense score array,
term after term, a partition selection keeps its ``k`` best, and the blocks'
lists are merged.  Memory is bounded by the block sizes.  A side is sent once for
each block of the other, so blocks grow, up to ``MOST_BLOCK`` rows, while there
are more block pairs than ``TASKS``.

Scores are exact 64-bit integers; ties go to the smaller id.  Vectors that are
null or hold null or non-finite components, and rows with a null id, take no
part; an empty vector scores 0 with all.  Vectors of different lengths meet in
their common components.  An id names a row: rows that repeat a query's id are
its own, other repeated rows are candidates each for itself.  Weights must keep
every score within 63 bits.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
K = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
MOST_BLOCK, TASKS = 1 << 16, 1 << 14


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, weights) of the rows that take part."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    usable = F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.coalesce(usable, F.lit(False))).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("weights"))


def postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that hold it and their weights."""
    length = np.array([len(r) for r in rows], dtype=np.int64)
    term = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    row, weight = np.repeat(np.arange(len(rows)), length), np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    use = weight != 0
    order = np.argsort(term[use], kind="stable")
    term, row, weight = term[use][order], row[use][order], weight[use][order]
    cuts = np.searchsorted(term, np.arange(int(length.max(initial=0)) + 1))
    return [(row[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        level = np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        place = np.concatenate([above, level])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))]


def search_block(query_ids: np.ndarray, queries: list[np.ndarray], ids: np.ndarray, rows: list[np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's best among the rows, its own id left out."""
    lists, out = postings(rows), []
    for q, vector in zip(query_ids, queries, strict=True):
        scores = np.zeros(len(ids), dtype=np.int64)
        for t in np.flatnonzero(vector[: len(lists)]):
            row, weight = lists[t]
            scores[row] += vector[t] * weight  # a row holds a term once
        other = np.flatnonzero(ids != q)
        for i in other[best(scores[other], ids[other], k)]:
            out.append((int(q), int(ids[i]), int(scores[i])))
    return out


def block_sizes(n_queries: int, n_candidates: int) -> tuple[int, int]:
    """Rows of a query block and of a candidate block."""
    q, c = QUERY_BLOCK, CANDIDATE_BLOCK
    while -(-n_queries // q) * -(-n_candidates // c) > TASKS and min(q, c) < MOST_BLOCK:
        q, c = (2 * q, c) if q <= c else (q, 2 * c)
    return q, c


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for (id, weights) rows on both sides."""
    n_q, n_c = queries.count(), candidates.count()
    rows_q, rows_c = block_sizes(n_q, n_c)
    blocks_q, blocks_c = max(1, -(-n_q // rows_q)), max(1, -(-n_c // rows_c))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "weights", own(blocks_q).alias("qb"), every(blocks_c).alias("cb")).groupBy("qb", "cb")
    right = candidates.select("id", "weights", own(blocks_c).alias("cb"), every(blocks_q).alias("qb")).groupBy("qb", "cb")

    def vectors(t: pa.Table) -> list[np.ndarray]:
        lists = t.column("weights").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        found = search_block(q.column("id").to_numpy(), vectors(q), c.column("id").to_numpy(), vectors(c), k) if len(q) and len(c) else []
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query in SQL, for vectors of up to 64 components.
SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: coalesce(q.w[i], 0) * coalesce(c.w[i], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
