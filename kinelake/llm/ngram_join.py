"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased words
``[^\\x20\\x09-\\x0D]+``); one with fewer words has its whole sequence as single
shingle; one without words has the empty set and is linked with nothing.  Two
documents link when ``100 * |A & B| >= percent * |A | B|``.

Copies with equal sets are one node.  The join over the nodes:

* Order.  Shingles are ordered by frequency, then hash.  Frequencies come from
  counts in each batch; only the most frequent ``TABLE`` shingles are kept (a
  fixed bound on what is broadcast), all others count as rare.  Any order gives
  the same links.
* Prefixes.  With p = |A| - ceil(percent * |A| / 100) + 1, linked documents share
  at least l shingles in their first p + l - 1.  Each document takes the l in
  1..``MOST`` of least estimated cost: candidates met while scanning plus
  candidates that survive l matches (at most their sum over l).  A pair needs
  min(l, l') matches at levels up to it before it is verified.
* Postings with up to ``SMALL`` documents meet in an equi-join and are counted
  by pair.  Longer ones are verified in place and their pairs never listed.
  First each member meets the posting's first one; the links so far give early
  classes.  What is left are pairs of different classes: a class that fills
  blocks of ``BLOCK`` documents of its own meets the other classes' blocks only,
  the rest are dealt into mixed blocks, and blocks are compared with early union.
  So a posting whose members are mostly near copies of each other is sent once
  for each block of the others.  Long texts count as several documents of a
  block.  Because these matches are not counted, a pair's required matches fall
  by the number of long postings its documents are in.
* Candidates pass an exact upper bound on the overlap (differing bits of set
  bitmaps), then the sets are compared, rebuilt from the texts of those
  documents only.

Nulls: a null text is empty, a null id is never smaller than another id.  Rows
that repeat an id are separate documents of that id.  Texts of any length give
their whole set.  An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.components import connected_components
from kinelake.llm.storage import Scratch, bounded, lean, numbered
from kinelake.llm.text import as_bytes, hash_words, mix, window_hash

TABLE = 1 << 17
MOST = 6
SMALL, BLOCK = 128, 512
#: Shingles that count as one document of a block.
UNIT = 1024
#: A shingle's occurrences in a batch of documents from which the batch reports it, and in all reports to count as frequent.
LOCAL, FREQUENT = 4, 16
FILTER_BITS = 20
_U = np.uint64


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words, counts = hash_words(texts, lower=True)
    runs = window_hash(words, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(runs[at : at + c - n + 1]))
        elif c:
            out.append(window_hash(words[at : at + c], c) ^ _U(c))
        else:
            out.append(np.empty(0, dtype=_U))
        at += c
    return out


def prefix_size(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """The set in 4 to 8 bits a shingle, at least 256 bits; shorter bitmaps are foldings of longer ones."""
    bits = 1 << max(8, int(4 * len(hashes) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[(hashes & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """False only if the bitmaps differ in too many bits for a link: each differing bit is a shingle of one set alone."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the smallest index that it reaches by links among these sets.

    Overlaps are products of 0/1 matrices over shingles in two or more sets, in
    slices of columns, so memory does not grow with the length of the texts.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    all_, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(all_, return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 4096
    for c in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (c, c + step))
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root = np.arange(len(sets))
    while True:
        best = np.where(linked, root[None, :], len(sets)).min(axis=1)
        best = np.minimum(root, best)
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _first_pass(df: DataFrame, n: int) -> DataFrame:
    """kind 0: a document (id, key of its set, size); kind 1: a shingle met often in a batch (token, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate([np.empty(0, _U), *held]), return_counts=True)
            token, count = token[count >= LOCAL].view(np.int64), count[count >= LOCAL]
            held.clear()
            none = pa.nulls(len(token))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), none.cast(id_type), none.cast(pa.binary()), pa.array(token), pa.array(count.astype(np.int64))], names=names)

        names = ["kind", "id", "key", "token", "n"]
        id_type = pa.null()
        for b in batches:
            id_type = b.schema.field(0).type
            sets = shingle_sets(as_bytes(b.column(1)), n)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column(0), pa.array(keys, pa.binary()), pa.nulls(len(sets)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=names)
            held += sets
            if sum(map(len, held)) > 4_000_000:
                yield frequent()
        if held:
            yield frequent()

    return df.mapInArrow(lean(run), f"kind int, id {df.schema['id'].dataType.simpleString()}, key binary, token bigint, n bigint")


def _choose(cost: np.ndarray, first: int, size: int) -> int:
    """Matches to require, by least estimated cost; ``cost`` holds the other documents of each ordered shingle."""
    best, least = 1, None
    met = np.cumsum(cost)
    for want in range(1, MOST + 1):
        end = first + want - 1
        if end > size:
            break
        estimate = 0.2 * met[end - 1] + met[end - 1] / want
        if least is None or estimate < least:
            best, least = want, estimate
    return best


def _prefixes(df: DataFrame, n: int, percent: int, tokens: np.ndarray, counts: np.ndarray) -> DataFrame:
    """key, n, matches, prefix (ordered) and bitmap of every document with a set."""
    shared = df.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in batches:
            out = []
            for s in shingle_sets(as_bytes(b.column(0)), n):
                if not len(s):
                    continue
                first = prefix_size(len(s), percent)
                others = np.zeros(len(s), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    others[hit] = often[at[hit]] - 1
                order = np.argsort(others, kind="stable")[: first + MOST - 1]
                want = _choose(others[order], first, len(s))
                out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), want, s[order[: first + want - 1]].view(np.int64), bitmap(s)))
            key, size, want, prefix, bits = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(want, pa.int32()), pa.array(list(prefix), pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["key", "n", "matches", "prefix", "bits"])

    return df.select("text").mapInArrow(lean(run), "key binary, n bigint, matches int, prefix array<bigint>, bits binary")


def _sets_of(df: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(node, hashes) of the ``needed`` nodes (node, key, rep), from the texts of their documents.

    A bitmap of ``2**FILTER_BITS`` bits over the ids, whatever their number, spares
    most other texts; the join by key decides.
    """
    bucket: Column = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS)).cast("int")
    flags = np.zeros(1 << FILTER_BITS, dtype=bool)
    for row in needed.select(bucket.alias("b")).distinct().toLocalIterator():
        flags[row.b] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).view(bool)
        for b in batches:
            b = b.filter(pa.array(flags[b.column(0).to_numpy()]))
            sets = [s for s in shingle_sets(as_bytes(b.column(1)), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])

    found = df.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).cast("int").alias("b"), "text").mapInArrow(lean(run), "key binary, hashes binary")
    return found.join(needed.select("key", "node"), "key").dropDuplicates(["node"]).select("node", "hashes")


def _check_pairs(pairs: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Of (a, b, x, y, ...) rows those whose bitmaps (or, if ``exact``, sets) x and y allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            if exact:
                keep = [links(np.frombuffer(p, _U), np.frombuffer(q, _U), percent) for p, q in zip(x, y, strict=True)]
            else:
                sizes = zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True)
                keep = [may_link(p, q, na, nb, percent) for p, q, (na, nb) in zip(x, y, sizes, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(lean(run), "a bigint, b bigint")


def _both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    x = values.select(F.col("node").alias("a"), F.col(column).alias("x"))
    y = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    # Merge joins at every size, so that what is shuffled grows with the input alone.
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")


def deal_blocks(members: DataFrame) -> DataFrame:
    """(token, i, j, node): members of each posting for every pair of blocks that may hold links of different classes.

    ``members``: token, node, n (shingles), class.  A class that fills a block has
    blocks of its own; all others of a posting share mixed ones.
    """
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / UNIT))
    sizes = members.groupBy("token", "class").agg(F.sum(weight).alias("w"))
    large = F.when(F.col("w") >= BLOCK, F.col("class")).alias("group")  # NULL: mixed
    groups = sizes.select("token", large, "w").groupBy("token", "group").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("own"))
    # One row for each large class of a posting, and one for all others.
    listed = groups.groupBy("token").agg(F.sort_array(F.collect_list(F.struct(F.col("group").isNull().alias("mixed"), "group", "own"))).alias("groups"), F.sum("own").cast("int").alias("blocks"), F.max(F.col("group").isNull()).alias("any_mixed"))
    listed = listed.filter((F.size("groups") > 1) | F.col("any_mixed"))
    upto = F.transform("groups", lambda g, k: F.aggregate(F.slice("groups", F.lit(1), k), F.lit(0), lambda t, x: t + x["own"]))
    ranges = listed.select("token", "blocks", F.explode(F.arrays_zip("groups", upto.alias("low"))).alias("g")).select("token", "blocks", F.col("g.groups.group").alias("group"), F.col("g.groups.own").alias("own"), F.col("g.low").alias("low"))
    member = members.join(sizes, ["token", "class"]).select("token", "node", large)
    here = member.join(ranges.withColumnRenamed("token", "t").withColumnRenamed("group", "h"), (F.col("token") == F.col("t")) & F.col("group").eqNullSafe(F.col("h")))
    here = here.withColumn("at", F.col("low") + F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.when(F.col("group").isNull(), others).otherwise(F.filter(others, lambda x: (x < F.col("low")) | (x >= F.col("low") + F.col("own"))))
    met = here.select("token", "node", "at", F.explode(others).alias("other"))
    return met.select("token", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "node")


def _hot_links(hot: DataFrame, nodes: DataFrame, sets: DataFrame, linked: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that the long postings (token, node, n) add to those found so far, up to reachability."""
    # Every member against its posting's first.
    first = hot.groupBy("token").agg(F.min(F.struct("node", "n")).alias("p")).select("token", F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    star = hot.select("token", F.col("node").alias("b"), F.col("n").alias("nb")).join(first, "token").filter("a <> b").select("a", "b", "na", "nb").distinct()
    star = star.filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    star = scratch.table(_check_pairs(_both(star, nodes, "bits"), percent, exact=False), "star")
    star = scratch.table(_check_pairs(_both(star, sets, "hashes"), percent, exact=True), "star-linked", rows=500)

    names = connected_components(linked.union(star), scratch, "early")
    members = scratch.table(hot.join(names, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("class")), "members")
    spread = deal_blocks(members).join(sets, "node")

    def in_block(table: pa.Table) -> pa.Table:
        node = np.sort(table.column("node").to_numpy())
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        hashes = table.column("hashes").to_pylist()
        root = link_block([np.frombuffer(hashes[i], _U) for i in order], percent)
        other = root != np.arange(len(root))
        return pa.table({"a": pa.array(node[root[other]]), "b": pa.array(node[other])})

    return star.union(spread.groupBy("token", "i", "j").applyInArrow(in_block, "a bigint, b bigint"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 4, percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """A row for every document: ``id_col``, n_shingles, component_id (smallest id reachable by links).

    The result is a table of the scratch folder; the tables it was made from are removed.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    first = scratch.table(_first_pass(docs, n), "first")
    with bounded(spark):
        found = first.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(TABLE).toPandas()
    tokens, counts = found["token"].to_numpy(dtype=np.int64).view(_U), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)

    prefixes = _prefixes(docs, n, percent, tokens[order], counts[order])
    nodes = prefixes.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "matches", "prefix", "bits"))).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.table(nodes, "nodes")
    reps = first.filter("kind = 0 and n > 0").groupBy("key").agg(F.min("id").alias("rep"))
    reps = scratch.table(nodes.select("key", "node").join(reps, "key"), "reps")

    # Postings: level 1 for the first p shingles, then one more for each further one.
    exploded = nodes.select("node", "n", "matches", F.posexplode("prefix").alias("at", "token"))
    level = F.greatest(F.lit(1), F.col("at") + F.lit(2) - (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).cast("int")
    postings = exploded.select("token", "node", F.col("n").cast("int").alias("n"), "matches", level.alias("level"))
    long = postings.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1")
    postings = scratch.table(postings.join(long, "token"), "postings")

    small = postings.filter(F.col("docs") <= SMALL)
    hot = postings.filter(F.col("docs") > SMALL)
    left = small.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("matches").alias("ma"), F.col("level").alias("la"))
    right = small.select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("mb"), F.col("level").alias("lb"))
    met = left.join(
        right,
        (F.col("token") == F.col("t"))
        & (F.col("a") < F.col("b"))
        & (F.col("na") * 100 >= F.col("nb") * percent)
        & (F.col("nb") * 100 >= F.col("na") * percent)
        & (F.greatest("la", "lb") <= F.least("ma", "mb")),
    )
    hidden = hot.groupBy("node").agg(F.count("*").alias("h"))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first(F.least("ma", "mb")).alias("want"))
    pairs = pairs.join(hidden.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a", "left").join(hidden.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b", "left")
    pairs = pairs.filter(F.col("shared") >= F.greatest(F.lit(1), F.col("want") - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))).select("a", "b", "na", "nb")
    pairs = scratch.table(_check_pairs(_both(pairs, nodes, "bits"), percent, exact=False), "pairs")

    hot = hot.filter("level = 1").select("token", "node", "n")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hot.select("node")).distinct()
    sets = scratch.table(_sets_of(docs, needed.join(reps, "node"), n), "sets")
    linked = scratch.table(_check_pairs(_both(pairs, sets, "hashes"), percent, exact=True), "linked", rows=500)
    if not hot.isEmpty():
        linked = linked.union(_hot_links(hot, nodes, sets, linked, percent, scratch))

    names = connected_components(linked, scratch)
    smallest = scratch.table(names.join(reps.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component")), "smallest")
    # Linked nodes only, so that no NULL root gathers the rest; a merge join of two
    # tables lets Spark split a large class.
    of_node = names.join(smallest.hint("merge"), "root").select("node", "component")
    named = reps.join(of_node, "node", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = first.filter("kind = 0").join(named, "key", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = scratch.table(out, "classes")
    scratch.keep_only("classes", "rows", "files")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scratch: Scratch | None = None, **options) -> DataFrame:
    """One row of each class: that with the smallest id (null last), of several the first.

    Rows without words are classes of their own.  Each row has a number and is decided by itself,
    whatever its id; other columns, of any name, stay as they are.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = numbered(df, scratch)
    found = classes(rows.select(F.col("uid").alias("doc_id"), F.col(f"doc.{text_col}").alias("text")), scratch=scratch, **options)
    ids = rows.select("uid", F.col(f"doc.{id_col}").alias("id"))
    best = F.min(F.struct(F.col("id").isNull(), "id", "uid"))["uid"]
    kept = found.join(ids, F.col("doc_id") == F.col("uid")).groupBy("component_id").agg(best.alias("uid")).select("uid")
    kept = scratch.table(kept, "kept")
    scratch.drop("classes")
    return rows.join(kept, "uid", "left_semi").select("doc.*")


#: The query in SQL: all pairs that share a shingle, then reachability.
CLASSES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
