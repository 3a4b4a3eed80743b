"""Quality rules: per-text measures and cross-document line frequency.

Measures of a text (words: ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars (code
points in words), n_symbols (``#*$%&|<>``), n_dup_lines (lines with a word that
equal an earlier line), n_repeat_words (words in 3-word windows that the text
holds twice or more).  A text fails the base rules below ``min_words`` words or
with more than half of its words in repeated windows.

Lines: each line is normalised (A-Z lower-cased, white space collapsed) and
hashed.  For each host the distinct documents that hold a line are counted,
exact copies each for itself.  A line in more than ``max_docs`` documents of a
host, whatever the host's size, is removed from all of them; with ``keep_first``
the host's first document (smallest id, null last) keeps it.  A document is
rejected as depleted if what remains has fewer than ``min_words`` words or less
than ``min_remaining`` of them.

Counts are combined before their shuffle; joins are plain equi-joins that Spark
may split where a key is hot.  Null and empty texts have zero measures and fail;
a null host is a host of its own; each row is a document, so repeated rows count
and are decided each for itself; texts of any length are measured whole; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.storage import Scratch, lean, numbered, parts
from kinelake.llm.text import _SEP, as_bytes, joined, mix, prefix_hash, slices, span_hash, window_hash, word_spans

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_DOCS, MIN_REMAINING = 20, 0.3
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Code points that start in a byte and stand in a word.
_WORD_CHAR = ~_SEP & ((np.arange(256) & 0xC0) != 0x80)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return run[begin[1:]] - run[begin[:-1]]


def repeated_words(words: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """For each document, its words in 3-word windows that it holds more than once."""
    n = len(words)
    if n < 3:
        return np.zeros(len(per_doc), dtype=np.int64)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    with np.errstate(over="ignore"):
        key = mix(window_hash(words, 3)[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    hit = at[order[same]]
    covered = np.zeros(n, dtype=np.int64)
    for i in range(3):
        covered[hit + i] = 1
    return np.bincount(doc, weights=covered, minlength=len(per_doc)).astype(np.int64)


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in MEASURES}
    hashes = []
    for part, owner in slices(texts):
        data, begin = joined(part)
        start, end = word_spans(data)
        hashes.append(span_hash(prefix_hash(data, False), start, end))
        np.add.at(out["n_words"], owner, np.diff(np.searchsorted(start, begin)))
        np.add.at(out["word_chars"], owner, _sums(_WORD_CHAR[data], begin))
        np.add.at(out["n_symbols"], owner, _sums(_SYMBOL[data], begin))
    if hashes:
        out["n_repeat_words"] = repeated_words(np.concatenate(hashes), out["n_words"])
    return out


def line_hash(parts: list[bytes]) -> int:
    """Hash of a normalised line, given its words."""
    return xxhash.xxh3_64_intdigest(b" ".join(parts).lower()) - (1 << 63)


def without_lines(text: str, gone: set[int]) -> str:
    """A text without the lines of these hashes; lines without a word stay."""
    lines = text.encode().split(b"\n")
    return b"\n".join(x for x in lines if not (parts := x.split()) or line_hash(parts) not in gone).decode()


def lines_of(text: bytes) -> tuple[int, dict[int, int]]:
    """Repeated lines of a text; words by hash of its normalised lines."""
    seen, repeats, words = set(), 0, {}
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            continue
        if line in seen:
            repeats += 1
        seen.add(line)
        h = line_hash(parts)
        words[h] = words.get(h, 0) + len(parts)
    return repeats, words


def measure_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", row_col: str | None = None) -> DataFrame:
    """``id``, ``host``, ``uid`` (``row_col``, or a new row number), the measures and ``lines`` (hash, words) of every row."""
    line = pa.struct([("h", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            texts = as_bytes(b.column(2))
            m = measure(texts)
            found = [lines_of(t) for t in texts]
            m["n_dup_lines"] = np.array([n for n, _ in found], dtype=np.int64)
            rows = [[{"h": h, "w": n} for h, n in w.items()] for _, w in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(m[k]) for k in MEASURES), pa.array(rows, pa.list_(line))], names=["id", "host", "uid", *MEASURES, "lines"])

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, host_col)]
    uid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return df.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), uid.alias("uid")).mapInArrow(
        lean(run), f"id {kinds[0]}, host {kinds[1]}, uid bigint, {', '.join(f'{k} bigint' for k in MEASURES)}, lines array<struct<h:bigint,w:bigint>>"
    )


def frequent_lines(docs: DataFrame, max_docs: int, keep_first: bool) -> DataFrame:
    """The lines to remove from measured documents: ``uid``, ``h`` and ``w`` (words)."""
    lines = docs.select("uid", "id", F.coalesce(F.hex(F.encode("host", "UTF-8")), F.lit("-")).alias("host"), F.explode("lines").alias("line")).select("uid", "id", "host", "line.h", "line.w")
    first = F.min(F.struct(F.col("id").isNull(), "id", "uid"))["uid"]
    frequent = lines.groupBy("host", "h").agg(F.count("*").alias("n_docs"), *([first.alias("first")] if keep_first else [])).filter(F.col("n_docs") > max_docs)
    hit = lines.join(frequent, ["host", "h"])
    return (hit.filter("uid <> first") if keep_first else hit).select("uid", "h", "w")


def _failed(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _kept(min_words: int, max_repeat_percent: int, min_remaining: float) -> Column:
    left = F.col("n_words") - F.col("n_removed_words")
    return ~_failed(min_words, max_repeat_percent) & (left >= min_words) & (left >= min_remaining * F.col("n_words"))


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS,
    min_remaining: float = MIN_REMAINING,
    keep_first: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A verdict for every row: ``id_col``, the measures, n_removed_words, base_failed, kept.

    The result is a table of the scratch folder; the tables it was made from are removed.
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = scratch.table(measure_documents(df, id_col, text_col, host_col), "measured")
    removed = frequent_lines(docs, max_docs, keep_first).groupBy("uid").agg(F.sum("w").alias("n_removed_words"))
    verdicts = (
        docs.drop("lines", "host")
        .join(removed, "uid", "left")
        .withColumn("n_removed_words", F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long"))
        .select("id", *MEASURES, "n_removed_words", _failed(min_words, max_repeat_percent).alias("base_failed"), _kept(min_words, max_repeat_percent, min_remaining).alias("kept"))
    )
    verdicts = scratch.table(verdicts, "verdicts")
    scratch.keep_only("verdicts")
    return verdicts.withColumnRenamed("id", id_col)


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` whose document is kept; rows that share an id stay if one of them is kept.

    Other columns, of any name, stay as they are.
    """
    kept = judge(df, id_col, text_col, host_col, **options).filter("kept").select(F.col(id_col).alias("kept_id")).distinct()
    rows = df.select(F.struct(*df.columns).alias("doc"))
    return rows.join(kept, F.col(f"doc.{id_col}").eqNullSafe(F.col("kept_id")), "left_semi").select("doc.*")


def texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    *,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int = MAX_DOCS,
    min_remaining: float = MIN_REMAINING,
    keep_first: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The kept rows of ``df``, their texts without the frequent lines; each row is decided by itself.

    Other columns, of any name, stay as they are.  Rows are joined by a
    row number, so null and shared ids lose or multiply nothing.
    """
    scratch = scratch or Scratch(df.sparkSession)
    rows = numbered(df, scratch)
    docs = scratch.table(measure_documents(rows.select("uid", *(F.col(f"doc.{c}").alias(k) for c, k in ((id_col, "id"), (text_col, "text"), (host_col, "host")))), "id", "text", "host", "uid"), "measured")
    removed = frequent_lines(docs, max_docs, keep_first).groupBy("uid").agg(F.sum("w").alias("n_removed_words"), F.collect_list("h").alias("gone"))
    kept = (
        docs.select("uid", "n_words", "n_repeat_words")
        .join(removed, "uid", "left")
        .withColumn("n_removed_words", F.coalesce(F.col("n_removed_words"), F.lit(0)))
        .filter(_kept(min_words, max_repeat_percent, min_remaining))
        .select("uid", "gone")
    )
    kept = scratch.table(kept, "kept")
    scratch.drop("measured")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            gone, columns = b.column(1).to_pylist(), b.column(0).flatten()
            if any(gone):
                cut = [without_lines(t, set(g)) if g else t for t, g in zip(columns[at].to_pylist(), gone, strict=True)]
                columns[at] = pa.array(cut, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = df.columns
    # One kind of join at every size, so that disk grows with the input alone.
    return rows.join(kept.hint("merge"), "uid").select("doc", "gone").mapInArrow(lean(run), df.schema)


#: The query in SQL, for ids that name one row each.
JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents
), w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), tri AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS k FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), again AS (SELECT doc_id, i FROM tri WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id
), raw AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d
), worded AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, h, sum(n) AS n FROM (
    SELECT doc_id, host, translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM worded)
  GROUP BY doc_id, host, h
), often AS (SELECT host, h FROM lines GROUP BY host, h HAVING count(DISTINCT doc_id) > 20
), gone AS (SELECT l.doc_id, sum(l.n) AS n FROM lines l JOIN often o ON o.host = l.host AND o.h = l.h GROUP BY l.doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed_words AS BIGINT) AS n_removed_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM f
"""
