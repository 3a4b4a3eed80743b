"""Licence scan: ordered signature rules over the words of a text.

A text becomes its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z) joined by single spaces.  A rule is tried only where its
keyword occurs.  Of overlapping detections, one that lies within another of
equal or stronger priority is suppressed; of equal spans the stronger, then the
earlier rule stays.  Base rules are always reported.

Each text is handled by itself in one Arrow batch: no shuffle, whatever the
distribution of sources.  Null, empty and word-less texts give no detection and
zero words; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.license_rules import MACROS, RULES
from kinelake.llm.storage import parts
from kinelake.llm.text import as_bytes

#: Fixed values of the query's contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Confidence of a detection by priority.
CONFIDENCE = {0: 0.95, 1: 0.99, 2: 0.95, 3: 0.8, 4: 0.5, 5: 0.3}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    base: bool = False


def _compile(pattern: str) -> re.Pattern:
    for k, v in sorted(MACROS.items(), key=lambda x: -len(x[0])):
        pattern = pattern.replace(k, v)
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


def default_rules() -> list[Rule]:
    """The base phrases, then the signature rules in order."""
    rules = [Rule(label, phrase.encode(), _compile(phrase), 0, True) for phrase, label in BASE_PHRASES.items()]
    for line in RULES.strip().splitlines():
        head, keyword, pattern = line.split("|", 2)
        priority, label = head.split()
        rules.append(Rule(label, keyword.encode(), _compile(pattern), int(priority)))
    return rules


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def detect(text: bytes, rules: list[Rule], keywords: list[tuple[bytes, list[int]]]) -> tuple[int, list[tuple]]:
    """Words of a text and its detections (start word, end word, rule number)."""
    words = words_of(text)
    norm = b" ".join(words)
    tried = sorted(i for k, own in keywords if k in norm for i in own)
    spans = [(*m.span(), i) for i in tried for m in rules[i].pattern.finditer(norm)]
    if not spans:
        return len(words), []
    spans.sort(key=lambda x: (x[0], -x[1], rules[x[2]].priority, x[2]))
    kept, furthest = [], {}
    for s, e, i in spans:
        rule = rules[i]
        inside = any(q <= rule.priority and end >= e for q, end in furthest.items())
        if rule.base or not inside:
            kept.append((s, e, i))
        furthest[rule.priority] = max(furthest.get(rule.priority, -1), e)
    out, at, count = [], 0, 0
    for s, e, i in kept:  # starts ascend, so each stretch of the text is counted once
        count += norm.count(b" ", at, s)
        at = s
        out.append((count, count + norm.count(b" ", s, e) + 1, i))
    return len(words), out


_DETECTION = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_()), ("confidence", pa.float64())])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detections of every text: ``id_col``, n_words, detections.

    ``detections`` holds structs (label, first_word, end_word exclusive,
    priority, base, confidence) in text order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = default_rules()
        groups: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            groups.setdefault(r.keyword, []).append(i)
        keywords = list(groups.items())
        for b in parts(batches):
            found = [detect(t, rules, keywords) for t in as_bytes(b.column(1))]
            rows = [[{"label": rules[i].label, "first_word": s, "end_word": e, "priority": rules[i].priority, "base": rules[i].base, "confidence": CONFIDENCE[rules[i].priority]} for s, e, i in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, pa.list_(_DETECTION))], names=["id", "n_words", "detections"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, detections array<struct<label:string,first_word:bigint,end_word:bigint,priority:int,base:boolean,confidence:double>>"
    )
    return out.withColumnRenamed("id", id_col)


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns of ``scan_licenses``."""

    def labels(found: Column) -> Column:
        return F.concat_ws(",", F.sort_array(F.array_distinct(F.transform(found, lambda d: d["label"]))))

    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
