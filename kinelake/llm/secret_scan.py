"""Secret scan: strong patterns, and weak parts linked within a scope.

Three kinds of strong span (``assign``, ``access``, ``hex``) are reported as
they are.  Beyond them, multipart credentials are linked: access identifiers,
secret values and endpoints are weak candidates, joined as intervals; a weak
candidate is reported (kinds ``access_part``, ``secret_part``,
``endpoint_part``) only where a part of another role stands within ``scope``
characters of it in the same text, and one of the two is a secret value.  A
value inside an endpoint is a part of its own where it stands in the user part
before ``@``, after ``=``, or is a run of mixed letters and digits; words of a
path are not, nor is a string that reads both as an identifier and as a value.

Spans are in code points, end exclusive.  Every text is scanned by itself in an
Arrow batch, without a shuffle.  Null and empty texts give no span; repeated
rows give repeated results; other columns are not read.  The time a text takes
grows with its length, whatever it holds: no pattern is tried again from each
place of a long run.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.storage import lean, parts

#: Fixed patterns of the query's contract and the least lengths of a hit.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of [0-9a-f]+ is maximal, so shorter ones can be skipped at once
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
_ASSIGN_HINT = re.compile(r"passw|secret|token|key", re.IGNORECASE | re.ASCII)

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "access_part", "secret_part", "endpoint_part")
STRONG = 3

# Weak parts, by role.
ACCESS_PART = re.compile(r"\b(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}|(?<![a-z0-9_])(?:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{4,})", re.IGNORECASE | re.ASCII)
SECRET_PART = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_a-z-]*[A-Z])(?=[0-9+/_A-Z-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])|(?<![A-Za-z0-9])[0-9a-f]{12,}(?![A-Za-z0-9])")
URL = re.compile(r"\b(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[^\s\"'<>]+", re.IGNORECASE | re.ASCII)
HOST_END = re.compile(r"\.(?:amazonaws\.com|windows\.net|googleapis\.com)\b", re.IGNORECASE | re.ASCII)
_LABELS = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*", re.IGNORECASE | re.ASCII)
_EDGE = re.compile(r"\b[a-z0-9-]", re.IGNORECASE | re.ASCII)
_WEAK_HINT = re.compile(r"://|AKIA|ASIA|AIDA|AROA|access_?key|client_?id|account|user|login|amazonaws|windows\.net|googleapis", re.IGNORECASE | re.ASCII)
SCOPE = 200
_USER = re.compile(r"[a-z0-9]+://[^\s/?#@]*@", re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9a-z]*[A-Z])(?=[0-9A-Z]*[a-z])[A-Za-z0-9]{20,}")


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """Strong hits as (start, end, kind number): leftmost and non-overlapping within a kind."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def near(spans: list[tuple[int, int]], others: list[tuple[int, int]], scope: int) -> set[int]:
    """Interval join: which of ``spans`` have one of ``others`` within ``scope`` of them.

    Each list is in text order and without overlaps, so from the insertion
    point the search goes left and right only past parts that overlap the span.
    """
    starts = [s for s, _ in others]
    found = set()
    for i, (s, e) in enumerate(spans):
        k = bisect_left(starts, s)
        for step in (-1, 1):
            j = k - 1 if step < 0 else k
            while 0 <= j < len(others):
                a, b = others[j]
                if not (a < e and s < b):
                    if a - e <= scope and s - b <= scope:
                        found.add(i)
                    break
                j += step
    return found


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and outside them host names of the providers.

    A host name is looked for from its fixed end: each stretch of labels joined by
    single dots is walked once, and reaches from its first word edge to the last
    such end in it.
    """
    urls = [m.span() for m in URL.finditer(text)]
    ends = [m.span() for m in HOST_END.finditer(text)]
    if not ends:
        return urls
    out, k, u = list(urls), 0, 0
    for run in _LABELS.finditer(text):
        last = None
        while k < len(ends) and ends[k][0] < run.end():
            if ends[k][0] > run.start():
                last = ends[k]
            k += 1
        edge = last and _EDGE.search(text, run.start(), last[0])
        if edge:
            while u < len(urls) and urls[u][1] <= edge.start():
                u += 1
            if u == len(urls) or edge.start() < urls[u][0]:
                out.append((edge.start(), last[1]))
        if k == len(ends):
            break
    return sorted(out)


def inside(text: str, values: list[tuple[int, int]], ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlap join: the pairs (value, endpoint) where the endpoint holds the value as a part of its own."""
    out, j = [], 0
    users: dict[int, int] = {}  # where each endpoint's user part ends
    for i, (s, e) in enumerate(values):
        while j < len(ends) and ends[j][1] <= s:
            j += 1
        k = j
        while k < len(ends) and ends[k][0] < e:
            if k not in users:
                user = _USER.match(text, *ends[k])
                users[k] = user.end() if user else -1
            if s < users[k] or text[s - 1 : s] == "=" or _RUN.search(text, s, e):
                out.append((i, k))
            k += 1
    return out


def linked_spans(text: str, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Weak parts that a complementary part within the scope confirms."""
    if not _WEAK_HINT.search(text):
        return []
    ids, values = ([m.span() for m in rx.finditer(text)] for rx in (ACCESS_PART, SECRET_PART))
    ends = endpoints(text)
    if not values or not (ids or ends):
        return []
    held = inside(text, values, ends)
    out = [(*ids[i], 3) for i in near(ids, values, scope)]
    out += [(*values[i], 4) for i in near(values, ids, scope) | near(values, ends, scope) | {i for i, _ in held}]
    out += [(*ends[i], 5) for i in near(ends, values, scope) | {k for _, k in held}]
    return out


def find_secrets(text: str, scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind; (start, end, kind number)."""
    return sorted(strong_spans(text) + linked_spans(text, scope), key=lambda x: (x[0], x[2], x[1]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Spans of every text: ``id_col``, spans array of (kind, start, end), by start, then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in find_secrets(t or "", scope)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(span))], names=["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def mask_secrets(df: DataFrame, text_col: str = "text", scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of ``text_col`` replaced by ``mask``; overlapping spans are masked as one.

    Rows, their number and other columns stay; a null text stays null.
    """
    at = df.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        spans = find_secrets(text, scope) if text else []
        if not spans:
            return text
        out, done, open_to = [], 0, -1
        for s, e, _ in spans:
            if s >= open_to:
                out += [text[done:s], mask]
            open_to = max(open_to, e)
            done = open_to
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return df.mapInArrow(lean(run), df.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns of ``scan_secrets``."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:STRONG]))
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
