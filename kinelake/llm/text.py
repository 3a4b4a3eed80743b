"""Byte-level text kernels shared by the operators.

Texts are handled as UTF-8 bytes: the separators and the letters A-Z are single
ASCII bytes, so splitting and lower-casing bytes equals doing it on characters.
Work is done in slices of a few megabytes, whatever the length of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and \x09-\x0D separate words.
SEPARATORS = b" \t\n\x0b\x0c\r"
_SEP_RE = re.compile(rb"[ \t-\r]")
_SEP = np.zeros(256, dtype=bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLICE = 1 << 20
_U = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


#: A random 64-bit value for each byte and the odd base of the rolling hash.
BYTE_VALUES = np.array([_splitmix(i + 1) for i in range(256)], dtype=_U)
BASE = _splitmix(1000) | 1
_BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1 modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(n, SLICE + 4096)
        steps = np.full(size, _BASE_INV if inverse else BASE, dtype=_U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE:
            _powers[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return x


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of texts of about ``limit`` bytes with their indices.

    A longer text is cut after a separator, so that no word is torn; its parts
    carry the same index.
    """
    part: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            m = _SEP_RE.search(t, at + limit)
            if m is None:
                break
            if part:
                yield part, owner
                part, owner, size = [], [], 0
            yield [t[at : m.end()]], [i]
            at = m.end()
        rest = t[at:] if at else t
        if part and size + len(rest) > limit:
            yield part, owner
            part, owner, size = [], [], 0
        part.append(rest)
        owner.append(i)
        size += len(rest) + 1
    if part:
        yield part, owner


def joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed before, between and after the texts, and where each begins (and the end)."""
    data = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", dtype=np.uint8)
    begin = np.ones(len(part) + 1, dtype=np.int64)
    begin[1:] += np.cumsum(np.fromiter((len(x) + 1 for x in part), dtype=np.int64, count=len(part)))
    return data, begin


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``joined`` data."""
    inside = ~_SEP[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2]


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes."""
    out = np.empty(len(data) + 1, dtype=_U)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[_LOWER[data] if lower else data] * powers(len(data)), out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        h = (run[end] - run[start]) * powers(len(run), True)[start]
        return mix(h + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


def hash_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and the words of each text."""
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for part, owner in slices(texts):
        data, begin = joined(part)
        start, end = word_spans(data)
        out.append(span_hash(prefix_hash(data, lower), start, end))
        np.add.at(counts, owner, np.diff(np.searchsorted(start, begin)))
    return (np.concatenate(out) if out else np.empty(0, dtype=_U)), counts


_FACTORS = [_U(_splitmix(2000 + i) | 1) for i in range(8)]


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive word hashes (order matters)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        h = words[:count] * _FACTORS[0]
        for i in range(1, n):
            h = h + words[i : i + count] * _FACTORS[i]
        return mix(h)
