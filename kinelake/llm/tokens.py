"""Tokenising whole texts with a byte-level BPE file of the tokenizers library.

Byte-level BPE never merges across its pre-tokens, and a run of white space, or
a word with one space before it, begins a new pre-token wherever it stands; so
does a comma or full stop between a word of letters and white space.  A text is
cut into such chunks, each distinct chunk is encoded by the library and kept in
a bounded cache, and the ids of a text are those of its chunks in order.  Tests
hold this against encoding whole texts.

As in the library's plain call, the string of a special token in a text is that
token: the text is cut there first.  ``special_as_text`` makes it ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from kinelake.llm.storage import KEPT

#: White space as the tokenizer's pattern has it (Unicode White_Space), and letters.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_L = "a-zA-ZÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f" ?[{_L}]+(?=[,.]?(?:[{_WS}]|$))|(?<=[{_L}])[,.](?=[{_WS}]|$)| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Distinct chunks kept by a worker; longer chunks are not kept.
CACHE, CACHED_CHARS = 800_000, 64
#: Chunks encoded in one call, a line each: a line feed is a pre-token of its own.
LINES = 32
END_ID = 0


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {} if special_as_text else self.tokenizer.get_added_tokens_decoder()
        self.tokenizer.encode_special_tokens = special_as_text
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens that take in what stands around them are not supported")
        self.special = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.line_id = self._alone("\n")
        self.cache: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        """Chunks of a text; special tokens are chunks of their own."""
        if not any(c in text for c in self.special):
            return _CHUNK.findall(text)
        return [c for p in self.cut.split(text) for c in ([p] if p in self.special else _CHUNK.findall(p))]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of chunks, each by itself."""
        plain = [c for c in missing if not c.isspace() and c not in self.special]
        lines = ["\n".join(plain[i : i + LINES]) + "\n" for i in range(0, len(plain), LINES)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = (4 * np.flatnonzero(ids == np.frombuffer(self.line_id, dtype="<u4")[0])).tolist()
        raw, at, out = ids.tobytes(), 0, {}
        for c, end in zip(plain, ends, strict=True):
            out[c] = raw[at:end]
            at = end + 4
        for c in missing.difference(plain):
            out[c] = self.special.get(c) or self._alone(c)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        get, found, open_, missing = self.cache.get, [], [], set()
        for t in texts:
            chunks = self._chunks(t)
            ids = list(map(get, chunks))
            found.append(ids)
            if None in ids:
                at = [i for i, v in enumerate(ids) if v is None]
                names = [chunks[i] for i in at]
                open_.append((ids, at, names))
                missing.update(names)
        new = self._encode(missing)
        for ids, at, names in open_:
            for i, c in zip(at, names, strict=True):
                ids[i] = new[c]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        self.cache.update((c, v) for c, v in new.items() if len(c) <= CACHED_CHARS)
        return [b"".join(ids) for ids in found]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}
KEPT.append(_encoders)


def worker_encoder(path: str, special_as_text: bool = False) -> ChunkEncoder:
    """One encoder, and so one cache, for each Python worker."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]


def text_groups(texts: list[str | None], size: int = 4 << 20) -> list[list[str]]:
    """The texts (null: empty) in order, in groups of about ``size`` characters."""
    groups, have = [], size + 1
    for t in texts:
        if have > size:
            groups.append([])
            have = 0
        groups[-1].append(t or "")
        have += len(t or "") + 1
    return groups


def encode_documents(encoder: ChunkEncoder, texts: list[str | None]) -> list[bytes]:
    """Ids of each text with the end id after them."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    return [ids + end for g in text_groups(texts) for ids in encoder.encode(g)]
