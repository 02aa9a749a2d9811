"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken

from .common import buffers

SLICE_BYTES = 8 << 20     # text whose ids are held at a time

_ENCODERS: dict = {}


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file: the library finds them in any
    text before all else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in found for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("only added tokens that stand for themselves are supported")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    """Ids of whole texts.  Without ``added`` tokens their strings are
    ordinary text."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._plain = core.encode_ordinary
        self._added = dict(added or {})
        self.tokens = [b""] * (max([*ranks.values(), *self._added.values()]) + 1)    # bytes of each id
        for token, rank in ranks.items():
            self.tokens[rank] = token
        marks = sorted(self._added, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def encode(self, text: str) -> list[int]:
        if self._marks is None or not self._marks.search(text):
            return self._plain(text)
        ids: list[int] = []
        for k, part in enumerate(self._marks.split(text)):       # marks at the odd places
            if k % 2:
                ids.append(self._added[part])
            else:
                ids += self._plain(part)
        return ids

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of texts without nulls: text i has the unsigned
        32-bit ids ``offsets[i]:offsets[i + 1]``, the last being ``end_id``."""
        ids, ends = array("I"), [0]
        for text in texts.to_pylist():
            ids.fromlist(self.encode(text))
            ids.append(end_id)
            ends.append(len(ids))
        return np.frombuffer(ids, np.uint32).astype("<u4", copy=False), np.array(ends, np.int64)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes, one row at least."""
    offsets, _ = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> Encoder:
    """One encoder per Python worker and set of files."""
    key = (ranks_path, pattern, tuple(sorted((added or {}).items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_path, pattern, added)
    return _ENCODERS[key]
