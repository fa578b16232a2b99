"""Encode texts through a bounded memory of space-separated chunks.

The byte-level vocabularies split text by a pattern in which one space before a
non-space character always belongs to what follows it. So a text may be cut
before every single space that stands between two non-space characters, and the
chunks encoded one by one. Chunks repeat a lot; each is encoded once while it
stays in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# A space that stands at an edge or next to another white-space character.
_UNEVEN = re.compile(r" (?:(?!\S)|(?<!\S ))")
_CUT = re.compile(r"(?<=\S)(?= \S)")
LONGEST_KEPT = 64
TAILS = ".,"
MOST_KEPT = 1_000_000


def split(text: str) -> list[str]:
    """Chunks that join to ``text``; all but the first begin with a space."""
    if not text:
        return []
    if _UNEVEN.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CUT.split(text)


class ChunkCoder:
    """``encode_many`` turns unseen chunks into bytes of little-endian ids."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = MOST_KEPT):
        self.encode_many, self.most, self.kept, self.tails = encode_many, most, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [split(t) for t in texts]
        if len(self.kept) > self.most:
            self.kept.clear()
        kept, distinct = self.kept, set()
        for one in cut:
            distinct.update(one)
        new = distinct.difference(kept)
        # A full stop or comma after a letter is always a piece of its own, so the
        # chunk without it will do: it is often known or wanted already.
        stems = {c: c[:-1] for c in new if c[-1] in TAILS and len(c) > 2 and c[-2].isalpha()}
        wanted = list({stems.get(c, c) for c in new}.difference(kept))
        fresh = dict(zip(wanted, self.encode_many(wanted)))
        for c, stem in stems.items():
            if c not in fresh:
                fresh[c] = (kept.get(stem) or fresh[stem]) + self.tail(c[-1])
        known = {c: kept[c] for c in distinct.difference(fresh)} | fresh
        kept.update((c, b) for c, b in fresh.items() if len(c) <= LONGEST_KEPT)
        return [b"".join(map(known.__getitem__, one)) for one in cut]

    def tail(self, sign: str) -> bytes:
        if sign not in self.tails:
            self.tails[sign] = self.encode_many([sign])[0]
        return self.tails[sign]


def blocks(column, most_chars: int = 2_000_000):
    """Slices of a string column of about ``most_chars`` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most_chars, "right")))
        yield at, column.slice(at, upto - at)
        at = upto
