"""Words of whole Arrow string columns and their hashes, without a Python step per word.

A word is a run of bytes other than space and ``\\x09-\\x0d``. UTF-8 never uses
those bytes inside a longer character, so words of bytes are words of text.
Every word gets a 64-bit hash by tabulation: a random number per (place in the
word, byte), summed. Windows of words are hashed by a polynomial over the word
hashes, finished by a mixing step. The tables come from a fixed seed, so hashes
agree across executors and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PLACES = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _tables(seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 2**64, size=(PLACES, 256), dtype=np.uint64)


_TABLES = {seed: _tables(seed) for seed in (1, 2)}
_BASES = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xD1B54A32D192ED03)}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a string column: ``start`` and ``end`` are byte places in
    ``data``; those of row ``i`` are numbers ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[
            column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        # A word also begins where its row begins.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        lengths = self.end - self.start
        where = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(where, lengths)
        spot = place + np.repeat(self.start, lengths)
        values = _TABLES[seed][place % PLACES, self.data[spot]]
        if lengths.max() > PLACES:
            far = np.flatnonzero(place >= PLACES)
            values[far] *= mix((place[far] // PLACES).astype(np.uint64)) | np.uint64(1)
        return mix(np.add.reduceat(values, where) + lengths.astype(np.uint64))

    def windows(self, size: int, seed: int = 1) -> np.ndarray:
        """Hash of the ``size`` words from each word on; those that would run over
        the end of the row or column hold no meaning and are for the caller to skip."""
        words = self.hashes(seed)
        base, out = _BASES[seed], np.zeros(len(words), np.uint64)
        for step in range(min(size, len(words))):
            out *= base
            out[:len(words) - step] += words[step:]
        return mix(out)
