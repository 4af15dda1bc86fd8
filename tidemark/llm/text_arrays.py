"""Whole texts as arrays of bytes and tokens, in pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CUT = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 1024), 0xD6E8FEB86659FD93, np.uint64)
        base[0] = 1
        _POWERS = np.cumprod(base, dtype=np.uint64)
    return _POWERS


@dataclass
class Pieces:
    """Consecutive pieces of texts: `data` holds their bytes end to end; piece i is data[bounds[i]:bounds[i + 1]] of text
    texts[i]; begins and ends say whether it is the text's first and last piece."""

    data: np.ndarray
    bounds: np.ndarray
    texts: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the runs without ASCII white space."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        solid = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        starts = solid.copy()
        starts[1:] &= ~solid[:-1] | edge[1:-1]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        return start, end, np.searchsorted(self.bounds, start, side="right") - 1


def pieces(texts: pa.Array, most: int = PIECE, cut_words: bool = False) -> Iterator[Pieces]:
    """All of the texts (a string or binary array; null is empty), in order; long ones are cut at white space, or with
    `cut_words` at twice `most` where there is none before."""
    held, size = [], 0
    for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        text, at, begins = text or b"", 0, True
        while True:
            stop = len(text)
            if stop - at > most:
                cut = _CUT.search(text, at + most, at + 2 * most) if cut_words else _CUT.search(text, at + most)
                stop = cut.end() if cut else min(stop, at + 2 * most) if cut_words else stop
            held.append((text[at:stop], i, begins, stop == len(text)))
            size, at, begins = size + stop - at, stop, False
            if size >= most:
                yield _joined(held)
                held, size = [], 0
            if at == len(text):
                break
    if held:
        yield _joined(held)


def _joined(held: list) -> Pieces:
    parts, texts, begins, ends = zip(*held, strict=True)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return Pieces(np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(texts), np.array(begins), np.array(ends))


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token with A-Z lower-cased."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = np.cumsum(size)
    within = np.arange(total[-1]) - np.repeat(total - size, size)
    at = within + np.repeat(start, size)
    values = _BYTE[LOWER[data[at]]]
    values *= _powers(int(size.max()))[within]
    return mix(np.add.reduceat(values, total - size) + size.astype(np.uint64))
