"""Vectorised word and n-gram hashes of byte texts (numpy, used inside Spark tasks).

A word is a run of bytes other than 0x20 and 0x09-0x0D. As those bytes occur in
UTF-8 only as themselves, words of the bytes are words of the characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes whose temporary arrays (some ten of 8 bytes a byte) are held at a time.
_CHUNK = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        if n <= 2 * _CHUNK:
            n = 2 * _CHUNK
        up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        tables = np.cumprod(up), np.cumprod(down)
        if n > 2 * _CHUNK:
            return tables
        _powers[base] = tables
    return _powers[base]


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut between words into pieces of a little more than ``limit`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > limit and (gap := _GAP.search(text, at + limit)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def piece_runs(texts: Iterable[bytes], limit: int = 1 << 20) -> Iterator[tuple[list[bytes], list[bool]]]:
    """Runs of pieces of texts, of about ``limit`` bytes, and whether each is the last piece of its text."""
    run: list[bytes] = []
    last: list[bool] = []
    size = 0
    for t in texts:
        for piece in pieces(t, limit):
            if run and size + len(piece) > limit:
                yield run, last
                run, last, size = [], [], 0
            run.append(piece)
            last.append(False)
            size += len(piece) + 1
        last[-1] = True
    if run:
        yield run, last


def word_hashes(texts: Iterable[bytes], seed: int = 0, limit: int = _CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text. Bytes are looked at in runs of about ``limit``."""
    base = (_BASE + 2 * seed * 0x1000193) % (1 << 64) | 1
    hashes, counts, left = [np.empty(0, np.uint64)], [], 0
    for run, done in piece_runs(texts, limit):
        buf = np.frombuffer(b"\n".join(run), np.uint8)
        gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        first, last = edges[0::2], edges[1::2]
        up, down = _power_tables(len(buf) + 1, base)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        h ^= (last - first).astype(np.uint64) * _STEP
        hashes.append(mix(h))
        ends = np.cumsum([len(t) + 1 for t in run])
        for n, ended in zip(np.diff(np.searchsorted(first, ends), prepend=0).tolist(), done):
            left += n
            if ended:
                counts.append(left)
                left = 0
    return np.concatenate(hashes), np.array(counts, np.int64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; texts' borders are the caller's matter."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = words[:size].copy()
    for j in range(1, n):
        h *= _STEP
        h += words[j : j + size]
    return mix(h)


def runs_within(counts: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of n words that starts at each word ends in the same text."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return (left >= n)[: max(0, len(left) - n + 1)]
