"""Looking at files of any size: bytes that are read where they are asked for, and searches in overlapping windows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import BinaryIO

from mediasieve.functions.dictionaries import READABLE

#: Bytes that a view holds, and that searches look at, at a time.
BLOCK = 1 << 20


class FileView:
    """The bytes of an open file; indexed and sliced like ``bytes``, but held one block at a time."""

    def __init__(self, file: BinaryIO, size: int, block: int = BLOCK):
        self._file, self._size, self._block = file, size, block
        self._at, self._held = 0, b""

    def __len__(self) -> int:
        return self._size

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        data = self._file.read(n)
        if len(data) != n:
            raise OSError(f"{len(data)} of {n} bytes at {at}")
        return data

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            start, stop = key, key + 1
        else:
            start, stop, _ = key.indices(self._size)
        if stop <= start:
            return b""
        if stop - start > self._block:
            return self._read(start, stop - start)
        if not self._at <= start <= stop <= self._at + len(self._held):
            self._at, self._held = start, self._read(start, min(self._block, self._size - start))
        found = self._held[start - self._at : stop - self._at]
        return found[0] if isinstance(key, int) else found

    def startswith(self, prefix: bytes) -> bool:
        return self[: len(prefix)] == prefix


def windows(data: bytes | FileView, start: int = 0, end: int | None = None, size: int = BLOCK) -> Iterator[bytes]:
    end = len(data) if end is None else end
    for at in range(start, end, size):
        yield data[at : min(at + size, end)]


class Counter:
    """Non-overlapping occurrences of lower-case byte strings in a stream of windows, whatever its case."""

    def __init__(self, strings: Sequence[bytes]):
        self.strings, self.counts = strings, [0] * len(strings)
        self._rest = [b""] * len(strings)

    def add(self, window: bytes) -> None:
        low = window.lower()
        for k, s in enumerate(self.strings):
            # What was left of the windows before is shorter than the string: only a match across the border needs it.
            text, at = (self._rest[k] + low, 0) if self._rest[k] else (low, 0)
            while (found := text.find(s, at)) >= 0:
                self.counts[k] += 1
                at = found + len(s)
            self._rest[k] = text[max(at, len(text) - len(s) + 1) :]


def longest_runs(data: bytes | FileView, start: int, end: int, least: int, limit: int) -> list[str]:
    """The ``limit`` longest readable runs of at least ``least`` characters between two places, longest first and then in order."""
    best: list[tuple[int, int, str]] = []
    open_parts: list[str] = []
    number = 0

    def close(run: str) -> None:
        nonlocal number
        number += 1
        if len(run) >= least:
            best.append((-len(run), number, run))
            best.sort()
            del best[limit:]

    for window in windows(data, start, end):
        text = window.decode("latin-1")
        for m in re.finditer(READABLE + "+", text):
            if m.start() > 0 and open_parts:
                close("".join(open_parts))
                open_parts = []
            if m.end() == len(text):
                open_parts.append(m.group())
            else:
                close("".join([*open_parts, m.group()]))
                open_parts = []
        if open_parts and text and not re.match(READABLE, text[-1]):
            close("".join(open_parts))
            open_parts = []
    if open_parts:
        close("".join(open_parts))
    return [run for _, _, run in best]
