"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from glyphworks.llm._pieces import mix

WORDS = 5
_CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = np.uint64(pow(_BASE, filled, 1 << 64))
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
    return out


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words - runs of other bytes than ASCII space, A-Z in lower case - and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    black = ~_SPACE[data]
    begin = black.copy()
    begin[1:] &= ~black[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begin[heads] = black[heads]
    at = np.flatnonzero(black)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    first = np.flatnonzero(begin[at])
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[_FOLD[data[at]]] * _powers(int(size.max()))[place], first)
    count = np.diff(np.searchsorted(at[first], offsets))
    return mix(h), count


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte, a long text alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingles; fewer words than that are one shingle, none are none."""
    for a, b in _chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        tokens, count = token_hashes(data[offsets[a] : offsets[b]], part)
        wide = len(tokens) - words + 1
        full = np.zeros(max(0, wide), np.uint64)
        for j in range(words):
            full += tokens[j : j + wide] * _PLACE[j] if wide > 0 else 0
        full = mix(full)
        start = 0
        for c in count.tolist():
            if c >= words:
                yield np.unique(full[start : start + c - words + 1])
            elif c:
                yield mix((tokens[start : start + c] * _PLACE[words : words + c]).sum(keepdims=True, dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            start += c
