"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block holds the symbols of consecutive documents.  Symbol i is in lane i mod
W at step i div W; each lane has a 64-bit state, and all lanes share one stream of
32-bit words, taken in lane order at each step.  The frequency table is shared by
all blocks.  A block can be decoded alone, and from each of its checkpoints
(states of all lanes, and the place in the stream, before a step).

Layout, little-endian: magic "RNS1", lanes u32, symbols u64, words u64, step between
checkpoints u32, checkpoints u32, CRC-32 of the symbols as u32 u32, CRC-32 of all that follows u32;
then for each checkpoint the place u64 and W states u64; then the words.  The
first checkpoint is at step 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES, EVERY = 2048, 64
_LOW = np.uint64(1 << 31)
_HEAD = "<4sIQQIIII"
MAGIC = b"RNS1"


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits; whatever occurs keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(used):
        return out
    total = 1 << bits
    if len(used) > total // 2:
        raise ValueError(f"{len(used)} symbols need more than {bits} bits")
    room = total - len(used)
    share = counts[used].astype(np.float64) * (room / counts[used].sum())
    out[used] = 1 + np.floor(share).astype(np.int64)
    rest = total - int(out.sum())
    by_loss = used[np.argsort(-(share - np.floor(share)), kind="stable")]
    out[by_loss[:rest]] += 1
    return out


class Table:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(symbols: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    n = len(symbols)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    bits = np.uint64(table.bits)
    shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    put = 0
    for t in range(steps - 1, -1, -1):
        s = symbols[t * lanes : (t + 1) * lanes]
        f, c = table.freq[s], table.start[s]
        own = x[: len(s)]
        full = own >= (f << (np.uint64(63) - bits))
        if full.any():
            out = own[full]
            words.append((out & low32).astype("<u4"))
            put += len(out)
            own[full] = out >> shift
        d = own // f
        own[:] = (d << bits) + (own - d * f) + c
        if t % every == 0:
            marks.append((put, x.copy()))
    marks = marks[::-1] or [(0, x.copy())]
    body = b"".join(struct.pack("<Q", put - p) + v.astype("<u8").tobytes() for p, v in marks) + b"".join(w.tobytes() for w in words[::-1])
    ids = zlib.crc32(np.ascontiguousarray(symbols, "<u4").tobytes())
    return struct.pack(_HEAD, MAGIC, lanes, n, put, every, len(marks), ids, zlib.crc32(body)) + body


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None, verify: bool = True) -> np.ndarray:
    """The symbols, or those from checkpoint ``first`` up to checkpoint ``last``."""
    magic, lanes, n, put, every, marks, ids, body_crc = struct.unpack_from(_HEAD, block)
    body = memoryview(block)[struct.calcsize(_HEAD) :]
    if magic != MAGIC or (verify and zlib.crc32(body) != body_crc):
        raise ValueError("a block is damaged")
    size = 8 + 8 * lanes
    (at,) = struct.unpack_from("<Q", body, first * size)
    x = np.frombuffer(body, "<u8", lanes, first * size + 8).astype(np.uint64)
    words = np.frombuffer(body, "<u4", put, marks * size)
    steps = -(-n // lanes)
    stop = steps if last is None else min(steps, last * every)
    bits, mask, shift = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    symbol, freq, start = table.symbol, table.freq, table.start
    out = np.empty(max(0, min(n, stop * lanes) - first * every * lanes), np.uint32)
    done = 0
    for t in range(first * every, stop):
        own = x[: min(lanes, n - t * lanes)]
        slot = own & mask
        s = symbol[slot]
        out[done : done + len(s)] = s
        done += len(s)
        own[:] = freq[s] * (own >> bits) + slot - start[s]
        need = own < _LOW
        k = int(np.count_nonzero(need))
        if k:
            own[need] = (own[need] << shift) | words[at : at + k]
            at += k
    if verify and first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != ids:
        raise ValueError("decoded symbols differ from what was encoded")
    return out
