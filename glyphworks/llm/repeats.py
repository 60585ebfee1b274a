"""Repeated passages: a sparse enhanced suffix array and its interval tree.

A passage of ``length`` bytes that occurs in two documents holds the same
*anchor* in both: the leftmost smallest of its hashed ``KMER``-byte words.  So
only suffixes that start at anchors need sorting.  The steps are

1. every piece lists the hashes of its anchors; buckets answer which of them
   occur in two documents or more (nothing else can belong to a repeat);
2. for those, every piece sends the bytes around the anchor - the windows of
   ``length`` bytes that own it - to the anchor's bucket, identical contexts
   once, with the smallest document that has them;
3. a bucket sorts the suffixes that start at its anchors, computes the common
   prefixes of neighbours, and a stack scan finds the tree of common-prefix
   intervals.  Within each interval, occurrences are told apart by what stands
   to the left: the classes in which the left extension differs are the maximal
   repeats, with all their occurrences;
4. the answer for each context says which of its windows occur in a smaller
   document; pieces turn these into removed spans.

Matches never cross documents.  Nulls: a null text is empty; a null doc_id is
larger than every other id, and rows of the same doc_id never remove from each
other, nor do repeated rows.  A very long text is one row of one piece.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphworks.llm._pieces import BLOB_SCHEMA, blobs, bucket_count, clear_worker, cuts, give_back, grouped, ids_of, in_pieces, mix, piece_count, rows_of, spans, texts_of
from glyphworks.llm._shared import written

LENGTH, KMER = 50, 20
_CHUNK = 1 << 15
#: Contexts that are laid out at a time.
_ROWS = 1 << 14
_ODD32 = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491, 0x94D049BB, 0xBF58476D], np.uint32)


def _owners(data: np.ndarray, length: int, kmer: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each start of a window, the start of the anchor that it owns (windows across documents included), some at a time with the first of these."""
    n = len(data) - length + 1
    width = length - kmer + 1
    ramp = np.arange(_CHUNK + width, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for at in range(0, n, _CHUNK):
        m = min(_CHUNK, n - at)
        part = np.concatenate([data[at : at + m + length], np.zeros(8, np.uint8)])
        word = np.ndarray((len(part) - 3,), np.uint32, part.tobytes(), 0, (1,)).copy()
        k = m + width - 1
        h = word[:k] * _ODD32[0]
        for j in range(4, kmer - 3, 4):
            h += word[j : j + k] * _ODD32[j // 4]
            h ^= h >> np.uint32(15)
        h += word[kmer - 4 : kmer - 4 + k] * _ODD32[6]
        h ^= h >> np.uint32(16)
        h *= _ODD32[7]
        h ^= h >> np.uint32(13)
        low_of = (h.astype(np.uint64) << np.uint64(32)) | ramp[:k]
        step = 1
        while 2 * step <= width:
            low_of = np.minimum(low_of[:-step], low_of[step:])
            step *= 2
        if width > step:
            low_of = np.minimum(low_of[: len(low_of) - (width - step)], low_of[width - step :])
        yield at, (low_of[:m] & low).astype(np.int64) + at


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int):
    """Runs of windows that own the same anchor: document, anchor, first and last window."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    firsts, anchors, before = [], [], -1
    for at, owner in _owners(data, length, kmer):
        new = np.empty(len(owner), bool)
        new[0] = owner[0] != before
        np.not_equal(owner[1:], owner[:-1], out=new[1:])
        a, b = np.searchsorted(offsets[:-1], (at, at + len(owner)))
        new[offsets[a:b] - at] = True
        here = np.flatnonzero(new)
        firsts.append(here + at)
        anchors.append(owner[here])
        before = owner[-1]
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    del firsts, anchors
    doc = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offsets[doc + 1] - length)
    keep = first <= last
    return doc[keep], anchor[keep], first[keep], last[keep]


def _hashes(data: np.ndarray, at: np.ndarray, kmer: int) -> np.ndarray:
    """64-bit hashes of the kmer bytes at each place."""
    word = np.ndarray((max(0, len(data) - 7),), np.uint64, np.ascontiguousarray(data), 0, (1,))
    h = np.zeros(len(at), np.uint64)
    for j in [*range(0, kmer - 8, 8), kmer - 8]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[at + j])
    return h


class _Anchors:
    """What all three passes over a piece recompute alike."""

    def __init__(self, table: pa.Table, buckets: int, length: int, kmer: int):
        self.ids = ids_of(table.column("doc_id"))
        data, self.offsets = texts_of(table.column("text"))
        self.data = np.ascontiguousarray(data)
        self.doc, self.anchor, self.first, self.last = _runs(self.data, self.offsets, length, kmer)
        h = _hashes(self.data, self.anchor, kmer)
        value = ((h % np.uint64(buckets)) << np.uint64(40)) | (h >> np.uint64(24))
        order = np.argsort(value, kind="stable")
        start = cuts(value[order])
        self.values = value[order[start]]
        self.bucket = (self.values >> np.uint64(40)).astype(np.int64)
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        last = np.append(start[1:], len(order)) - 1
        # runs are in the order of rows, so the ends of a group show whether it has two rows
        self.multi = self.doc[order[start]] != self.doc[order[last]] if len(order) else np.zeros(0, bool)

    def forget_anchors(self) -> None:
        """Leaves ids and texts only."""
        del self.doc, self.anchor, self.first, self.last, self.values, self.bucket, self.inverse, self.multi


def _five(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :5]


def _list_anchors(table: pa.Table, buckets: int, length: int, kmer: int) -> pa.Table:
    a = _Anchors(table, buckets, length, kmer)
    piece, out = table.column("piece")[0].as_py(), []
    edges = np.append(cuts(a.bucket), len(a.bucket))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        out.append((piece, int(a.bucket[s]), 0, _five(a.values[s:e]).tobytes() + np.packbits(a.multi[s:e]).tobytes() + np.uint32(e - s).tobytes()))
    return blobs(out)


def _shared_anchors(table: pa.Table) -> pa.Table:
    rows = rows_of(table, "piece")
    counts = [int(np.frombuffer(b[-4:], np.uint32)[0]) for *_, b in rows]
    wide = np.zeros((sum(counts), 8), np.uint8)
    multi, at = np.zeros(len(wide), bool), 0
    for (*_, b), n in zip(rows, counts, strict=True):
        wide[at : at + n, :5] = np.frombuffer(b, np.uint8, 5 * n).reshape(n, 5)
        multi[at : at + n] = np.unpackbits(np.frombuffer(b, np.uint8)[5 * n : -4], count=n)
        at += n
    value = wide.view(np.uint64).ravel()
    order = np.argsort(value, kind="stable")
    start = cuts(value[order])
    size = np.diff(np.append(start, len(order)))
    shared = (size > 1) | np.logical_or.reduceat(multi[order], start) if len(start) else np.zeros(0, bool)
    flag = np.empty(len(order), bool)
    flag[order] = np.repeat(shared, size)
    ends = np.cumsum(counts)
    return blobs([(p, k, 0, np.packbits(flag[e - n : e]).tobytes()) for (p, k, _, _), n, e in zip(rows, counts, ends, strict=True)])


class _Contexts:
    """The distinct contexts of a piece's shared anchors, in the order in which they are sent."""

    def __init__(self, a: _Anchors, answers: list[tuple], length: int, kmer: int, bytes_too: bool = True):
        per = np.bincount(a.bucket) if len(a.bucket) else np.zeros(0, np.int64)
        shared = np.zeros(len(a.values), bool)
        at = np.cumsum(per) - per
        for _, k, _, b in answers:
            shared[at[k] : at[k] + per[k]] = np.unpackbits(np.frombuffer(b, np.uint8), count=per[k])
        self.run = np.flatnonzero(shared[a.inverse]) if len(a.inverse) else np.zeros(0, np.int64)
        p, first, last = a.anchor[self.run], a.first[self.run], a.last[self.run]
        left, right = p - first, last + length - p
        side = length - kmer
        # places to the left and to the right of the anchor; the ends of the piece stand for what is beyond them
        step = np.concatenate([-1 - np.arange(side), np.arange(length)])
        grid = np.full((len(p), _row(length, kmer)), 255, np.uint8)
        for s in range(0, len(p), _ROWS):
            e = s + _ROWS
            used = np.concatenate([np.arange(side) < left[s:e, None], np.arange(length) < right[s:e, None]], 1)
            body = a.data.take(p[s:e, None] + step, mode="clip")
            body[~used] = 255
            grid[s:e, : side + length] = body
        grid[:, -2], grid[:, -1] = left, right
        h = np.zeros(len(p), np.uint64)
        for c in range(grid.shape[1] // 8):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(grid[:, 8 * c : 8 * c + 8]).view(np.uint64).ravel())
        bucket = a.bucket[a.inverse[self.run]] if len(self.run) else np.zeros(0, np.int64)
        doc = a.ids[a.doc[self.run]]
        order = np.lexsort((doc, h, bucket))
        hb, bb = h[order], bucket[order]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (hb[1:] != hb[:-1]) | (bb[1:] != bb[:-1])
            for s in range(1, len(order), _ROWS):
                e = min(s + _ROWS, len(order))
                g = grid[order[s - 1 : e]]
                new[s:e] |= (g[1:] != g[:-1]).any(1)
        start = np.flatnonzero(new)
        # only those who send contexts need the bytes
        self.grid, self.bucket, self.least = grid[order[start]] if bytes_too else None, bb[start], doc[order[start]]
        self.of_run = np.empty(len(order), np.int64)
        self.of_run[order] = np.cumsum(new) - 1


def _row(length: int, kmer: int) -> int:
    """Bytes of a context: left, right, two lengths, filled up to whole words."""
    return -(-(2 * length - kmer + 2) // 8) * 8


def _send_contexts(table: pa.Table, answers: pa.Table, buckets: int, length: int, kmer: int) -> pa.Table:
    if not table.num_rows:
        return blobs([])
    c = _Contexts(_Anchors(table, buckets, length, kmer), rows_of(answers, "bucket"), length, kmer)
    piece, out = table.column("piece")[0].as_py(), []
    edges = np.append(cuts(c.bucket), len(c.bucket))
    side = length - kmer
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        g = c.grid[s:e]
        used = np.concatenate([np.arange(side) < g[:, -2:-1], np.arange(length) < g[:, -1:]], 1)
        blob = np.uint32(e - s).tobytes() + c.least[s:e].tobytes() + g[:, -2:].tobytes() + g[:, : side + length][used].tobytes()
        out.append((piece, int(c.bucket[s]), 1, blob))
    return blobs(out)


def _unpack_contexts(rows: list[tuple], length: int, kmer: int):
    side = length - kmer
    counts = [int(np.frombuffer(b[:4], np.uint32)[0]) for *_, b in rows]
    n = sum(counts)
    least, lens, body = np.empty(n, np.int64), np.empty((n, 2), np.uint8), []
    at = 0
    for (*_, b), m in zip(rows, counts, strict=True):
        least[at : at + m] = np.frombuffer(b, np.int64, m, 4)
        lens[at : at + m] = np.frombuffer(b, np.uint8, 2 * m, 4 + 8 * m).reshape(m, 2)
        body.append(np.frombuffer(b, np.uint8, -1, 4 + 10 * m))
        at += m
    grid = np.full((n, side + length), 255, np.uint8)
    used = np.concatenate([np.arange(side) < lens[:, :1], np.arange(length) < lens[:, 1:]], 1)
    grid[used] = np.concatenate(body) if body else np.zeros(0, np.uint8)
    return counts, least, lens.astype(np.int64), grid[:, :side], grid[:, side:]


def _word_keys(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian words that sort as the rows do, most significant first."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each row with the one before (0 for the first); ends: where the rows end, if they may not match beyond that."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        if ends is not None:
            out[1:] = np.minimum(out[1:], np.minimum(ends[1:], ends[:-1]))
    return out


def intervals(lcp: np.ndarray, least: int) -> np.ndarray:
    """The tree of common-prefix intervals: rows (common prefix, that of the parent, first, last), by a stack scan.

    lcp[i] belongs to the suffixes i-1 and i.  Only intervals whose common prefix is at least ``least`` are listed; a
    parent below that counts as least - 1.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []
    low = least - 1
    n = len(lcp)
    for i, x in enumerate([*lcp[1:].tolist(), 0], 1) if n else ():
        if x < least:
            x = low
            if not stack:
                continue
        start = i - 1
        while stack and stack[-1][0] > x:
            depth, start = stack.pop()
            out.append((depth, max(x, stack[-1][0] if stack else low), start, i - 1))
        if x > low and (not stack or stack[-1][0] < x):
            stack.append((x, start))
    return np.array(out, np.int64).reshape(-1, 4)


def window_minima(left: np.ndarray, right: np.ndarray, lens: np.ndarray, least: np.ndarray, length: int, kmer: int) -> np.ndarray:
    """For each context, a bit for each window that a smaller document has.

    Bit i stands for the window that starts i bytes to the left of the anchor.
    """
    side = length - kmer
    bits = np.zeros(len(least), np.uint64)
    if not len(least):
        return bits
    order = np.lexsort(_word_keys(right)[::-1])  # the sparse suffix array
    tree = intervals(_common(right[order]), kmer)
    if not len(tree):
        return bits
    depth, parent, first, last = tree.T
    size = last - first + 1
    node = np.repeat(np.arange(len(tree)), size)
    member = order[spans(first, size)]
    inner = np.lexsort((*_word_keys(left[member])[::-1], node))
    node, member = node[inner], member[inner]
    same = _common(left[member])
    same[cuts(node)] = -1  # another interval
    lo, hi = length - depth[node], length - np.maximum(parent[node], kmer - 1) - 1  # windows for which the interval is the class of what follows the anchor
    doc = least[member]
    reach, back = lens[member, 0], length - lens[member, 1]
    for i in range(side + 1):
        on = (lo <= i) & (i <= hi)
        if not on.any():
            continue
        # left extensions of i bytes that differ start another class; so does another interval
        label = np.cumsum(same < i)[on]
        m, d = member[on], doc[on]
        has = (reach[on] >= i) & (back[on] <= i)
        label, m, d = label[has], m[has], d[has]
        if not len(m):
            continue
        start = cuts(label)
        smallest = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(m))))
        bits[m[smallest < d]] |= np.uint64(1) << np.uint64(i)
    return bits


def _answer_contexts(table: pa.Table, length: int, kmer: int) -> pa.Table:
    rows = rows_of(table, "piece")
    counts, least, lens, left, right = _unpack_contexts(rows, length, kmer)
    bits = window_minima(left, right, lens, least, length, kmer)
    wide = 4 if length - kmer < 32 else 8
    ends = np.cumsum(counts)
    return blobs([(p, k, 1, np.ascontiguousarray(bits[e - n : e].astype(f"<u{wide}")).tobytes()) for (p, k, _, _), n, e in zip(rows, counts, ends, strict=True)])


REMOVED_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, span_starts array<long>, span_ends array<long>"


def _remove(table: pa.Table, answers: pa.Table, buckets: int, length: int, kmer: int, texts: bool) -> pa.Table:
    a = _Anchors(table, buckets, length, kmer) if table.num_rows else None
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(("kept", "span_starts", "span_ends") if texts else ()))}
    if a is not None:
        rows = rows_of(answers, "bucket")
        c = _Contexts(a, [r for r in rows if r[2] == 0], length, kmer, bytes_too=False)
        wide = 4 if length - kmer < 32 else 8
        bits = np.concatenate([np.zeros(0, f"<u{wide}"), *(np.frombuffer(b, f"<u{wide}") for *_, k, b in rows if k == 1)]).astype(np.uint64)
        del rows
        n = len(a.data)
        short = np.int32 if n < 1 << 30 else np.int64
        edge = np.zeros(n + 1, short)  # removed passages that begin here, less those that end

        def add(starts: np.ndarray, ends: np.ndarray) -> None:
            for at, by in ((starts, 1), (ends, -1)):
                at = np.sort(at)
                first = cuts(at)
                edge[at[first]] += by * np.diff(np.append(first, len(at))).astype(short)

        if len(c.run):
            p, first, last = a.anchor[c.run], a.first[c.run], a.last[c.run]
            later = a.ids[a.doc[c.run]] > c.least[c.of_run]
            add(first[later], last[later] + length)
            p, own = p[~later], bits[c.of_run[~later]]
            p, own = p[own > 0], own[own > 0]
            for i in range(length - kmer + 1):
                starts = p[(own >> np.uint64(i)) & np.uint64(1) == 1] - i
                add(starts, starts + length)
            del p, first, last, later, own
        del c, bits
        a.forget_anchors()
        np.cumsum(edge, out=edge)
        gone = edge[:-1] > 0
        del edge
        flip = gone.copy()
        flip[1:] &= ~gone[:-1]
        heads = a.offsets[:-1]
        heads = heads[heads < n]
        flip[heads] = gone[heads]
        total, starts = np.zeros(n + 1, short), np.zeros(n + 1, short)
        np.cumsum(gone, out=total[1:])
        np.cumsum(flip, out=starts[1:])
        ids = table.column("doc_id").to_pylist()
        for d, (s, e) in enumerate(zip(a.offsets[:-1].tolist(), a.offsets[1:].tolist(), strict=True)):
            k = int(total[e] - total[s])
            kept = a.data[s:e] if not k else a.data[s:e][~gone[s:e]]
            out["doc_id"].append(ids[d])
            out["n_bytes"].append(e - s)
            out["n_removed"].append(k)
            out["n_spans"].append(int(starts[e] - starts[s]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts:
                begin = np.flatnonzero(flip[s:e])
                stop = np.flatnonzero(np.append(gone[s:e], False)[1:] < gone[s:e]) + 1 if e > s else begin
                cut = np.unique(np.concatenate([stop, begin[begin > 0][np.isin(begin[begin > 0] - 1, np.flatnonzero(gone[s:e]))]])) if len(begin) else begin
                out["kept"].append(kept.tobytes())
                out["span_starts"].append(begin.tolist())
                out["span_ends"].append(cut.tolist())
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "span_starts": pa.list_(pa.int64()), "span_ends": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, texts: bool = True) -> DataFrame:
    """One row per document without the bytes that a smaller document has in a passage of ``length`` bytes.

    n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what is
    left; with ``texts`` also the bytes left (a removed run can split a code
    point, so they are binary) and the removed spans.  Texts are taken as
    UTF-8; extra columns of docs are not read.
    """
    if not 8 <= kmer <= length < 128 or length - kmer > 63 or kmer % 4:
        raise ValueError("kmer: a multiple of 4 from 8 to length; length: below 128, at most kmer + 63")
    pieces, buckets = piece_count(docs), bucket_count(docs)
    dealt = in_pieces(docs, pieces)
    how = {"buckets": buckets, "length": length, "kmer": kmer}

    def by_piece(fn, other: DataFrame, schema: str) -> DataFrame:
        return grouped(dealt, "piece", pieces).cogroup(grouped(other, "piece", pieces)).applyInArrow(_freed(lambda x, y: fn(x, y)), schema)

    listed = grouped(dealt, "piece", pieces).applyInArrow(_bound(_list_anchors, **how), BLOB_SCHEMA)
    shared = grouped(listed, "bucket", buckets).applyInArrow(_bound(_shared_anchors), BLOB_SCHEMA)
    sent = by_piece(partial(_send_contexts, **how), shared, BLOB_SCHEMA)
    found = grouped(sent, "bucket", buckets).applyInArrow(_bound(_answer_contexts, length=length, kmer=kmer), BLOB_SCHEMA)
    schema = REMOVED_SCHEMA if texts else REMOVED_SCHEMA.partition(", kept binary")[0]
    return by_piece(partial(_remove, texts=texts, **how), shared.unionAll(found), schema)


def classes(left: np.ndarray, right: np.ndarray, lens: np.ndarray, length: int, kmer: int) -> list[tuple[np.ndarray, int, int]]:
    """The maximal repeats among contexts: (their members, bytes to the left of the anchor, bytes from it on).

    An interval of the tree cannot be extended to the right; a class of its members with equal left extensions that
    differ one byte further cannot be extended to the left.
    """
    order = np.lexsort(_word_keys(right)[::-1])
    tree = intervals(_common(right[order], lens[order, 1]), kmer)
    if not len(tree):
        return []
    depth, _, first, last = tree.T
    size = last - first + 1
    node = np.repeat(np.arange(len(tree)), size)
    member = order[spans(first, size)]
    inner = np.lexsort((*_word_keys(left[member])[::-1], node))
    node, member = node[inner], member[inner]
    same = _common(left[member], lens[member, 0])
    same[cuts(node)] = -1
    out = []
    for i in range(length - kmer + 1):
        start = np.flatnonzero(same < i)
        many = np.diff(np.append(start, len(same)))
        diverse = np.logical_or.reduceat(same == i, start)
        listed = diverse & (many > 1) & (depth[node[start]] + i >= length)
        for s, n in zip(start[listed].tolist(), many[listed].tolist(), strict=True):
            out.append((member[s : s + n], i, int(depth[node[s]])))
    return out


def _send_occurrences(table: pa.Table, answers: pa.Table, buckets: int, length: int, kmer: int) -> pa.Table:
    """Contexts as before, and for each of its anchors the context, document and place."""
    sent = _send_contexts(table, answers, buckets, length, kmer)
    if not table.num_rows:
        return sent
    a = _Anchors(table, buckets, length, kmer)
    c = _Contexts(a, rows_of(answers, "bucket"), length, kmer)
    begin = np.searchsorted(c.bucket, c.bucket)
    own = c.of_run - begin[c.of_run]
    doc = a.doc[c.run]
    bucket = c.bucket[c.of_run]
    piece, out = table.column("piece")[0].as_py(), []
    for k in np.unique(bucket).tolist():
        on = bucket == k
        out.append((piece, int(k), 2, own[on].astype(np.int64).tobytes() + a.ids[doc[on]].tobytes() + (a.anchor[c.run[on]] - a.offsets[doc[on]]).tobytes()))
    return pa.concat_tables([sent, blobs(out)])


def _list_groups(table: pa.Table, length: int, kmer: int) -> pa.Table:
    rows = rows_of(table, "piece")
    counts, _, lens, left, right = _unpack_contexts([r for r in rows if r[2] == 1], length, kmer)
    starts = dict(zip((r[0] for r in rows if r[2] == 1), np.cumsum(counts) - counts, strict=True))
    context, doc, place = [], [], []
    for p, _, kind, b in rows:
        if kind == 2:
            x = np.frombuffer(b, np.int64).reshape(3, -1)
            context.append(x[0] + starts[p])
            doc.append(x[1])
            place.append(x[2])
    context, doc, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (context, doc, place))
    by = np.argsort(context, kind="stable")
    edge = np.searchsorted(context[by], np.arange(len(left) + 1))
    # a context that stands in two places is a class of its own: it counts twice
    every = np.concatenate([np.arange(len(left)), np.flatnonzero(np.diff(edge) > 1)])
    out: dict[str, list] = {"group": [], "n_bytes": [], "doc_id": [], "start": []}
    for members, i, after in classes(left[every], right[every], lens[every], length, kmer):
        members = np.unique(every[members])
        own = by[spans(edge[members], edge[members + 1] - edge[members])]
        if (doc[own] == doc[own[0]]).all():
            continue
        text = left[members[0], :i][::-1].tobytes() + right[members[0], :after].tobytes()
        out["group"] += [hashlib.sha256(text).hexdigest()] * len(own)
        out["n_bytes"] += [i + after] * len(own)
        out["doc_id"] += [None if d == np.iinfo(np.int64).max else d for d in doc[own].tolist()]
        out["start"] += (place[own] - i).tolist()
    return pa.table({k: pa.array(v, pa.string() if k == "group" else pa.int64()) for k, v in out.items()})


def _chained(parts: DataFrame) -> DataFrame:
    """Overlapping parts that stand at the same distances from each other in all their places, as one repeat."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = parts.groupBy("group").agg(F.min(place).alias("first")).select(F.xxhash64("group").alias("h"), F.col("group").alias("own"), "first")
    shifted = parts.withColumn("h", F.xxhash64("group")).join(first, "h").where(F.col("group") == F.col("own"))
    mark = F.xxhash64("doc_id", F.col("start") - F.col("first.start"))
    shape = [F.count("*").alias("many"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("y")]
    groups = shifted.groupBy("group", "n_bytes", "first").agg(*shape).select("group", "n_bytes", "first.*", "many", "x", "y")
    same = Window.partitionBy("many", "x", "y", "none", "doc_id")
    reach = F.max(F.col("start") + F.col("n_bytes")).over(same.orderBy("start", "group").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("chain", F.sum("new").over(same.orderBy("start", "group")))
    chains = groups.groupBy("many", "x", "y", "none", "doc_id", "chain").agg(F.min_by("group", F.struct("start", "group")).alias("lead"), (F.max(F.col("start") + F.col("n_bytes")) - F.min("start")).alias("bytes"))
    chains = chains.select(F.xxhash64("lead").alias("h"), "lead", "bytes")
    met = parts.withColumn("h", F.xxhash64("group")).join(chains, "h").where(F.col("group") == F.col("lead"))
    return met.select(F.sha2(F.concat_ws(":", "group", F.col("bytes").cast("string")), 256).alias("group"), F.col("bytes").alias("n_bytes"), "doc_id", "start")


def repeat_groups(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """Maximal repeats of ``length`` bytes or more with all their occurrences: group, n_bytes, doc_id, start in bytes.

    Each bucket finds the repeats around one anchor, as far as its windows reach (2 * length - kmer bytes).
    Parts with the same occurrences are then chained, so a longer passage is one group.  Where a stretch
    of a passage longer than that reach also stands elsewhere, the stretch is a group with more occurrences, and the passage goes on from its end.
    """
    pieces, buckets = piece_count(docs), bucket_count(docs)
    dealt = in_pieces(docs, pieces)
    how = {"buckets": buckets, "length": length, "kmer": kmer}
    listed = grouped(dealt, "piece", pieces).applyInArrow(_bound(_list_anchors, **how), BLOB_SCHEMA)
    shared = grouped(listed, "bucket", buckets).applyInArrow(_bound(_shared_anchors), BLOB_SCHEMA)
    sent = grouped(dealt, "piece", pieces).cogroup(grouped(shared, "piece", pieces)).applyInArrow(_freed(lambda x, y: _send_occurrences(x, y, **how)), BLOB_SCHEMA)
    parts = grouped(sent, "bucket", buckets).applyInArrow(_bound(_list_groups, length=length, kmer=kmer), "group string, n_bytes long, doc_id long, start long")
    return _chained(written(parts.distinct(), "repeat-parts")[0])


def _bound(fn, **how):
    """A plain one-argument function, as applyInArrow wants, that plans show by its own name."""

    def run(table: pa.Table) -> pa.Table:
        clear_worker()
        out = fn(table, **how)
        give_back()
        return out

    run.__name__ = fn.__name__
    return run


def _freed(fn):
    """The same for two arguments."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        clear_worker()
        out = fn(x, y)
        give_back()
        return out

    return run


SQL = r"""
with d as (
  select row_number() over () as row_no, doc_id, coalesce(doc_id, 9223372036854775807) as k, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents
), w as (
  select row_no, k, s, substring(h, 2 * s + 1, 100) as x from (select row_no, k, h, unnest(range(0, n - 49)) as s from d where n >= 50)
), m as (
  select x, min(k) as k from w group by x
), r as (
  select row_no, s, case when s <= lag(s) over (partition by row_no order by s) + 50 then 0 else 1 end as new from w join m using (x) where m.k < w.k
), i as (
  select row_no, s, sum(new) over (partition by row_no order by s) as run from r
), runs as (
  select row_no, run, min(s) as a, max(s) + 50 as b from i group by 1, 2
), g as (
  select row_no, a, b, coalesce(lag(b) over (partition by row_no order by a), 0) as z from runs
), p as (
  select row_no, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' order by a) as head, max(b) as last from g join d using (row_no) group by 1
)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else head || substring(h, 2 * last + 1) end)) as kept_sha256
from d left join p using (row_no)
"""
