"""A compression-style language model: online logistic mixing of hashed-context bit predictors.

A text (A-Z in lower case, as UTF-8 bytes, then one end symbol) is spelled in bits: each
symbol by the Huffman code that its predecessor's successors get in the training
documents.  Each bit is predicted from hashed contexts - the last 5 symbols,
the word so far, and that with the word before it - whose counts of zeros and ones come from
all training documents.  The predictions' log-odds are added with weights gated by
the place in the code and by which of the first and the last context are known.  The weights are
learned online: in each block of a text they start from those that suit all training documents, each
half of these as seen by the counts of the other half, and after each CHUNK of symbols
every gate's weights go down the gradient of the cost of its bits.  The first weights are fitted to
the number of bits for each gate and each LEVEL steps of log-odds, summed over all training documents.

score is the log10 probability of the text; bits per byte follow from it.  The weights
of a chunk depend on earlier chunks only, so all texts share a probability of one.

Tables have a slot for each training byte, up to 2**MAX_BITS for each context: that bounds
the memory of a worker.  Beyond it, contexts share slots; no text is left out.

Nulls: a null text is empty (one end token); a null doc_id counts as the text
"" for its fold.  Rows are scored one by one, so repeated rows get the same score, and results
do not depend on how the table is cut.  Very long texts are scored whole, block by block.  Without training
documents all counts are 0 and every score is that of even bits.  An empty table gives no
rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphworks.llm._pieces import BLOB_SCHEMA, blobs, bucket_count, clear_worker, cuts, give_back, grouped, in_pieces, piece_count, rows_of, texts_of
from glyphworks.llm._shingles import token_hashes

FOLDS = 10
#: The contexts: so many last symbols, then the word so far, then that with the word before it.
LENGTH, ORDERS = 5, 3
MIN_BITS, MAX_BITS = 16, 22
#: Symbols after which weights start anew, and after which they are updated; the step down the gradient.
BLOCK, CHUNK, RATE = 4096, 96, 0.02
#: Symbols whose contexts are found at a time (or one text), and those whose bits are, so that arrays of bits stay in a core's cache.
GROUP, PART = 1 << 18, 1 << 15
_END, _SYMBOLS, _PAD, _DEPTH = 256, 257, LENGTH, 8
_GATES = 4 * _DEPTH
_STEP = 12.0 / 127
#: Steps of log-odds that count as one level when the first weights are fitted, and the levels of a signed byte.
LEVEL = 8
_LEVELS = 2 * round(127 / LEVEL) + 1
_CELLS = _LEVELS**ORDERS * _GATES * 2
#: Symbols whose bits are counted in 32 bits at a time; a symbol has fewer than 64 bits.
_SAFE = 1 << 25
#: Log-odds that a mix can reach.
_LIMIT = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: All symbols but A-Z, which no text has; these have no code.
_ALPHABET = np.array([s for s in range(_SYMBOLS) if not 65 <= s <= 90])
_NO_CODE = np.zeros(0, np.uint8), np.zeros(0, np.int64)
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_K = np.uint64(0x9E3779B97F4A7C15)
_END_TOKEN = np.uint64(0x5851F42D4C957F2D)


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return _crc(doc_id) % folds


def _crc(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


class Codes:
    """Huffman codes of each symbol after each other symbol, from counts of pairs; every pair has a code."""

    def __init__(self, pairs: np.ndarray):
        bits: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        self.length = np.zeros((_SYMBOLS, _SYMBOLS), np.int64)
        total = pairs.sum(0) + 1.0
        for prev in range(_SYMBOLS):
            # unseen pairs share a little in proportion to the symbol's own count, which also bounds code lengths
            weight = pairs[prev] + 0.01 * total / total.sum() + 1e-6
            coded = dict(zip(_ALPHABET.tolist(), _huffman(weight[_ALPHABET]), strict=True))
            for s in range(_SYMBOLS):
                b, n = coded.get(s, _NO_CODE)
                self.length[prev, s] = len(b)
                bits.append(b)
                nodes.append(n + prev * _SYMBOLS)
        self.offset = (np.cumsum(self.length) - self.length.ravel()).reshape(self.length.shape)
        self.bits, self.nodes = np.concatenate(bits), np.concatenate(nodes)
        depth = np.arange(len(self.bits)) - np.repeat(self.offset.ravel(), self.length.ravel())
        self.depth = np.minimum(depth, _DEPTH - 1).astype(np.uint8)
        # inner nodes by weight, the root first: a context's counts of all nodes stand side by side, the common ones in one cache line
        rank = len(_ALPHABET) - 2 - self.nodes % _SYMBOLS
        self.node_hash = rank.astype(np.uint32) << _shift(slot_count(int(pairs.sum())))


def _huffman(weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each symbol the bits of its code and the inner nodes where they are taken."""
    heap = [(w, i, -1 - i) for i, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a[2], b[2]))
        heapq.heappush(heap, (a[0] + b[0], len(weight) + len(children), len(children) - 1))
    out: list = [None] * len(weight)
    stack = [(heap[0][2], [], [])]
    while stack:
        at, bits, nodes = stack.pop()
        if at < 0:
            out[-1 - at] = (np.array(bits, np.uint8), np.array(nodes, np.int64))
            continue
        for bit, child in enumerate(children[at]):
            stack.append((child, [*bits, bit], [*nodes, at]))
    return out


def _streams(data: np.ndarray, offsets: np.ndarray):
    """Texts in one array of symbols, each after _PAD end symbols and before one; the places of what is predicted, and their text."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    size = lens + _PAD + 1
    start = np.cumsum(size) - size
    stream = np.full(int(size.sum()), _END, np.uint16)
    doc = np.repeat(np.arange(n), lens)
    at = np.arange(len(data)) + (start + _PAD - offsets[:-1])[doc]
    stream[at] = _FOLD[data]
    sent = np.ones(len(stream), bool)
    sent[(start[:, None] + np.arange(_PAD)).ravel()] = False
    return stream, np.flatnonzero(sent), lens + 1


def _mix32(h: np.ndarray) -> np.ndarray:
    """A finalizer of 32-bit hashes, in place."""
    for shift, factor in ((16, _C[0]), (15, _C[1])):
        h ^= h >> np.uint32(shift)
        h *= factor
    h ^= h >> np.uint32(16)
    return h


def _contexts(stream: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Hashes of what precedes each place: of the last symbols, the word so far, and the word before it too."""
    n, last = len(stream), at - 1
    # the last symbols are read as one number, an end as an A, which no text has; the first places of the array are not asked for
    ends = stream == _END
    padded = np.zeros(n + 7, np.uint8)
    padded[7:] = stream
    padded[7:][ends] = 65
    held = np.ndarray(n, np.uint64, padded, strides=(1,)) >> np.uint64(64 - 8 * LENGTH)
    held *= _K
    held >>= np.uint64(32)
    recent = _mix32(held.astype(np.uint32))
    letter = stream > 32
    letter &= ~ends
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    first = np.flatnonzero(starts)
    # before the first word of a text stands an empty one, so that it has no word of another text before it
    starts[np.cumsum(size + _PAD) - size - _PAD] = True
    begun = np.cumsum(starts, dtype=np.intp)
    own = begun.take(first)
    at_start, base, whole = np.zeros(begun[-1] + 1, np.intp), np.zeros(begun[-1] + 1, np.uint32), np.zeros(begun[-1] + 1, np.uint32)
    s = stream.astype(np.uint32)
    so_far = s + np.uint32(1)
    so_far *= letter
    if len(first):
        final = letter.copy()
        final[:-1] &= ~letter[1:]
        final = np.flatnonzero(final)  # a text begins and ends with an end symbol, so words do too
        at_start[own] = first
        place = np.arange(n)
        place -= at_start.take(begun)
        power = np.multiply.accumulate(np.full(int((final - first).max()) + 1, _C[2], np.uint32))
        so_far *= power.take(place, mode="clip")
        # running sums over all letters, less what stood before the word
        np.cumsum(so_far, out=so_far)
        base[own] = so_far.take(first - 1)
        so_far -= base.take(begun)
        so_far *= letter
        whole[own] = so_far.take(final)
    so_far += s * _C[1]
    word = _mix32(so_far)
    before = begun
    before -= letter
    both = whole.take(before)
    both *= _C[0]
    both ^= word
    return [recent.take(last), word.take(last), _mix32(both).take(last)]


def _spelled(prev: np.ndarray, sym: np.ndarray, codes: Codes):
    """Bits of the given symbols: for each the place of its symbol, and its place in the code tables; and the bits of each symbol."""
    pair = prev.astype(np.int64) * _SYMBOLS + sym
    n = codes.length.ravel().take(pair)
    ends = np.cumsum(n)
    # every symbol of a text has a bit or more, so this is np.repeat in a third of its time
    owner = np.zeros(int(n.sum()), np.intp)
    owner[ends[:-1]] = 1
    np.cumsum(owner, out=owner)
    where = (codes.offset.ravel().take(pair) - (ends - n)).take(owner, mode="clip")
    where += np.arange(len(owner))
    return owner, where, n


def _groups(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, end
        at = end


def _shift(slots: int) -> np.uint32:
    return np.uint32(32 - (slots.bit_length() - 1))


def slot_count(symbols: int) -> int:
    """Slots of each context's table for so many training symbols."""
    return 1 << min(MAX_BITS, max(MIN_BITS, symbols.bit_length()))


def count_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(_SYMBOLS * _SYMBOLS, np.int64)
    for a, b in _groups(offsets, 1 << 20):
        stream, at, _ = _streams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        total += np.bincount(stream[at - 1].astype(np.int64) * _SYMBOLS + stream[at], minlength=len(total))
    return total


def _parts(n: int) -> Iterator[slice]:
    return (slice(i, i + PART) for i in range(0, n, PART))


def count_bits(data: np.ndarray, offsets: np.ndarray, codes: Codes, into: np.ndarray) -> None:
    """Adds the zeros and ones of all contexts to into[order, 2 * slot + bit]."""
    shift, one = _shift(into.shape[1] // 2), into.dtype.type(1)
    for a, b in _groups(offsets, GROUP):
        stream, at, size = _streams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        contexts, prev, sym = _contexts(stream, at, size), stream.take(at - 1), stream.take(at)
        for part in _parts(len(at)):
            owner, where, _ = _spelled(prev[part], sym[part], codes)
            node, bit = codes.node_hash.take(where, mode="clip"), codes.bits.take(where, mode="clip")
            for own, c in zip(into, contexts, strict=True):
                slot = c[part].take(owner, mode="clip")
                slot += node
                slot >>= shift
                slot <<= np.uint32(1)
                slot |= bit
                np.add.at(own, slot.astype(np.intp), one)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Counts [..., 2] as small integers of log-odds, drawn to 0 where there are few."""
    zeros, ones = counts[..., 0].astype(np.float64), counts[..., 1].astype(np.float64)
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    return np.clip(np.rint(odds / _STEP), -127, 127).astype(np.int8)


def _revived(kind, state: dict):
    """An object from its fields: broadcasts carry plain values, so that executors need no copy of this package."""
    out = object.__new__(kind)
    out.__dict__.update(state)
    return out


class Model:
    """Codes, tables [order, slot] of log-odds in steps, and first weights [order, gate] of those steps."""

    def plain(self) -> dict:
        return self.__dict__ | {"codes": self.codes.__dict__}

    @classmethod
    def revive(cls, state: dict) -> Model:
        return _revived(cls, state | {"codes": _revived(Codes, state["codes"])})

    def __init__(self, codes: Codes, tables: np.ndarray, weights: np.ndarray | None = None):
        self.codes = codes
        self.tables = tables
        if weights is None:
            weights = np.full((ORDERS, _GATES), 0.3 * _STEP, np.float32)
        self.weights = weights

    def _features(self, stream, at, size):
        """Steps of log-odds of each bit by context, the bits, their gates, the symbols that own them and the bits of each symbol."""
        return self._steps(stream.take(at - 1), stream.take(at), _contexts(stream, at, size))

    def _steps(self, prev, sym, contexts):
        owner, where, n = _spelled(prev, sym, self.codes)
        node, shift = self.codes.node_hash.take(where, mode="clip"), _shift(self.tables.shape[1])
        x = np.empty((ORDERS, len(where)), np.int8)
        for k, c in enumerate(contexts):
            slot = c.take(owner, mode="clip")
            slot += node
            slot >>= shift
            self.tables[k].take(slot, out=x[k], mode="clip")
        gate = self.codes.depth.take(where, mode="clip")
        gate <<= np.uint8(2)
        gate |= (x[0] != 0).view(np.uint8) << np.uint8(1)
        gate |= (x[2] != 0).view(np.uint8)
        return x, self.codes.bits.take(where, mode="clip"), gate, owner, n

    def spread(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many bits of the given texts have each level of log-odds in each context, each gate and each value."""
        total, some, held = np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.uint32), 0
        one, scale = some.dtype.type(1), np.float32(1 / LEVEL)
        for a, b in _groups(offsets, GROUP):
            stream, at, size = _streams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            contexts, prev, sym = _contexts(stream, at, size), stream.take(at - 1), stream.take(at)
            for part in _parts(len(at)):
                x, y, gate, _, _ = self._steps(prev[part], sym[part], [c[part] for c in contexts])
                # numbers of cells fit into floats
                level = x.astype(np.float32)
                level *= scale
                np.rint(level, out=level)
                level += _LEVELS // 2
                cell = level[0]
                for own in level[1:]:
                    cell *= _LEVELS
                    cell += own
                cell *= 2 * _GATES
                gate <<= np.uint8(1)
                gate |= y
                cell += gate
                np.add.at(some, cell.astype(np.intp), one)
                held += len(prev[part])
                if held > _SAFE:
                    total += some
                    some[:], held = 0, 0
        return total + some

    def fit(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """The first weights for the given texts."""
        self.fit_spread(self.spread(data, offsets))

    def fit_spread(self, counts: np.ndarray, rounds: int = 8) -> None:
        """The first weights by Newton steps, from the numbers of bits."""
        counts = counts.reshape(-1, _GATES, 2)
        level = np.clip((np.arange(_LEVELS) - _LEVELS // 2) * LEVEL, -127, 127) * _STEP
        grid = np.stack(np.meshgrid(*[level] * ORDERS, indexing="ij")).reshape(ORDERS, -1)
        for g in range(_GATES):
            on = np.flatnonzero(counts[:, g].any(1))
            zeros, ones = counts[on, g].astype(np.float64).T
            many = zeros + ones
            if many.sum() < 50:
                continue
            a = grid[:, on]
            w = self.weights[:, g] / _STEP
            prior = w.copy()
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
                hess = (a * (p * (1 - p) * many)) @ a.T + np.eye(len(w))
                w += np.clip(np.linalg.solve(hess, a @ (ones - p * many) - (w - prior)), -1, 1)
            self.weights[:, g] = w * _STEP

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text, its end included."""
        out = np.zeros(len(offsets) - 1)
        for a, b in _groups(offsets, GROUP):
            cost, size = self.symbol_bits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out[a:b] = np.add.reduceat(cost, np.cumsum(size) - size)
        return out

    def symbol_bits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each symbol of all texts, ends included, and the symbols of each text."""
        stream, at, size = _streams(data, offsets)
        contexts, prev, sym = _contexts(stream, at, size), stream.take(at - 1), stream.take(at)
        doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(at)) - (np.cumsum(size) - size).take(doc)
        blocks = -(-size // BLOCK)
        lane = (np.cumsum(blocks) - blocks).take(doc) + place // BLOCK
        lane *= _GATES
        chunk = (place % BLOCK // CHUNK).astype(np.uint16)
        order = np.argsort(chunk, kind="stable")  # chunk by chunk, the lanes in order in each
        ends = np.append(0, np.cumsum(np.bincount(chunk)))
        weights = np.tile(self.weights, (1, int(blocks.sum())))
        rate = np.float32(RATE * _STEP * _STEP)
        cost = np.empty(len(at))
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            now = order[s:e]
            x, y, gate, owner, n = self._steps(prev.take(now), sym.take(now), [c.take(now) for c in contexts])
            own = lane.take(now).take(owner, mode="clip")
            own += gate
            # steps towards the other bit
            x *= 1 - 2 * y.view(np.int8)
            steps = x.astype(np.float32)
            z = weights[0].take(own, mode="clip")
            z *= steps[0]
            for k in range(1, ORDERS):
                more = weights[k].take(own, mode="clip")
                more *= steps[k]
                z += more
            np.clip(z, -_LIMIT, _LIMIT, out=z)
            odds = np.exp(z, out=z)  # of the other bit
            total = odds + 1
            # a symbol's cost is the logarithm of a product, which stays within a double for so many bits
            heads = np.cumsum(n) - n
            cost[now] = np.log(np.multiply.reduceat(total.astype(np.float64), heads)) if n.max() <= 40 else np.add.reduceat(np.log(total), heads, dtype=np.float64)
            odds /= total
            steps *= odds
            for k in range(ORDERS):
                weights[k] -= rate * np.bincount(own, steps[k], weights.shape[1]).astype(np.float32)
        return cost / np.log(2), size


def _texts(docs: DataFrame, folds: int) -> DataFrame:
    """Texts with their fold and, by another part of the same hash, their half."""
    crc = _crc(F.col("doc_id"))
    half = F.floor(crc / folds) % 2
    return docs.select(fold_of(F.col("doc_id"), folds).alias("fold"), half.cast("int").alias("half"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _summed(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sums of an array of a fixed size over all tasks, in two steps; fn takes the texts of a half and the number of that half."""

    def row(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), total[at])], names=["at", "c"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        total = np.zeros(size, np.int64)
        for b in batches:
            half = b.column("half").to_numpy()
            for k in range(2):
                own = np.flatnonzero(half == k)
                if len(own):
                    total += fn(*texts_of(b.column("text").take(pa.array(own))), k)
        yield row(total)
        del total
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for at, c in zip(b.column("at"), b.column("c"), strict=True):
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(c.as_buffer(), np.int64)
        yield row(total)

    out = np.zeros(size, np.int64)
    for r in df.select("half", "text").mapInArrow(parts, "at binary, c binary").repartition(4).mapInArrow(add, "at binary, c binary").collect():
        out[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.c, np.int64)
    return out


SLICES = 64
#: Symbols after which a task sends its 32-bit counts and starts anew, so that none can overflow.
FLUSH = 1 << 30


def _sparse(counts: np.ndarray) -> bytes:
    """Which counts are not 0, a byte for each of these, and four for those that do not fit below 255."""
    used = counts[counts > 0]
    return np.packbits(counts > 0).tobytes() + np.minimum(used, 255).astype(np.uint8).tobytes() + used[used >= 255].astype("<u4").tobytes()


def _add_sparse(blob: bytes, into: np.ndarray) -> None:
    bitmap = len(into) // 8
    on = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, bitmap)))
    used = np.frombuffer(blob, np.uint8, len(on), bitmap).astype(np.int64)
    used[used == 255] = np.frombuffer(blob, "<u4", -1, bitmap + len(on))
    into[on] += used


def _tables(train: DataFrame, codes, slots: int) -> np.ndarray:
    """Log-odds of all slots from the counts of every training text, and of each half: tasks send their counts, reducers add them as they come."""
    width = slots // SLICES

    def counted(half: int) -> DataFrame:
        # a task counts one half, so that a worker holds one table
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clear_worker()
            total, held = np.zeros((ORDERS, 2 * slots), np.uint32), 0
            own_codes = _revived(Codes, codes.value)

            def send(total: np.ndarray) -> Iterator[pa.RecordBatch]:
                for k, own in enumerate(total.reshape(ORDERS * SLICES, 2 * width)):
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([half], pa.int32()), pa.array([_sparse(own)], pa.binary())], names=["part", "half", "blob"])

            for b in batches:
                data, offsets = texts_of(b.column("text"))
                if held + len(data) + len(offsets) > FLUSH:
                    yield from send(total)
                    total[:], held = 0, 0
                count_bits(data, offsets, own_codes, total)
                held += len(data) + len(offsets)
            yield from send(total)
            del total
            give_back()

        return train.where(F.col("half") == half).select("text").mapInArrow(count, "part int, half int, blob binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, half, blob in zip(*(b.column(k).to_pylist() for k in ("part", "half", "blob")), strict=True):
                _add_sparse(blob, sums.setdefault(part, np.zeros((2, 2 * width), np.int64))[half])
        for part, own in sums.items():
            odds = np.concatenate([log_odds(x.reshape(-1, 2)) for x in (own.sum(0), *own)])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([odds.tobytes()], pa.binary())], names=["part", "odds"])
        sums.clear()
        give_back()

    out = np.zeros((3, ORDERS * SLICES, width), np.int8)
    for r in counted(0).unionAll(counted(1)).repartitionById(ORDERS * SLICES, "part").mapInArrow(add, "part int, odds binary").collect():
        out[:, r.part] = np.frombuffer(r.odds, np.int8).reshape(3, width)
    return out.reshape(3, ORDERS, slots)


def _spread(train: DataFrame, codes, halves: np.ndarray) -> np.ndarray:
    """The bits of all training texts by level, gate and value, each half by the tables of the other."""
    shared = train.sparkSession.sparkContext.broadcast(halves)

    def of(data: np.ndarray, offsets: np.ndarray, half: int) -> np.ndarray:
        return Model(_revived(Codes, codes.value), shared.value[1 - half]).spread(data, offsets)

    out = _summed(train, of, _CELLS)
    shared.unpersist()
    return out


def train(docs: DataFrame, folds: int = FOLDS) -> Model:
    """A model of all documents outside fold 0."""
    texts = _texts(docs, folds).where("fold <> 0")
    pairs = _summed(texts, lambda data, offsets, half: count_pairs(data, offsets), _SYMBOLS * _SYMBOLS).reshape(_SYMBOLS, _SYMBOLS)
    codes = Codes(pairs.astype(np.float64))
    slots = slot_count(int(pairs.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(codes.__dict__)
    every, *halves = _tables(texts, shared, slots)
    model = Model(codes, every.copy())
    model.fit_spread(_spread(texts, shared, np.stack(halves)))
    return model


def _ask(table: pa.Table, buckets: int) -> pa.Table:
    """Distinct tokens of a piece with their training counts, one blob to every bucket."""
    if not table.num_rows:
        return blobs([])
    tokens, n = _tokens(table)
    learned = np.repeat((table.column("fold").to_numpy() != 0).astype(np.uint64), n)
    key = np.sort((tokens << np.uint64(1)) | learned)
    start = cuts(key >> np.uint64(1))
    distinct, count = key[start] >> np.uint64(1), np.add.reduceat(key & np.uint64(1), start)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    piece, out = table.column("piece")[0].as_py(), []
    for k in range(buckets):
        own = order[ends[k] : ends[k + 1]]
        out.append((piece, k, 0, np.uint32(len(own)).tobytes() + distinct[own].tobytes() + count[own].astype(np.uint32).tobytes()))
    return blobs(out)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the tokens of all documents, ends included, and the number of each document's."""
    data, offsets = texts_of(table.column("text"))
    parts, counts = [], []
    for a, b in _groups(offsets, 1 << 18):
        h, n = token_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(np.insert(h, np.cumsum(n), _END_TOKEN))
        counts.append(n + 1)
    return np.concatenate(parts) >> np.uint64(1), np.concatenate(counts)


def _total(table: pa.Table) -> pa.Table:
    rows = rows_of(table, "piece")
    sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for *_, b in rows]
    hashes = np.concatenate([np.frombuffer(b, np.uint64, n, 4) for (*_, b), n in zip(rows, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(b, np.uint32, n, 4 + 8 * n) for (*_, b), n in zip(rows, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    start = cuts(hashes[order])
    total = np.add.reduceat(counts[order], start) if len(start) else counts
    every = np.empty(len(order), np.int64)
    every[order] = np.repeat(total, np.diff(np.append(start, len(order))))
    stats = np.array([counts.sum(), np.count_nonzero(total)], np.int64).tobytes()
    ends = np.cumsum(sizes)
    wide = lambda x: x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)
    return blobs([(p, k, 0, stats + wide(every[e - n : e]).tobytes()) for (p, k, _, _), n, e in zip(rows, sizes, ends, strict=True)])


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _score(table: pa.Table, answers: pa.Table, model) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
    if not table.num_rows:
        return pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})
    data, offsets = texts_of(table.column("text"))
    tokens, n = _tokens(table)
    distinct, index = np.unique(tokens, return_inverse=True)
    rows = rows_of(answers, "bucket")
    bucket = (distinct % np.uint64(len(rows))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(rows))
    total = vocabulary = 0
    found = []
    for (*_, b), m in zip(rows, sizes.tolist(), strict=True):
        a, v = np.frombuffer(b, np.int64, 2)
        total, vocabulary = total + int(a), vocabulary + int(v)
        found.append(np.frombuffer(b, np.uint32 if len(b) - 16 == 4 * m else np.uint64, m, 16).astype(np.int64))
    c = np.empty(len(distinct), np.int64)
    c[order] = np.concatenate(found)
    each = c[index]
    start = np.cumsum(n) - n
    base = np.add.reduceat(np.log10((each + 0.1) / (total + 0.1 * (vocabulary + 1))), start)
    known = np.add.reduceat((each > 0).astype(np.int64), start)
    del tokens, distinct, index, each, found, c
    bits = Model.revive(model.value).bits(data, offsets)
    give_back()
    size = np.diff(offsets)
    values = [table.column("doc_id"), table.column("fold").to_numpy() == 0, n, known, np.full(len(n), total), base, -bits * np.log10(2), size, bits / np.maximum(size, 1)]
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for k, t, v in zip(names, kinds, values, strict=True)})


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per document: its fold, token counts, the unigram base and the model's log10 probability, and bits per byte."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, folds).plain())
    pieces, buckets = piece_count(docs), bucket_count(docs)
    dealt = in_pieces(docs, pieces, fold_of(F.col("doc_id"), folds).cast("int").alias("fold"))
    asked = grouped(dealt, "piece", pieces).applyInArrow(lambda t: _ask(t, buckets), BLOB_SCHEMA)
    counted = grouped(asked, "bucket", buckets).applyInArrow(lambda t: _total(t), BLOB_SCHEMA)
    return grouped(dealt, "piece", pieces).cogroup(grouped(counted, "piece", pieces)).applyInArrow(lambda x, y: _score(x, y, model), SCORE_SCHEMA)
