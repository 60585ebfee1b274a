"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as a hashed embedding of itself and the mean of hashed embeddings of its
character 3- and 4-grams.  The network reads windows of ``WINDOW`` words that overlap by
half; the whole text is covered, and a document's score is that of its worst
window.  Everything is numpy, training included.

The network is fitted in one task, on an executor, to a bounded sample of labelled
documents outside fold 0 (SAMPLE_TOXIC, SAMPLE_CLEAN, of at most SAMPLE_BYTES); the
driver passes its parameters on.  If that executor is lost, the task runs again and
gives the same parameters.  Labels belong to
documents, so each is represented by one window: at first the one with the
most telling word by log-odds, then the one that the network itself scores highest.

Nulls: a null text is empty; a text without words gets the share of toxic documents in
the sample as its score, at most 0.49.  A null doc_id counts as "" for its fold.  Labels
that are null or neither 0 nor 1 are not used.  Repeated rows get equal scores; of
several labels of a document the largest counts.  Texts of any length are scored whole,
a megabyte of features at a time.  Without labels, or with one kind only, all scores are
equal.  Extra columns, whatever their names, are not read; keep_clean returns them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.llm._pieces import clear_worker, cuts, give_back, mix, spans, texts_of, thinned
from glyphworks.llm._shared import trim_driver
from glyphworks.llm._shingles import token_hashes
from glyphworks.llm.decontaminate import FOLD

FOLDS, WINDOW, STRIDE = 5, 64, 32
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 3000, 20_000
HIDDEN, WIDTH, TABLE = 8, 12, 1 << 17
EPOCHS, BATCH, RATE, SEED = (4, 3, 3), 128, 0.02, 7
#: Texts of the sample in which a word or gram must be seen.
SEEN = 3
_WORDS_ONLY = np.frombuffer(FOLD, np.uint8)
_LANES, _WORDS_AT_ONCE = 2048, 1 << 16


class Words:
    """The distinct words of some texts, their features, and the texts as indexes of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts: list[tuple] = []
        for a, b in _groups(offsets, 1 << 20):  # a megabyte at a time: the arrays below are many times that
            folded, own = _WORDS_ONLY[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            black = folded != 32
            begin = black.copy()
            begin[1:] &= ~black[:-1]
            heads = own[:-1][own[:-1] < len(folded)]
            begin[heads] = black[heads]
            at, inside = np.flatnonzero(begin), np.flatnonzero(black)
            size = np.diff(np.append(np.searchsorted(inside, at), len(inside)))
            parts.append((*token_hashes(folded, own), at + offsets[a], size))
        hashes, self.count, at, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        distinct, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (distinct & np.uint64(TABLE - 1)).astype(np.int64)
        at, size = at[first], size[first]
        parts = [self._spelled(data, at[i : i + _WORDS_AT_ONCE], size[i : i + _WORDS_AT_ONCE]) for i in range(0, len(at), _WORDS_AT_ONCE)]
        self.grams = np.concatenate([np.zeros(0, np.int64), *parts])
        self.n_grams = 2 * size - 1
        self.gram_start = np.cumsum(self.n_grams) - self.n_grams

    @staticmethod
    def _spelled(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hashed grams of some words, each between two marks."""
        padded = size + 2
        start = np.cumsum(padded) - padded
        flat = np.full(int(padded.sum()) + 3, 1, np.uint64)
        flat[start + padded - 1] = 2
        flat[spans(start + 1, size)] = _WORDS_ONLY[data[spans(at, size)]]
        three = flat[:-3] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[2:-1] * np.uint64(0x165667B19E3779F9)
        four = mix(three + flat[3:] * np.uint64(0x27D4EB2F165667C5))
        grams = np.stack([mix(three), four], 1) & np.uint64(TABLE - 1)
        # word of n letters: n 3-grams and n - 1 4-grams, marks included
        keep = np.ones(grams.shape, bool)
        keep[start + padded - 2] = keep[start + padded - 1] = False
        keep[start + padded - 3, 1] = False
        keep[int(padded.sum()) :] = False
        return grams[keep].astype(np.int64)

    def windows(self, window: int = WINDOW, stride: int = STRIDE):
        """Text, first token and length of each window; texts without words have none."""
        many = np.where(self.count > 0, 1 + np.maximum(0, -(-(self.count - window) // stride)), 0)
        text = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        base = (np.cumsum(self.count) - self.count)[text]
        return text, base + nth * stride, np.minimum(window, self.count[text] - nth * stride)

    def grid(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Word indexes of the windows, one past the last word where there is none."""
        place = np.arange(int(size.max(initial=1)))
        out = np.full((len(first), len(place)), len(self.word), np.int64)
        inside = place < size[:, None]
        out[inside] = self.index[spans(first, size)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _row_sums(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the values of each."""
    order = np.argsort(row, kind="stable")
    start = cuts(row[order])
    return row[order[start]], np.add.reduceat(values[order], start, 0)


class Network:
    """Parameters by name; forward passes for scoring, and gradients for training."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None):
        if parameters is None:
            rng = np.random.default_rng(SEED)
            draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            h = HIDDEN
            parameters = {"word": np.zeros((TABLE, WIDTH), np.float32), "gram": np.zeros((TABLE, WIDTH), np.float32), "v": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
            for d in "fb":
                parameters |= {f"x{d}": draw(2 * WIDTH, 3 * h, scale=0.3), f"c{d}": np.zeros(3 * h, np.float32), f"u{d}": draw(h, 3 * h, scale=0.3)}
        self.p = parameters

    def embed(self, w: Words) -> np.ndarray:
        if not len(w.word):
            return np.zeros((0, 2 * WIDTH), np.float32)
        grams = np.add.reduceat(self.p["gram"].take(w.grams, 0), w.gram_start, 0) / w.n_grams[:, None].astype(np.float32)
        return np.concatenate([self.p["word"].take(w.word, 0), grams], 1)

    def project(self, e: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, in both directions; a last row for no word."""
        return {d: np.concatenate([e @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """States of one direction, [steps, lanes, HIDDEN]."""
        h, u = np.zeros((x.shape[1], HIDDEN), np.float32), self.p[f"u{d}"]
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        k = HIDDEN
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(x[t][:, : 2 * k] + a[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[t][:, 2 * k :] + r * a[:, 2 * k :])
            new = n + z * (h - n)
            new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * k :]))
            h = out[t] = new
        return out

    def forward(self, projected: dict[str, np.ndarray], grid: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Log-odds of windows given as word indexes."""
        steps = grid.T
        mask = steps < len(projected["f"]) - 1
        kept = {"f": None, "b": None} if tape is None else {"f": [], "b": []}
        h = np.concatenate([self._run(projected[d].take(steps, 0), mask, d, kept[d]) for d in "fb"], 2)
        score = np.where(mask, h @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        if tape is not None:
            tape.update(kept=kept, h=h, mask=mask, weight=weight, pooled=pooled, steps=steps)
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, w: Words, e: np.ndarray, used: np.ndarray, grid: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]], float]:
        """Of the weighted log loss: of whole parameters, of some rows of the embeddings, and the loss itself; used: the words of grid, whose embeddings e has."""
        tape: dict = {}
        logit = self.forward(self.project(e), grid, tape)
        p = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())
        dlogit = (weight * (p - label) / weight.sum()).astype(np.float32)
        g = {"bias": dlogit.sum(keepdims=True), "out": dlogit @ tape["pooled"]}
        dpool = dlogit[:, None] * self.p["out"]
        a, h, k = tape["weight"], tape["h"], HIDDEN
        dh = a[:, :, None] * dpool
        da = np.einsum("bh,tbh->tb", dpool, h)
        ds = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tb,tbh->h", ds, h)
        dh += ds[:, :, None] * self.p["v"]
        de = np.zeros_like(e)
        for side, d in enumerate("fb"):
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            every = np.empty((*grid.T.shape, 3 * k), np.float32)
            back = np.zeros((grid.shape[0], k), np.float32)
            for t, before, z, r, n, an in reversed(tape["kept"][d]):
                total = dh[t][:, side * k : side * k + k] + back
                on = tape["mask"][t][:, None]
                inner = np.where(on, total, 0)
                dn = inner * (1 - z) * (1 - n * n)
                dz = inner * (before - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                every[t, :, :k], every[t, :, k : 2 * k], every[t, :, 2 * k :] = dz, dr, dn
                da_ = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ da_
                back = np.where(on, inner * z, total) + da_ @ u.T
            row, dx = _row_sums(tape["steps"].ravel(), every.reshape(-1, 3 * k))
            row, dx = row[row < len(e)], dx[row < len(e)]
            g[f"u{d}"], g[f"c{d}"] = du, dx.sum(0)
            g[f"x{d}"] = e[row].T @ dx
            de[row] += dx @ self.p[f"x{d}"].T
        each = de[:, WIDTH:] / w.n_grams[used][:, None].astype(np.float32)
        rows = {"word": _row_sums(w.word[used], de[:, :WIDTH]), "gram": _row_sums(w.grams[spans(w.gram_start[used], w.n_grams[used])], np.repeat(each, w.n_grams[used], 0))}
        return g, rows, loss

    def part(self, w: Words, used: np.ndarray) -> np.ndarray:
        """Embeddings of some words."""
        n = w.n_grams[used]
        grams = np.add.reduceat(self.p["gram"].take(w.grams[spans(w.gram_start[used], n)], 0), np.cumsum(n) - n, 0) / n[:, None].astype(np.float32)
        return np.concatenate([self.p["word"].take(w.word[used], 0), grams], 1)

    def score_windows(self, w: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        projected = self.project(self.embed(w))
        out = np.empty(len(first), np.float32)
        order = np.argsort(-size, kind="stable")  # windows of like length together
        for at in range(0, len(order), _LANES):
            lanes = order[at : at + _LANES]
            out[lanes] = self.forward(projected, w.grid(first[lanes], size[lanes]))
        return out

    def score_texts(self, data: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
        w = Words(data, offsets)
        text, first, size = w.windows()
        out = np.full(len(offsets) - 1, empty)
        if len(text):
            logit = self.score_windows(w, first, size).astype(np.float64)
            heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            out[text[heads]] = 1 / (1 + np.exp(-np.maximum.reduceat(logit, heads)))
        return out


def _telling(w: Words, label: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each word how much more often its texts are toxic, by itself and by its grams (log-odds of document shares).

    Also which rows of the embeddings are seen in SEEN texts or more: others tell nothing and stay zero.
    """
    counts = np.zeros((2, 2, TABLE), np.int64)  # words and grams, clean and toxic
    ends = np.cumsum(w.count)
    for a in range(0, len(w.count), 64):
        b = min(len(w.count), a + 64)
        n = w.count[a:b]
        text = np.repeat(np.arange(a, b), n)
        pair = np.unique(text * np.int64(len(w.word)) + w.index[ends[a] - w.count[a] : ends[b - 1]])
        text, word = pair // len(w.word), pair % len(w.word)
        n = w.n_grams[word]
        for k, (owner, feature) in enumerate(((text, w.word[word]), (np.repeat(text, n), w.grams[spans(w.gram_start[word], n)]))):
            seen = np.unique(owner * np.int64(TABLE) + feature)
            for y in (0, 1):
                counts[k, y] += np.bincount((seen % TABLE)[label[seen // TABLE] == y], minlength=TABLE)
    clean, toxic = counts[:, 0], counts[:, 1]
    odds = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((clean + 0.5) / (len(label) - label.sum() + 1))
    known_words, known_grams = clean + toxic >= SEEN
    telling = np.where(known_words[w.word], odds[0][w.word], 0) + np.maximum.reduceat(np.where(known_grams, odds[1], 0)[w.grams], w.gram_start)
    return telling, {"word": known_words, "gram": known_grams}


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """A network from texts and their labels."""
    rng = np.random.default_rng(SEED)
    net = Network()
    has = [i for i, t in enumerate(texts) if t.translate(FOLD).split()]
    labels = np.asarray(labels)[has]
    if not len(has) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["bias"][:] = -3 if not len(has) or labels.max() == 0 else 3
        return net
    texts = [texts[i] for i in has]
    w = Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    text, first, size = w.windows()
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    many = np.diff(np.append(heads, len(text)))
    telling, known = _telling(w, labels)
    peak = np.maximum.reduceat(telling[w.index[spans(first, size)]], np.cumsum(size) - size)
    balance = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn, epochs in enumerate(EPOCHS):
        if turn:
            peak = net.score_windows(w, first, size)
        order = np.lexsort((peak, text))
        chosen = order[heads + many - 1]
        other = order[heads + (rng.random(len(heads)) * many).astype(np.int64)]
        clean = labels == 0
        lanes = np.concatenate([chosen, other[clean]])
        y, weight = np.concatenate([labels, labels[clean]]).astype(np.float32), np.concatenate([balance, balance[clean]]).astype(np.float32)
        for _ in range(epochs):
            shuffled = rng.permutation(len(lanes))
            for at in range(0, len(lanes), BATCH):
                b = shuffled[at : at + BATCH]
                grid = w.grid(first[lanes[b]], size[lanes[b]])
                used, local = np.unique(grid, return_inverse=True)
                padded = used[-1] == len(w.word)
                used = used[:-1] if padded else used
                g, rows, _ = net.gradients(w, net.part(w, used), used, local.reshape(grid.shape), y[b], weight[b])
                rows = {k: (r[known[k][r]], x[known[k][r]]) for k, (r, x) in rows.items()}
                norm = np.sqrt(sum(float((x * x).sum()) for x in [*g.values(), *(x for _, x in rows.values())]))
                shrink = np.float32(min(1.0, 2.0 / (norm + 1e-9)))
                step += 1
                for k, (r, x) in ({k: (slice(None), x) for k, x in g.items()} | rows).items():
                    m, v = (a[r] for a in moment[k])
                    m, v = m + np.float32(0.1) * (x * shrink - m), v + np.float32(0.01) * ((x * shrink) ** 2 - v)
                    moment[k][0][r], moment[k][1][r] = m, v
                    net.p[k][r] -= np.float32(RATE) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return net


def sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(toxic, h, text): the bounded training sample, labelled documents outside fold 0 by a hash of their id."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("l").cast("string").cast("binary")) % folds != 0)
    order = F.xxhash64("l")
    some = [thinned(known.where(F.col("toxic") == y), order, 2 * n).orderBy(order).limit(2 * n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    picked = some[0].union(some[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l")).select(F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"), "text")
    clean, toxic = (rows.where(F.col("toxic") == y).orderBy("h", "text").limit(n) for y, n in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)))
    return toxic.union(clean)


def packed(parameters: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **parameters)
    return out.getvalue()


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> tuple[dict[str, np.ndarray], float]:
    """Parameters, and the score of a text without words.  One task on an executor sees the sample; the driver gets the parameters only."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        held = [r for b in batches for r in zip(b.column("toxic").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True)]
        held.sort(key=lambda r: (-r[0], r[1], r[2]))
        y = np.array([r[0] for r in held], np.int64)
        blob = packed(fit([r[2] for r in held], y).p)
        held.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([float(y.mean()) if len(y) else 0.0]), pa.array([blob], pa.binary())], names=["share", "parameters"])

    row = sample(docs, labels, folds).coalesce(1).mapInArrow(learn, "share double, parameters binary").first()
    trim_driver(docs.sparkSession)
    if row is None:  # a table without partitions
        return fit([], np.zeros(0, np.int64)).p, 0.0
    return unpacked(row.parameters), min(0.49, row.share)


def _groups(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, end
        at = end


def _scores(column, model) -> np.ndarray:
    parameters, empty = model
    net = Network(parameters)
    data, offsets = texts_of(column)
    parts = [net.score_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], empty) for a, b in _groups(offsets)]
    return np.concatenate([np.zeros(0), *parts])


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for b in batches:
            s = _scores(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        give_back()

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 0).alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """The documents that the network does not call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for b in batches:
            text = b.column("text").cast(pa.binary()).fill_null(b"")
            yield b.filter(pa.array(_scores(text, shared.value) < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)
