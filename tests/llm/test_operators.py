"""Each operator against brute force or SQL, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import gc
import hashlib
import math
import os
import re
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import spark_rows, sql_rows, tables  # noqa: E402

from glyphworks.llm import _shared, chat, decontaminate, jaccard, licenses, lm, mixing, queries, rans, repeats, tokens, topk, toxicity  # noqa: E402
from glyphworks.llm._pieces import kept_in_worker  # noqa: E402
from glyphworks.llm._shared import written  # noqa: E402
from glyphworks.llm._shingles import token_hashes  # noqa: E402
from glyphworks.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece int, key string, size long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of words that nobody reads twice in a row"


def rows():
    near = BASE.split()
    texts = [
        BASE, BASE, " ".join([*near[:-1], "column"]), None, "", "short", "one two", "x" * 60, "y" + "x" * 55, "Ünïcode " * 30, BASE + " " + "tail " * 40, "a" * 5000 + " " + BASE, "loser " * 3, "\n\t ", "A  b\n\nc",
        "\x00\x01 zero", "é" * 49, "é" * 50,
    ]
    out = [(i, t, "en", f"src{i % 3}" if i % 5 else None, 1, i, "k", 9) for i, t in enumerate(texts)]
    return [*out, (0, BASE, "en", "src0", 1, 0, "k", 9), (None, BASE, None, None, None, None, None, None), (7, "x" * 60, "en", "src1", 1, 7, "k", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(tables(sf_dir), queries.SQL[name])


# --- 1


def removed(data):
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    first: dict[bytes, float] = {}
    for i, t in order:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], math.inf if i is None else i)
    out = []
    for i, t in order:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < (math.inf if i is None else i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, empty):
    got = repeats.remove_repeats(docs).collect()
    expected = removed([(r[0], (r[1] or "").encode()) for r in rows()])
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == expected
    for r in got:
        assert sum(e - s for s, e in zip(r.span_starts, r.span_ends, strict=True)) == r.n_removed == r.n_bytes - len(r.kept)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_on_tables(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = repeats.remove_repeats(d, texts=False).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == removed([(r.doc_id, (r.text or "").encode()) for r in d.collect()])


def test_repeat_groups(spark, docs, empty):
    """Each group is whole: the same bytes at all places where they stand, of two documents or more."""
    data = [(i, (t or "").encode()) for i, t, *_ in rows()]
    found: dict[str, set] = {}
    size = {}
    for r in repeats.repeat_groups(docs).collect():
        size[r.group] = r.n_bytes
        found.setdefault(r.group, set()).add((r.doc_id, r.start))
    assert len(found) > 3
    for g, places in found.items():
        strings = {t[s : s + size[g]] for i, s in places for j, t in data if i == j and len(t) >= s + size[g]}
        own = next(x for x in strings if places == {(i, s) for i, t in data for s in range(len(t) - len(x) + 1) if t[s : s + len(x)] == x})
        assert len(own) == size[g] >= 50 and sum(own in t for _, t in data) > 1
    assert repeats.repeat_groups(empty).count() == 0
    # a long passage is one group, and so is what three documents share of it at most
    rng = np.random.default_rng(11)
    noise = ["".join(rng.choice(list("abcdefgh"), 400)) for _ in range(8)]
    passage = "".join(rng.choice(list("ijklmnop"), 700))
    texts = [noise[0] + passage + noise[1], noise[2] + passage + noise[3], noise[4] + passage[600:] + noise[5], noise[6] + passage + noise[7] + passage]
    got = {(r.n_bytes, r.doc_id, r.start) for r in repeats.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    whole = {(700, 0, 400), (700, 1, 400), (700, 3, 400), (700, 3, 1500)}
    end = {(100, 0, 1000), (100, 1, 1000), (100, 2, 400), (100, 3, 1000), (100, 3, 2100)}
    assert end <= got and {x[1:] for x in whole} <= {x[1:] for x in got} and max(n for n, *_ in got) >= 600


def test_repeats_in_little_memory():
    """A megabyte in which everything is repeated takes at most 40 MB of arrays in each pass, and what is kept in a worker goes."""
    data = np.random.default_rng(5).integers(97, 123, 1 << 19, dtype=np.uint8).tobytes()
    texts = [data[: 1 << 18], data[: 1 << 18], data[1 << 18 :], data[1 << 18 :]]
    t = pa.table({"piece": pa.array([0] * 4, pa.int32()), "doc_id": pa.array(range(4), pa.int64()), "text": pa.array(texts, pa.binary())})
    how = {"length": 50, "kmer": 20}
    listed = repeats._list_anchors(t, buckets=1, **how)
    shared = repeats._shared_anchors(listed)
    passes = [lambda: repeats._list_anchors(t, buckets=1, **how), lambda: repeats._send_contexts(t, shared, buckets=1, **how)]
    answers = pa.concat_tables([shared, repeats._answer_contexts(passes[1](), **how)])
    for run in [*passes, lambda: repeats._remove(t, answers, buckets=1, texts=False, **how)]:
        tracemalloc.start()
        out = run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 << 20
    assert out.column("n_removed").to_pylist() == [0, 1 << 18, 0, 1 << 18]
    kept_in_worker()["of another operator"] = b"x"
    assert repeats._bound(repeats._list_anchors, buckets=1, **how)(t).equals(listed) and not kept_in_worker()


def test_intervals():
    lcp = np.array([0, 3, 3, 1, 4, 2])
    assert sorted(map(tuple, repeats.intervals(lcp, 2).tolist())) == [(2, 1, 3, 5), (3, 1, 0, 2), (4, 2, 3, 4)]


# --- 2


def test_lm(spark, sf_dir, docs, empty):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in lm.score(d).collect()}
    words = {r.doc_id: (r.text or "").encode().lower().split() + [b"\0end"] for r in d.select("doc_id", "text").collect()}
    seen = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(seen.values()), len(seen)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(seen[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score(docs).count() == len(rows()) and lm.score(empty).count() == 0


def test_lm_beats_words(spark):
    """Documents that it has not seen are likelier than by the counts of their words."""
    r = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r.model > 0.9 * r.base


def test_lm_is_whole(spark, sf_dir):
    """Scores depend neither on the cut of the table nor on extra columns; odd rows have scores too."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("piece"), F.lit("x").alias("fold"), F.lit(0).alias("key"))
    d = d.union(spark.createDataFrame([(None, None, 1, "", 1), (-1, "", 1, "", 1), (-2, "é" * 9000 + " end", 1, "", 1), (-2, "é" * 9000 + " end", 1, "", 1), (-3, " \n", 1, "", 1)], d.schema))
    one, many = ({(r.doc_id, r.n_tokens): (r.score, r.base_score) for r in lm.score(d.repartition(n)).collect()} for n in (1, 24))
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], rtol=1e-9) for k in one) and all(v[0] < 0 for v in one.values())
    untrained = lm.score(spark.createDataFrame([(i, "some text") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()
    assert len(untrained) and all(math.isfinite(r.score) and r.train_tokens == 0 for r in untrained)


def small_model():
    texts = [t.encode() for _, t, *_ in rows() if t and len(t) < 500]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    codes = lm.Codes(lm.count_pairs(data, offsets).reshape(257, 257).astype(float))
    counts = np.zeros((lm.ORDERS, 2 << 12), np.uint32)
    lm.count_bits(data, offsets, codes, counts)
    model = lm.Model(codes, np.stack([lm.log_odds(c.reshape(-1, 2)) for c in counts]))
    model.fit(data, offsets)
    return model


def test_lm_is_a_distribution():
    """After any beginning, the end and all symbols share all of the probability."""
    model = small_model()
    for head in (b"", b"the ", (BASE * 3).encode(), "é a".encode()):
        nexts = [bytes([c]) for c in range(256) if not 65 <= c <= 90]
        data = b"".join(head + c for c in nexts) + head
        cost, size = model.symbol_bits(np.frombuffer(data, np.uint8), np.cumsum([0, *([len(head) + 1] * len(nexts)), len(head)]))
        first = np.cumsum(size) - size
        assert math.isclose(sum(2.0 ** -cost[first + len(head)]), 1, rel_tol=1e-5)


def test_lm_counts_and_mixing():
    """Against a plain loop over symbols and bits."""
    model = small_model()
    codes, step = model.codes, lm._STEP
    texts = [b"", b"The quick brown", (BASE + " " + BASE + "\nloser  loser").encode(), "é".encode() * 3000, b"a " * 3000]
    got = model.bits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    slots = model.tables.shape[1]
    for text, bits in zip(texts, got, strict=True):
        symbols = [*text.lower(), lm._END]
        padded = [lm._END] * lm._PAD + symbols
        stream, at, size = lm._streams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert stream.tolist() == padded and at.tolist() == list(range(lm._PAD, len(padded))) and size.tolist() == [len(symbols)]
        contexts = lm._contexts(stream, at, size)
        # contexts are equal just where what they stand for is equal
        words = [bytes(symbols[:i]).replace(b"\n", b" ").split(b" ") for i in range(len(symbols))]
        for c, of in zip(contexts, [lambda i: tuple(padded[i : i + 5]), lambda i: (words[i][-1], padded[i + 4]), lambda i: (words[i][-1], next((w for w in words[i][-2::-1] if w), b""), padded[i + 4])], strict=True):
            assert len({(int(h), of(i)) for i, h in enumerate(c)}) == len(set(c.tolist())) == len({of(i) for i in range(len(symbols))})
        total, weights, pending = 0.0, model.weights.astype(float).copy(), np.zeros_like(model.weights, float)
        for i, sym in enumerate(symbols):
            if i % lm.BLOCK == 0:
                weights, pending = model.weights.astype(float).copy(), np.zeros_like(weights)
            elif i % lm.BLOCK % lm.CHUNK == 0:
                weights, pending = weights + pending, np.zeros_like(weights)
            prev = padded[i + lm._PAD - 1]
            begin = codes.offset[prev, sym]
            for k in range(codes.length[prev, sym]):
                node = int(codes.node_hash[begin + k])
                x = [int(model.tables[o][((int(c[i]) + node) % 2**32) // (2**32 // slots)]) for o, c in enumerate(contexts)]
                gate = 4 * min(k, lm._DEPTH - 1) + 2 * (x[0] != 0) + (x[2] != 0)
                z = max(-16, min(16, sum(weights[o, gate] * x[o] for o in range(lm.ORDERS))))
                bit, p = codes.bits[begin + k], 1 / (1 + math.exp(-z))
                total -= math.log2(p if bit else 1 - p)
                for o in range(lm.ORDERS):
                    pending[o, gate] += lm.RATE * step * step * (bit - p) * x[o]
        assert math.isclose(total, bits, rel_tol=1e-3, abs_tol=1e-2), (text[:20], total, bits)


def test_lm_learns_weights_from_all(spark):
    """The first weights suit all training texts, long ones and those of every fold too, each half by the counts of the other."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    texts = {i: b" ".join(words[int(k)] for k in rng.zipf(1.3, 2500) % 300) for i in range(24)}
    folds = {i: divmod(zlib.crc32(str(i).encode()), 10) for i in texts}
    assert min(map(len, texts.values())) > 8000
    got = lm.train(spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string").repartition(5))
    halves = [[t for i, t in texts.items() if folds[i][1] and folds[i][0] % 2 == h] for h in range(2)]
    packed = [(np.frombuffer(b"".join(ts), np.uint8), np.cumsum([0, *map(len, ts)])) for ts in halves]
    codes = lm.Codes(sum(lm.count_pairs(*p) for p in packed).reshape(257, 257).astype(float))
    counts = np.zeros((2, lm.ORDERS, 2 * got.tables.shape[1]), np.uint32)
    for p, c in zip(packed, counts, strict=True):
        lm.count_bits(*p, codes, c)
    every, *own = (lm.Model(codes, lm.log_odds(c.reshape(lm.ORDERS, -1, 2))) for c in (counts.sum(0), *counts))
    assert (got.tables == every.tables).all()
    seen = own[1].spread(*packed[0]) + own[0].spread(*packed[1])
    assert seen.sum() * lm.ORDERS == counts.sum()
    # a plain count of the levels of one half
    levels = Counter()
    for a, b in lm._groups(packed[0][1], 1 << 18):
        x, y, gate, _, _ = own[1]._features(*lm._streams(packed[0][0][packed[0][1][a] : packed[0][1][b]], packed[0][1][a : b + 1] - packed[0][1][a]))
        levels.update(zip(*(np.rint(o / lm.LEVEL).astype(int).tolist() for o in x), gate.tolist(), y.tolist(), strict=True))
    first = own[1].spread(*packed[0]).reshape(*[lm._LEVELS] * lm.ORDERS, lm._GATES, 2)
    assert first.sum() == sum(levels.values()) and all(first[*(v + lm._LEVELS // 2 for v in k[: lm.ORDERS]), *k[lm.ORDERS :]] == n for k, n in levels.items())
    unfitted = every.weights.copy()
    every.fit_spread(seen)
    assert np.allclose(got.weights, every.weights, rtol=1e-6) and not np.allclose(got.weights, unfitted)


def test_lm_spells_symbols_once(monkeypatch):
    rng = np.random.default_rng(1)
    data, offsets = rng.integers(97, 123, 5000).astype(np.uint8), np.array([0, 2000, 2000, 5000])
    codes, seen, spelled = lm.Codes(np.ones((257, 257))), [], lm._spelled
    monkeypatch.setattr(lm, "_spelled", lambda prev, sym, codes: seen.append(len(sym)) or spelled(prev, sym, codes))
    counts = np.zeros((lm.ORDERS, 2 << 12), np.uint32)
    lm.count_bits(data, offsets, codes, counts)
    stream, at, _ = lm._streams(data, offsets)
    prev, sym = stream[at - 1], stream[at]
    owner, where, n = spelled(prev, sym, codes)
    assert sum(seen) == 5003 and (counts.sum(1) == n.sum()).all()
    assert owner.tolist() == np.repeat(np.arange(5003), n).tolist()
    assert where.tolist() == [codes.offset[p, s] + k for p, s, m in zip(prev.tolist(), sym.tolist(), n.tolist(), strict=True) for k in range(m)]


def test_lm_works_in_parts(monkeypatch):
    """Bits of a bounded number of symbols are held at a time, and results do not depend on that number."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9), dtype=np.uint8)) for _ in range(500)]
    texts = [b" ".join(words[int(k)] for k in rng.zipf(1.4, n) % 500) for n in (60000, 0, 700, 1)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    codes, seen, spelled = lm.Codes(lm.count_pairs(data, offsets).reshape(257, 257).astype(float)), [], lm._spelled
    monkeypatch.setattr(lm, "_spelled", lambda prev, sym, codes: seen.append(len(sym)) or spelled(prev, sym, codes))

    def run():
        counts = np.zeros((lm.ORDERS, 2 << 18), np.uint32)
        lm.count_bits(data, offsets, codes, counts)
        model = lm.Model(codes, np.stack([lm.log_odds(c.reshape(-1, 2)) for c in counts]))
        return counts, model.spread(data, offsets), model.bits(data, offsets)

    whole = run()
    assert sum(seen) == 3 * (len(data) + 4) and max(seen) <= 1 << 15 and len(data) > 3 << 15
    monkeypatch.setattr(lm, "PART", 1000)
    monkeypatch.setattr(lm, "GROUP", 1000)
    monkeypatch.setattr(lm, "_SAFE", 5000)
    small = run()
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all() and np.allclose(whole[2], small[2], rtol=1e-12)


def test_lm_nodes_side_by_side():
    """A context's nodes have neighbouring slots, each its own, in the order of their weights."""
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 1000, (257, 257)).astype(float)
    codes, shift = lm.Codes(pairs), lm._shift(lm.slot_count(int(pairs.sum())))
    for prev in (32, 97, 256):
        own = np.concatenate([np.arange(codes.length[prev, s]) + codes.offset[prev, s] for s in lm._ALPHABET])
        slot = {}
        for node, place in zip(codes.nodes[own].tolist(), (codes.node_hash[own] >> shift).tolist(), strict=True):
            assert slot.setdefault(node, place) == place
        assert sorted(slot.values()) == list(range(len(lm._ALPHABET) - 1))
        assert set(codes.node_hash[codes.offset[prev, lm._ALPHABET]].tolist()) == {0}


def test_lm_counts():
    data = b"abab a"
    codes = lm.Codes(np.ones((257, 257)))
    counts = np.zeros((lm.ORDERS, 2 << 20), np.uint32)
    lm.count_bits(np.frombuffer(data * 300, np.uint8), np.arange(301) * len(data), codes, counts)
    spelled = sum(int(codes.length[a, b]) for a, b in zip([256, *data], [*data, 256], strict=True))
    assert (counts.sum(1) == 300 * spelled).all() and counts.max() % 300 == 0
    for c in (counts[0], counts[0] * 0, counts[0] * 1000):
        back = np.zeros(len(c), np.int64)
        lm._add_sparse(lm._sparse(c), back)
        assert (back == c).all()


# --- 3


ITEMS = [
    ("1", "The QUICK brown-fox jumps over the lazy dog while seven"), ("1", "The QUICK brown-fox jumps over the lazy dog while seven"), ("x-2", "one, two!"), ("3", None), ("4", "..."), (None, "short"), ("5", "short cut"),
    ("10", "seven wizards brew a potion of words that nobody reads twice"),
]


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    flat = decontaminate.flag(docs, items)
    assert {(r.doc_id, r.n_hit, *r["items"]) for r in flat.where("n_hit > 0").collect()} == {(i, 21, "1", "10") for i in (0, 1, 2, 10, 11, None)} | {(6, 2, "x-2")}
    for size in (1, 60, 200):  # a window each, or a few
        sharded = decontaminate.flag(docs, items, automaton_bytes=size)
        assert sorted(map(str, flat.collect())) == sorted(map(str, sharded.collect()))
    r = flat.where("doc_id = 6").first()
    assert (r.span_starts, r.span_ends, r["items"]) == ([0], [7], ["x-2"])
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - flat.where("n_hit > 0").count()
    assert sorted(map(str, clean.collect())) == sorted(map(str, decontaminate.keep_clean(docs, items, automaton_bytes=300).collect()))
    assert decontaminate.flag(empty, items).count() == 0 and decontaminate.keep_clean(empty, items).count() == 0
    for none in (items.limit(0), items.where("text is null")):
        assert decontaminate.flag(docs, none).where("n_hit > 0").count() == 0 and decontaminate.keep_clean(docs, none).count() == docs.count()
    # an item id of another type; rows are judged one by one, whatever their ids
    twice = spark.createDataFrame([(1, "one two"), (1, "other words"), (None, "one two"), (None, "short")], "doc_id long, text string")
    assert sorted(map(tuple, decontaminate.keep_clean(twice, spark.createDataFrame([(2, "one, two!")], "item_id long, text string")).collect()), key=str) == [(1, "other words"), (None, "short")]


def test_decontaminate_long_text(spark):
    long = "word " * 200_000 + "one two " + "word " * 10
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = decontaminate.flag(df, spark.createDataFrame(ITEMS, "item_id string, text string")).first()
    assert (r.n_words, r.n_hit, r.span_starts, r.span_ends) == (200_012, 2, [1_000_000], [1_000_007])


# --- 4


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    vectors += [(500, None), (501, [1.0, None]), (502, [math.nan] * 8), (503, [math.inf] * 8), (504, []), (505, [1.0]), (None, [1.0] * 8), (100, vectors[100][1]), *[(600 + i, vectors[0][1]) for i in range(20)]]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q in (0, 100, 200, 600):
        v = next(x for i, x in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q)[:10]  # noqa: B905
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert set(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0 and topk.top_k(df, F.col("vec_id") < 0).count() == 0
    # longer than 63 bits: an error, not another result
    for huge in ([1e17, 1.0], [1e12, 1e12]):
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark.createDataFrame([(0, huge), (1, huge)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    wide = spark.createDataFrame([(0, [1e6, 1e6]), (1, [2e6, 1.0]), (2, [-2e6, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(wide, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1024**2 * (2 * 10**12 + 10**6)), (2, -(1024**2) * 2 * 10**12)]


def test_topk_prunes_pairs(spark):
    """Lengths differ much, so most levels never meet; results stay those of all pairs."""
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=6) * 2.0 ** rng.integers(-6, 6)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = np.floor(np.array([v for _, v in data]) * 1024).astype(np.int64)
    expected = {}
    for q in range(0, 1500, 50):
        scores = whole @ whole[q]
        expected[q] = [(int(scores[i]), i) for i in sorted(set(range(1500)) - {q}, key=lambda i: (-scores[i], i))[:10]]
    got: dict = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=20, part=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == expected


# --- 5


def mixed_by_force(data, weights=(5, 2, 1), epochs=3):
    """(finish time, key, copy, doc_id) of the taken copies, in order; data: (doc_id, source, size), ids and sources differ."""
    names = sorted({s for _, s, _ in data}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in data if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, float(sum(size.values()))
    while len(target) < len(names):
        level = (total - sum(target.values())) / sum(w for s, w in weight.items() if s not in target)
        full = [s for s in names if s not in target and level * weight[s] > epochs * size[s]]
        target |= {s: float(epochs * size[s]) for s in full} or {s: level * weight[s] for s in names if s not in target}
    copies = []
    for s in names:
        done = 0
        for key, i, n in sorted((hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest(), i, n) for i, x, n in data if x == s):
            done += n
            copies += [((e * size[s] + done) / target[s], key, e, i, n) for e in range(epochs)] if target[s] else []
    out, used = [], 0
    for c in sorted(copies):
        used += c[4]
        if used > total:
            break
        out.append(c)
    return out


def test_mixing(spark, docs, empty, monkeypatch):
    q = mixing.queue(docs).collect()
    assert len(q) == len(rows()) and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in q)
    assert sorted(q, key=str) == sorted(mixing.queue(docs.repartition(3)).collect(), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in q)
    assert mixing.queue(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 0
    data = [(i, None if i % 3 == 0 else f"s{i % 4}", i % 7 * (i % 50 == 0) + i % 5) for i in range(3000)]
    big = spark.createDataFrame([(i, "w " * n, s) for i, s, n in data], "doc_id long, text string, source string")
    expected = mixed_by_force(data)
    for few in (10_000, 100, 1):
        monkeypatch.setattr(mixing, "FEW", few)
        monkeypatch.setattr(mixing, "BINS", 4096 if few > 1 else 3)
        # in the order of finish times, over all partitions
        assert [r.doc_id for r in mixing.mix(big).collect()] == [c[3] for c in expected]
    sums = mixing.queue(big).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 30 for r in sums)
    # one id for all rows: all copies of a source finish at once
    same = big.select(F.lit(7).cast("long").alias("doc_id"), "text", F.lit("one").alias("source"))
    monkeypatch.setattr(mixing, "FEW", 1)
    assert {r.copies for r in mixing.queue(same).collect()} == {1}


def test_clashing_columns(spark):
    """Columns by the names that operators give to their own."""
    names = ["mix_id", "mix_source", "copies", "copy", "lost", "lost_", "row", "key", "h", "bin", "level", "part", "block"]
    d = spark.createDataFrame([(i, BASE + f" x{i // 2}", "s", *range(len(names))) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for out in (jaccard.one_of_each(d), mixing.mix(d), decontaminate.keep_clean(d, spark.createDataFrame([(1, "none of it")], "item_id int, text string")), toxicity.keep_clean(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))):
        assert out.columns == d.columns and out.count() > 0
    assert mixing.queue(d).count() == licenses.scan(d).count() == lm.score(d).count() == tokens.token_index(d).count() == repeats.remove_repeats(d).count() == jaccard.join_components(d).count() == 6


# --- 6


def components_by_force(data, percent=80):
    sets = []
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("how", [{}, {"lead": 0}, {"lead": 0, "frequent": 2}, {"lead": 0, "frequent": 0}])
def test_jaccard(spark, docs, how):
    rng = np.random.default_rng(3)
    template = [f"w{i}" for i in range(60)]
    data = [(r[0], r[1]) for r in rows()]
    for i in range(60):
        words = list(template[: 40 + i % 20])
        for k in rng.choice(len(words), i % 5, replace=False):
            words[k] = f"z{rng.integers(5)}"
        data.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join_components(df, **how).collect()), key=str) == components_by_force(data)


def test_prefix_keys():
    """Sets that link share a key whose bound allows their overlap, whatever the classes; keys grow with the set, not with its square."""
    rng = np.random.default_rng(8)
    seen = 0
    for trial in range(6000):
        percent, k = int(rng.choice([80, 80, 80, 90, 60])), int(rng.choice([2, 3]))
        n = int(rng.integers(1, 60 if trial % 2 else 12))
        universe = np.sort(rng.choice(1 << 40, 2 * n + 4, replace=False)).astype(np.uint64)
        klass = rng.choice([0, 1, 2], len(universe), p=[0.0, 0.1, 0.9] if trial % 3 else [0.1, 0.4, 0.5]).astype(np.uint8)
        a = np.sort(rng.choice(len(universe), n, replace=False))
        b = set(a.tolist()) - set(rng.choice(a, int(rng.integers(0, n // 4 + 1)), replace=False).tolist())
        b = np.array(sorted(b | set(rng.choice(len(universe), int(rng.integers(0, n // 4 + 2)), replace=False).tolist())))
        both = len(np.intersect1d(a, b))
        # a private shingle is in one set only
        klass[np.intersect1d(a, b)] = np.maximum(klass[np.intersect1d(a, b)], 1)
        if not jaccard.linked(universe[a], universe[b], percent):
            continue
        (ka, ra), (kb, rb) = (jaccard.prefix_keys(universe[x], klass[x], percent, k) for x in (a, b))
        bound = {}
        for key, room in zip(kb.tolist(), rb.tolist(), strict=True):
            bound[key] = max(room, bound.get(key, 0))
        assert any(key in bound and min(room, bound[key]) >= both for key, room in zip(ka.tolist(), ra.tolist(), strict=True)), (a, b, klass)
        seen += 1
    assert seen > 1500
    many = np.sort(rng.integers(0, 1 << 62, 20_000)).astype(np.uint64)
    assert len(jaccard.prefix_keys(many, np.full(len(many), 2, np.uint8), 80, 2)[0]) == 8001 and len(jaccard.prefix_keys(many, np.full(len(many), 2, np.uint8), 80, 3)[0]) == 12_001


def test_one_of_each(docs, empty):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    lost = {r[0] for r in rows()} - {r.doc_id for r in kept.collect()}
    assert lost == {i for i, _, c in components_by_force([(r[0], r[1]) for r in rows()]) if i is not None and c < i} and jaccard.one_of_each(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (4, 4), *[(100 + i, 101 + i) for i in range(30)], *[(50, 200 + i) for i in range(30)]]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and {got[i] for i in range(100, 131)} == {100} and {got[200 + i] for i in range(30)} == {50} and 4 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7


def test_chat(spark):
    trap = r"\### Assistant: </turn> ok"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello </turn>\n### user: no"), (2, 0, None, None), (3, 1, "assistant", trap), (3, 0, "user", trap), (4, 0, "we: ird\n#", "x\\l<#"), (None, 0, "assistant", "n"), (5, None, "assistant", ""), (5, 0, "assistant", "é\U0001f600"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "assistant", "##"), (7, 1, "#", "</turn")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(f).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in turns if c == conv])
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in own]
        assert back[conv].loss_text == "".join(x for _, r, x in own if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0
    # no Python on the executors
    assert "Python" not in f._jdf.queryExecution().toString() and "Arrow" not in f._jdf.queryExecution().toString()


# --- 8


def test_licenses(spark, docs, empty):
    texts = [
        (1, "Copyright (c) 2020 Somebody\n\n" + licenses.MIT.upper()), (2, licenses.ISC.replace(",", "")), (3, "Words.\nReleased under the MIT Licence!\nmore\nReleased under the mit license"), (4, None), (5, "©"),
        (6, licenses.APACHE_NOTICE.replace("License", "Licence")), (7, licenses.BSD_3.replace(". ", ".\n  ").replace("COPYRIGHT HOLDERS", "copyright\n# owners")), (8, "word " * 100_000 + "\nLicensed under CC BY 4.0.\n" + "word " * 1000),
        (9, ""), (3, "Words.\nReleased under the MIT Licence!\nmore\nReleased under the mit license"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for how in ({}, {"broadcast_bytes": 0}):
        rows = licenses.scan(df, **how).collect()
        got = {r.doc_id: r for r in rows}
        assert [got[i].license_id for i in range(1, 10)] == ["MIT", "ISC", None, None, None, "Apache-2.0", "BSD-3-Clause", None, None]
        assert [r.line_licenses for r in rows if r.doc_id == 3] == [["MIT", "MIT"]] * 2 and got[8].line_licenses == ["CC-BY-4.0"] and len(rows) == len(texts)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_many_known_licenses(spark):
    """No statement is too long, too unlike the others or one too many."""
    known = [(f"L-{i}", f"Terms number {i} apply " + "and so on " * (i % 60)) for i in range(1500)] + [(None, "no id"), ("L-x", None), ("L-y", "...")]
    docs = spark.createDataFrame([(i, f"Intro\n{t}\nend") for i, (_, t) in enumerate(known[:1500])], "doc_id long, text string")
    for how in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r.line_licenses for r in licenses.scan(docs, spark.createDataFrame(known, "license_id string, text string"), **how).collect()}
        assert got == {i: [f"L-{i}"] for i in range(1500)}


def test_license_digests(spark):
    """The listed digests are those of the texts, where they are at hand."""
    folder = "/usr/share/common-licenses"
    if not os.path.exists(f"{folder}/GPL-3"):
        pytest.skip("no licence texts here")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    texts = [(i, "Copyright 2001 Somebody\n" + open(f"{folder}/{n}").read()) for i, n in enumerate(names)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values())


# --- 9


def test_rans():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 65, 5000, 200_000):
        x = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        table = rans.Table(rans.frequencies(np.bincount(x, minlength=50_257) if n else np.ones(5, np.int64)))
        block = rans.encode(x, table)
        assert (rans.decode(block, table) == x).all()
    assert (np.concatenate([rans.decode(block, table, 0, 1), rans.decode(block, table, 1)]) == x).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path(None))
    expected, start = [], 0
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows()]
    got = tokens.read_blocks(spark, tokens.write_blocks(docs, tokens.new_path(spark, "t"), block_tokens=50), ids=True).orderBy("start").collect()
    assert sorted([(r.doc_id, list(r.ids)) for r in got], key=str) == sorted(ids, key=str)
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
        expected.append(math.inf if r.doc_id is None else r.doc_id)
    assert expected == sorted(expected) and tokens.token_index(empty).count() == 0


def test_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", "  ", " a", "a ", "can't  stop\n\n x", "<|endoftext|>", "<|endoftext|> hi a<|endoftext|>", "<|endoftext |> x", "日本 語 \U0001f600 a", "x\x1c y", "tab\t word", "é è.. a,b. ..", "End.\nNext, line\n\ntwo", "a\nb", "a \nb", "nb\xa0sp \xa0 x", BASE * 3, "A" * 40_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        e = tokens.Encoder(path, memory=20)
        library = Tokenizer.from_file(path)
        assert [list(np.frombuffer(g, e.kind)) for g in e.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert e.quick == (name == "byte_bpe_50k.json")
    assert list(np.frombuffer(tokens.Encoder(tokens.tokenizer_path(None)).encode(["<|endoftext|>"])[0], "<u2")) == [50256]


# --- 10


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    plain, rude = ["river", "stone", "cloud", "paper", "green", "seven", "table", "music"], ["vilewort", "vileness", "vileling"]
    texts, labels = [], []
    for i in range(400):
        w = rng.choice(plain, int(rng.integers(5, 150))).tolist()
        if i % 4 == 0:
            w[int(rng.integers(len(w)))] = str(rng.choice(rude))
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    r = toxicity.score(d, y).collect()
    held = [(x.predicted, x.doc_id % 4 == 0) for x in r if x.held_out]
    assert len(r) == 400 and sum(p == t for p, t in held) >= 0.95 * len(held)
    odd = toxicity.score(docs, y).collect()
    assert len(odd) == len(rows()) and all(0 <= x.score <= 1 for x in odd) and {x.predicted for x in odd if x.doc_id in (3, 4, 13)} == {0}
    assert toxicity.keep_clean(docs, y).columns == docs.columns and toxicity.score(empty, y.limit(0)).count() == 0


def plain_odds(p, words):
    """Log-odds of a window, word by word and number by number, as the network is written down."""
    def sig(x):
        return 1 / (1 + math.exp(-x))

    h, u64 = toxicity.HIDDEN, (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & u64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & u64
        return x ^ (x >> 31)

    k3, k4 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), 0x27D4EB2F165667C5
    inputs = []
    for word in words:
        hashes, _ = token_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        marked = [1, *word, 2]
        grams = []
        for j in range(len(marked) - 2):
            three = sum(c * k for c, k in zip(marked[j : j + 3], k3, strict=True))
            grams.append(mixed(three & u64))
            if j + 3 < len(marked):
                grams.append(mixed((three + marked[j + 3] * k4) & u64))
        rows_of = [p["gram"][g % toxicity.TABLE] for g in grams]
        inputs.append([*p["word"][int(hashes[0]) % toxicity.TABLE].tolist(), *(sum(float(r[i]) for r in rows_of) / len(rows_of) for i in range(toxicity.WIDTH))])
    states = {}
    for d, sequence in (("f", inputs), ("b", inputs[::-1])):
        state, out = [0.0] * h, []
        for x in sequence:
            a = [sum(x[i] * float(p[f"x{d}"][i, j]) for i in range(len(x))) + float(p[f"c{d}"][j]) for j in range(3 * h)]
            b = [sum(state[i] * float(p[f"u{d}"][i, j]) for i in range(h)) for j in range(3 * h)]
            z, r = ([sig(a[j] + b[j]) for j in range(g * h, g * h + h)] for g in (0, 1))
            n = [math.tanh(a[2 * h + j] + r[j] * b[2 * h + j]) for j in range(h)]
            state = [n[j] + z[j] * (state[j] - n[j]) for j in range(h)]
            out.append(state)
        states[d] = out if d == "f" else out[::-1]
    both = [f + b for f, b in zip(states["f"], states["b"], strict=True)]
    weight = [math.exp(sum(s * float(v) for s, v in zip(x, p["v"], strict=True))) for x in both]
    pooled = [sum(w * x[j] for w, x in zip(weight, both, strict=True)) / sum(weight) for j in range(2 * h)]
    return sum(s * float(o) for s, o in zip(pooled, p["out"], strict=True)) + float(p["bias"][0])


def test_network_by_hand():
    """Scores of texts against the plain network, over all windows."""
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    net.p = {k: (v + rng.normal(size=v.shape) * 0.3).astype(np.float32) for k, v in net.p.items()}
    texts = ["river stone", "a", "", "one two three " * 30, " ".join(f"w{i}" for i in range(64)), " ".join(f"v{i}" for i in range(97))]
    data = "".join(texts).encode()
    got = net.score_texts(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), 0.25)
    for text, score in zip(texts, got, strict=True):
        words = text.encode().split()
        windows = [words[s : s + 64] for s in range(0, max(1, len(words) - 32), 32)] if words else []
        assert len(windows) == (max(0, -(-(len(words) - 64) // 32)) + 1 if words else 0)
        expected = max((1 / (1 + math.exp(-plain_odds(net.p, w))) for w in windows), default=0.25)
        assert math.isclose(score, expected, rel_tol=1e-3), text[:20]


def test_gradients():
    """Against finite differences."""
    data = b"aa bb cc dd ee ff gg"
    w = toxicity.Words(np.frombuffer(data, np.uint8), np.array([0, 11, len(data)]))
    net = toxicity.Network()
    rng = np.random.default_rng(0)
    net.p = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}
    _, first, size = w.windows()
    grid, y, weight = w.grid(first, size), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    used, local = np.unique(grid, return_inverse=True)
    used = used[used < len(w.word)]
    loss = lambda: net.gradients(w, net.part(w, used), used, local.reshape(grid.shape), y, weight)
    g, rows, _ = loss()
    for k, x in [(k, x) for k, x in g.items()] + [(k, x) for k, (_, x) in rows.items()]:
        r = rows[k][0] if k in rows else None
        at = tuple(int(rng.integers(n)) for n in x.shape)
        real = (int(r[at[0]]), *at[1:]) if r is not None else at
        old = net.p[k][real]
        net.p[k][real] = old + 1e-3
        up = loss()[2]
        net.p[k][real] = old - 1e-3
        down = loss()[2]
        net.p[k][real] = old
        assert math.isclose((up - down) / 2e-3, float(x[at]), rel_tol=0.05, abs_tol=1e-4), k


# --- pipeline


def test_freed_memory_of_the_driver(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) >> 10
    table = spark.range(10)
    written(table, "ten")
    # blocks outside the heap, of which every 20th stays, so that the C library keeps the rest when they are freed
    some = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(4000)]
    full, some = held(), some[::20]
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    monkeypatch.setitem(_shared._trimmed, "at", -_shared.TRIM_S)
    written(table, "ten")
    assert full - held() > 150 and len(some) == 200


def test_pipeline_on_odd_tables(spark, docs, empty, tmp_path):
    """Each stage takes what the one before may give: nulls, empty and long texts, ties, repeats, clashing columns, and nothing at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 0, 1), (None, 1, 1), (2, None, None), (5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/a/labels.parquet")
    spark.createDataFrame([("7", BASE), (None, "x"), ("8", None)], "item_id string, text string").write.parquet(f"file://{tmp_path}/a/benchmark.parquet")
    for name, kinds in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"file://{tmp_path}/b/{name}.parquet")
    long = spark.createDataFrame([(900, "long " * 150_000, None, "src0", 1, 1, "k", 9)], DOCS)
    for sf_dir in (f"file://{tmp_path}/a", f"file://{tmp_path}/b"):
        for table in (docs.union(long), empty):
            for name, stage in pipeline.STAGES:
                out = stage(spark, table, sf_dir)
                n = out.count()
                assert n == 0 if table is empty else n > 0, name
                if name != "token output":
                    assert out.columns == table.columns
    clean = dict(pipeline.STAGES)["decontamination"](spark, docs, f"file://{tmp_path}/a")
    items = [r for r in spark.read.parquet(f"file://{tmp_path}/a/benchmark.parquet").collect() if r.item_id]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == contaminated(docs.collect(), items) == {0, 1, 2, 10, 11, None}


def test_long_texts(spark):
    """A text of some megabytes among short ones."""
    word = "abcdefghi "
    d = spark.createDataFrame([(1, word * 300_000 + "tail one"), (2, word * 300_000 + "tail two"), (3, "short text"), (4, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.remove_repeats(d, texts=False).collect()}
    assert got[1].n_removed == 0 and got[2].n_bytes == 3_000_008 and got[2].n_removed >= 3_000_000 and got[4].n_removed == 0
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(d).collect()}
    assert groups == {1: (3, 1), 2: (3, 2), 3: (1, 3), 4: (1, 4)}
    assert {r.doc_id: r["size"] for r in mixing.queue(d.withColumn("source", F.lit("s"))).collect()} == {1: 300_002, 2: 300_002, 3: 2, 4: 1}
    assert {r.doc_id: r.n_bytes for r in lm.score(d).collect()} == {1: 3_000_008, 2: 3_000_008, 3: 10, 4: 2_000_000}
    scored = toxicity.score(d, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored)
    ids = {r.doc_id: r for r in tokens.token_index(d).collect()}
    assert len(ids) == 4 and ids[1].n_tokens > 300_000
    turns = spark.createDataFrame([(1, 0, "user", word * 100_000), (1, 1, "assistant", "# " * 100_000)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).first().loss_text == "# " * 100_000


def contaminated(docs, items):
    """By a search for every window in every text."""
    fold = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
    keys = {f" {' '.join(w[k : k + 10])} " for r in items for w in [fold(r.text).split(" ")] for k in range(max(1, len(w) - 9)) if w[0]}
    return {r.doc_id for r in docs for t in [f" {fold(r.text)} "] if any(k in t for k in keys)}


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    stages = dict(pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    bad = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == bad and clean.columns == columns
    single = stages["near copies"](spark, clean, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} == {c for i, _, c in components_by_force([(r.doc_id, r.text) for r in clean.collect()]) if i == c}
    fair = stages["decontamination"](spark, single, sf_dir).cache()
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in fair.collect()} == contaminated(single.collect(), bench.collect())
    mixed = stages["mixing"](spark, fair, sf_dir).cache()
    assert Counter(r.doc_id for r in mixed.collect()) == {r.doc_id: r.copies for r in mixing.queue(fair).collect() if r.copies} and mixed.columns == columns
    assert sorted(map(tuple, stages["token output"](spark, mixed, sf_dir).collect())) == sorted(map(tuple, pipeline.run(spark, sf_dir).collect()))
