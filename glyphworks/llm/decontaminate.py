"""Benchmark passages in documents: Aho-Corasick over normalised item windows, in one scan of the text.

Words are maximal runs of ASCII letters, digits and characters above U+007F,
with A-Z in lower case.  A window is ``window`` consecutive words of an item; an
item with fewer words, but not none, is one window.  The text of a document is
normalised to its words between single spaces and scanned once; matches are
mapped back to byte offsets in the original text.

All windows are one automaton while they fit into AUTOMATON_BYTES, as those of any
usual benchmark do.  More are dealt by their hash into shards of that size, an automaton
each; what the shards find in a document is merged, so results do not depend on it.

Nulls: a null text has no words; an item without id or text takes no part, ids of any
type are compared as strings.  Repeated items count once; each row of documents is
scanned for itself, so equal rows give equal results.  Very long texts are scanned whole.
Empty tables give no rows, or no hits.  Other columns, whatever their names, are not
read; keep_clean returns them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.llm._shared import written

WINDOW = 10
#: Bytes of window text in one automaton; a node takes about 40 bytes of a worker's memory.
AUTOMATON_BYTES = 8 << 20
_KEEP = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Bytes to their normal form: lower case, other ASCII than letters and digits to a space.
FOLD = bytes(ord(chr(b).lower()) if chr(b).lower() in _KEEP else 32 if b < 128 else b for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FLAG_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, span_starts array<long>, span_ends array<long>"


def windows_of(text: bytes, window: int) -> list[bytes]:
    words = text.translate(FOLD).split()
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def build_automaton(windows: dict[bytes, list[int]]):
    """Keys stand between spaces, so that matches start and end with words."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, items in windows.items():
        automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, items))
    automaton.make_automaton()
    return automaton


def scan(text: bytes, automaton) -> tuple[int, list[str], list[tuple[int, int, int, int]]]:
    """Number of words, items that occur, and the runs of words inside occurrences: first and last word, first byte and end in text."""
    words = text.translate(FOLD).split()
    if not len(automaton):
        return len(words), [], []
    flat = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(flat.decode("latin-1")))
    if not hits:
        return len(words), [], []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    last = np.searchsorted(gaps, np.array([end for end, _ in hits])) - 1
    first = last - np.array([n for _, (n, _) in hits]) + 1
    edge = np.bincount(first, minlength=len(words) + 1) - np.bincount(last + 1, minlength=len(words) + 1)
    inside = np.cumsum(edge[:-1]) > 0
    flip = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begin, stop = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1) - 1
    at = [m.span() for m in _WORD.finditer(text)]
    runs = [(b, e, at[b][0], at[e][1]) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
    return len(words), sorted({i for _, (_, items) in hits for i in items}), runs


def merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of several shards as runs of all: those that overlap or touch are one."""
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(runs):
        if out and r[0] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]), out[-1][2], max(out[-1][3], r[3]))
        else:
            out.append(r)
    return out


def _flags(ids, found) -> pa.RecordBatch:
    """Rows of FLAG_SCHEMA from (words, items, runs)."""
    columns = [
        ids,
        pa.array([n for n, _, _ in found], pa.int64()),
        pa.array([sum(r[1] - r[0] + 1 for r in runs) for _, _, runs in found], pa.int64()),
        pa.array([items for _, items, _ in found], pa.list_(pa.string())),
        pa.array([[r[2] for r in runs] for _, _, runs in found], pa.list_(pa.int64())),
        pa.array([[r[3] for r in runs] for _, _, runs in found], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "span_starts", "span_ends"])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, items): every distinct window with the ids of the items that have it."""
    plain = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(k, i) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for k in sorted(set(windows_of(t, window)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.binary()), pa.array([i for _, i in pairs], pa.string())], names=["key", "item_id"])

    return plain.mapInArrow(run, "key binary, item_id string").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _shards(items: DataFrame, window: int, limit: int) -> list:
    """Broadcasts of windows and their items, each of about ``limit`` bytes of windows."""
    sc = items.sparkSession.sparkContext
    windows = item_windows(items, window)
    size = windows.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    many = max(1, -(-size // max(1, limit)))
    if many > 1:
        windows, _ = written(windows, "windows")
    own = lambda k: windows if many == 1 else windows.where(F.pmod(F.xxhash64("key"), F.lit(many)) == k)
    return [sc.broadcast({bytes(r.key): r["items"] for r in own(k).collect()}) for k in range(many)]


def flag(docs: DataFrame, items: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: words, words inside item windows, the items, and the spans in its UTF-8 bytes.

    docs: doc_id, text; items: item_id, text.  With one automaton, documents are read once, without a
    shuffle.  With several, each shard reads them and only rows with hits are shuffled, to be merged.
    """
    shards = _shards(items, window, automaton_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if len(shards) == 1:
        (shared,) = shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for batch in batches:
                yield _flags(batch.column("doc_id"), [scan(t.as_py() or b"", automaton) for t in batch.column("text")])

        return texts.mapInArrow(run, FLAG_SCHEMA)

    # rows that are equal in both columns have equal results
    keyed = texts.withColumn("row", F.sha2(F.coalesce("text", F.lit(b"")), 256))

    def hits_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for batch in batches:
                found = [scan(t.as_py() or b"", automaton) for t in batch.column("text")]
                on = [k for k, (_, items, _) in enumerate(found) if items]
                rows = batch.take(pa.array(on, pa.int64()))
                runs = pa.array([[list(r) for r in found[k][2]] for k in on], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array([found[k][1] for k in on], pa.list_(pa.string())), runs], names=["doc_id", "row", "items", "runs"])

        return run

    hits = None
    for shared in shards:
        own = keyed.mapInArrow(hits_of(shared), "doc_id long, row string, items array<string>, runs array<array<long>>")
        hits = own if hits is None else hits.unionAll(own)
    per = hits.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    per = per.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row"), "items", "runs")
    joined = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left").select("doc_id", "text", "items", "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [len((t.as_py() or b"").translate(FOLD).split()) for t in batch.column("text")]
            items, runs = (batch.column(c).to_pylist() for c in ("items", "runs"))
            yield _flags(batch.column("doc_id"), [(n, sorted(i or []), merged([tuple(x) for x in r or []])) for n, i, r in zip(words, items, runs, strict=True)])

    return joined.mapInArrow(merge, FLAG_SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents in which no window occurs, with all their columns; each row is judged by its own text."""
    shards = _shards(items, window, automaton_bytes)

    def clean_by(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for batch in batches:
                text = batch.column("text").cast(pa.binary())
                yield batch.filter(pa.array([not scan(t.as_py() or b"", automaton)[1] for t in text], pa.bool_()))

        return clean

    for k, shared in enumerate(shards):
        # written between shards, so that a task holds one automaton at a time
        docs = (written(docs, "clean")[0] if k else docs).mapInArrow(clean_by(shared), docs.schema)
    return docs


SQL = r"""
with d as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null
), p as (
  select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i0 from b where len(w) > 0
), keys as (
  select distinct item_id, n, array_to_string(w[i0:i0 + n - 1], ' ') as k from p
), q as (
  select row_no, w, n, unnest(range(1, len(w) - n + 2)) as i0 from d, (select distinct n from keys) where len(w) >= n
), hits as (
  select q.row_no, q.i0, q.n, keys.item_id from q join keys on keys.n = q.n and keys.k = array_to_string(q.w[q.i0:q.i0 + q.n - 1], ' ')
), words as (
  select row_no, count(distinct i) as n_hit from (select row_no, unnest(range(i0, i0 + n)) as i from hits) group by 1
), items as (
  select row_no, count(*) as n_items, string_agg(i, ',' order by i) as listed from (select distinct row_no, cast(item_id as varchar) as i from hits) group by 1
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (row_no) left join items using (row_no)
"""
