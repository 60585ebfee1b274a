"""Token ids of whole texts, written in document order as entropy-coded blocks.

Three steps: tokenize (no shuffle; ids go to a table in the shared folder, and
their counts make one frequency table), range-sort by doc_id and encode each
range in blocks of whole documents, then read the files back.

Texts are cut at single spaces between other characters, where the tokenizer's own
pre-tokenizer always cuts, so a part can be encoded once for all its occurrences.

The string of an added token in a text, such as ``<|endoftext|>``, gets that token's id,
as in the library's own call.

Nulls: a null text is empty and has the end id only; a null doc_id comes last.
Rows with the same doc_id are ordered by a hash of their ids, and each is kept.  A very
long text is one document of one block.  An empty table gives files without blocks.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphworks.llm import rans
from glyphworks.llm._pieces import give_back, kept_in_worker, planned_bytes, shuffle_width
from glyphworks.llm._shared import new_path, remove, written

END_ID = 0
BLOCK_TOKENS = 1 << 18
#: Parts of texts that a worker remembers, about 200 bytes each, until another operator runs there.
MEMORY = 1_000_000
#: White space other than the space and the line feed, and runs that a cut at single spaces would break.
_RARE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LATIN = "ɐ"
_MARKS = ".,;:!?"

TOKEN_SCHEMA = "doc_id long, ids binary, n long"
FILE_SCHEMA = "shard int, block long, shard_start long, n long, doc_ids binary, lengths binary, payload binary"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Parts(dict):
    """Parts of texts to their packed ids; what is missing is encoded, and kept while there is room."""

    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room, self.recent = encode, room, {}

    def __missing__(self, part: str) -> bytes:
        found = self.recent.get(part)
        if found is None:
            found = self.encode(part)
            if len(self) < self.room:
                self[part] = found
            else:
                if len(self.recent) >= 50_000:
                    self.recent.clear()
                self.recent[part] = found
        return found


def splits_at_spaces(setup: dict) -> bool:
    """Whether the shortcuts of Encoder hold: byte-level BPE alone, with its own pattern, and nothing before or after it."""
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    model = setup["model"]
    return (
        {k: v for k, v in (setup["pre_tokenizer"] or {}).items() if k in level} == level
        and not any(setup.get(k) for k in ("normalizer", "truncation", "padding"))
        and (setup.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel"
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    )


class Encoder:
    """ids of a text as packed integers; the same as Tokenizer.encode(text, add_special_tokens=False).

    Texts that hold the string of an added token, and all texts where the tokenizer is of another kind than the
    shortcuts are made for, go to the library whole.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self.quick = splits_at_spaces(setup)
        added = [t["content"] for t in setup["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.alphabet = byte_alphabet()
        self.packed = [self._pack([i]) for i in range(self.vocabulary)] if self.quick else []
        self.marks = {m: self._any(m) for m in [*_MARKS, "\n"]} if self.quick else {}
        self.heads = _Parts(lambda p: self._part(p, ""), memory // 8)
        self.parts = _Parts(lambda p: self._part(p, " "), memory)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _any(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str, lead: str) -> bytes:
        """A part after a space or at the start of a text or line.

        Letters alone are one pre-token, which the tokenizer's model encodes; a mark after letters and a line feed
        between other characters are pre-tokens of their own.
        """
        plain = part.isascii()
        if part.isalpha() and (plain or max(part) < _LATIN):
            spelled = ("Ġ" if lead else "") + part if plain else (lead + part).encode().decode("latin-1").translate(self.alphabet)
            return b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)])
        word = part[:-1]
        if word.isalpha() and part[-1] in _MARKS and (plain or max(word) < _LATIN):
            return (self.parts if lead else self.heads)[word] + self.marks[part[-1]]
        if "\n" in part and part[0] != "\n" and part[-1] != "\n" and "\n\n" not in part and not _RARE.search(part) and " " not in part:
            first, *rest = part.split("\n")
            return (self.parts if lead else self.heads)[first] + b"".join(self.marks["\n"] + self.heads[r] for r in rest)
        return self._any(lead + part)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.quick:
            return [self._pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        heads, get, out = self.heads, self.parts.__getitem__, []
        for t in texts:
            if self.added(t):
                out.append(self._any(t))
                continue
            if "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or _RARE.search(t):
                c = _CUT.split(t)
            else:
                c = t.split(" ")
            out.append(heads[c[0]] + b"".join(map(get, c[1:])))
        return out


def worker_encoder(path: str) -> Encoder:
    """One encoder for each Python worker, whatever tasks of tokenize() it runs."""
    kept = kept_in_worker().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (packed u16, or u32 for large vocabularies, with the end id), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path(path))
        end = encoder._pack([end_id])
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                part, chars = [], 0
                while at + len(part) < batch.num_rows and chars < 4 << 20:
                    part.append(texts[at + len(part)].as_py() or "")
                    chars += len(part[-1])
                packed = [p + end for p in encoder.encode(part)]
                n = pa.array([len(p) // encoder.kind.itemsize for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(packed, pa.binary()), n], names=["doc_id", "ids", "n"])
                at += len(part)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKEN_SCHEMA)


def _counts(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """Occurrences of each id: partial sums of a fixed size, merged in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if len(x.as_buffer()) > 4 * size else 0
            small = b"".join(x.as_py() for x in b.column("ids") if len(x.as_buffer()) <= 4 * size)
            total += np.bincount(np.frombuffer(small, kind), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("c"):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["c"])

    merged = tokens.select("ids").mapInArrow(count, "c binary").repartition(8).mapInArrow(add, "c binary").collect()
    return sum((np.frombuffer(r.c, np.int64) for r in merged), np.zeros(size, np.int64))


def write_blocks(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> str:
    """Tokenizes docs and writes their ids under out, in ascending doc_id order; returns out.

    out/table has the shared frequency table, out/blocks a row for each block of
    whole documents: shard and block give its place, doc_ids and lengths (packed
    i64, the smallest i64 for a null id) its documents, payload the coded ids.
    """
    spark = docs.sparkSession
    encoder = Encoder(tokenizer_path(path))
    kind, size = encoder.kind.str, max(encoder.vocabulary, end_id + 1)
    tokens, at = written(tokenize(docs, path, end_id), "tokens")
    freq = rans.frequencies(_counts(tokens, size, kind))
    spark.createDataFrame([(rans.BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, shard = rans.Table(shared.value), TaskContext.get().partitionId()
        block = start = held = 0
        ids: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            row = (shard, block, start, held, np.array(ids, "<i8").tobytes(), np.array([len(p) for p in parts], "<i8").tobytes(), rans.encode(np.concatenate(parts), table))
            block, start, held = block + 1, start + held, 0
            ids.clear()
            parts.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "shard_start", "n", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids.append(np.iinfo(np.int64).min if doc is None else doc)
                parts.append(np.frombuffer(x.as_py(), kind))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    shards = max(shuffle_width(docs), planned_bytes(tokens) // (32 << 20))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("ids")]
    tokens.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").parquet(f"{out}/blocks")
    remove(spark, at)
    return out


def read_blocks(spark, path: str, ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and with ids the ids themselves."""
    head = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(head.freq, "<u4").astype(np.int64), head.bits))
    schema = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(*shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                flat = rans.decode(r["payload"], table)
                docs, lens = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lengths"], "<i8")
                ends = np.cumsum(lens)
                each = [flat[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(docs), r["shard"], np.int32)),
                    pa.array(ends - lens + r["shard_start"]),
                    pa.array(docs, mask=docs == np.iinfo(np.int64).min),
                    pa.array(lens),
                    pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in each], pa.int64()),
                ]
                names = ["shard", "at", "doc_id", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    docs = files.select("shard", "shard_start", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n").alias("n")).select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(shards, F.col("shard") == F.col("s")).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_index(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files into the shared folder and returns what they say of each document."""
    spark = docs.sparkSession
    return read_blocks(spark, write_blocks(docs, new_path(spark, "token-blocks"), path, end_id))
