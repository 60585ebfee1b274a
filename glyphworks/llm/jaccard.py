"""N-gram Jaccard join: documents whose word shingles overlap by at least a share of their union.

Only links matter, and of those as many as connect the documents, so nothing
within a group of copies is paired with everything else in it:

1. Each document gets its shingle set and a digest of it.  Documents with equal sets are
   linked, and one of them goes on.
2. Shingles are classed by the number of documents that hold them: private (one),
   rare (up to ``frequent``), frequent.  Ordered private first, frequent last, two sets
   that link share a shingle in the prefix of length |s| - ceil(t |s|) + 1.  If the
   first that they share is rare, it is an index key of both.  If it is frequent, all that
   they share is, and the sets agree in most combinations of ``k`` frequent shingles
   that follow each other in the order: a set has a combination for each of its frequent
   shingles, and each difference of the two sets breaks k of them at most.  So a set
   indexes as many of its combinations, by their hashes, as differences can
   break, and one more: its prefix grows with its size, never with the square of it.
   k is 2, and 3 where the corpus is so large that pairs of frequent shingles are frequent.
3. Each document is compared with the smallest one under each of its first few index
   keys; that connects most of what links.
4. Wherever documents of different components still meet under a key, they are paired: those
   outside the largest component of the key with all others.  Where a rare key
   stands in the prefix bounds the overlap of a link that first shows up there, and a
   small parity map of each set bounds the difference of two sets from below; both
   only drop pairs that cannot link.  What is left is compared exactly.

Nulls: a null text is empty and linked with nothing; rows without a doc_id have no
component.  Rows with the same doc_id are one node.  Repeated rows stay.  Very long texts are
one set each, a shingle takes eight bytes.  An empty table gives no rows.  Other columns,
whatever their names, are not read; one_of_each returns them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphworks.llm._pieces import BLOB_SCHEMA, blobs, bucket_count, clear_worker, cuts, grouped, mix, piece_count, rows_of, texts_of
from glyphworks.llm._shared import fresh, written
from glyphworks.llm._shingles import WORDS, shingle_sets
from glyphworks.llm.components import components

PERCENT, FREQUENT, LEAD = 80, 64, 6
#: Words of the map of each set that tells most unlike sets apart.
MAP_WORDS = 8
#: Places of the one-hash filter that spares texts without a pair the shuffle: a bounded broadcast.
FILTER = 1 << 20
_SIGNED = np.int64
_MAP = [f"m{k}" for k in range(MAP_WORDS)]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link; empty ones never do."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and its parity map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear_worker()
        for batch in batches:
            n, digest, maps = [], [], []
            for s in shingle_sets(*texts_of(batch.column("text")), words):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                maps.append(parity_map(s))
            maps = np.array(maps, _SIGNED).reshape(-1, MAP_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(m) for m in maps.T)], names=["doc_id", "n_shingles", "digest", *_MAP])

    return _plain(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, " + ", ".join(f"{m} long" for m in _MAP))


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """(a, b): each row's doc_id with the smallest of its key.

    Minima are aggregated before rows meet.  They meet by a hash of the key, for which both sides
    are exchanged anew, so that Spark can split a key that very many rows have.
    """
    least = rows.groupBy(key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("z > a").select(F.xxhash64(key).alias("h"), F.col(key).alias("own"), "a")
    met = rows.withColumn("h", F.xxhash64(key)).join(least, "h").where((F.col(key) == F.col("own")) & (F.col("doc_id") > F.col("a")))
    return met.select("a", F.col("doc_id").alias("b")).distinct()


def verified(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Those of the distinct pairs (a, b) of doc_ids whose shingle sets link."""
    pairs, _ = written(pairs, "pairs")  # read three times below
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int")
    wanted = pairs.select(place("a").alias("place")).union(pairs.select(place("b").alias("place"))).distinct()  # at most FILTER rows
    texts = _plain(docs).where("doc_id is not null").withColumn("place", place("doc_id")).join(F.broadcast(wanted), "place", "left_semi").select("doc_id", "text")
    left = pairs.join(texts, F.col("a") == F.col("doc_id")).select("a", "b", F.col("text").alias("x"))
    joined = left.join(texts, F.col("b") == F.col("doc_id")).select("a", "b", "x", F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = zip(shingle_sets(*texts_of(batch.column("x")), words), shingle_sets(*texts_of(batch.column("y")), words), strict=True)
                keep = pa.array([linked(x, y, percent) for x, y in sets], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return joined.mapInArrow(run, "a long, b long").distinct()


def _sets(table: pa.Table, first: pa.Table, words: int):
    """doc_ids and sets of those documents of a piece that stand for theirs; first has their ids."""
    own = table.filter(pc.is_in(table.column("doc_id"), value_set=first.column("node").combine_chunks()))
    return own.column("doc_id").to_numpy(), list(shingle_sets(*texts_of(own.column("text")), words))


def _values(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """bucket and 32 more bits of each shingle of all sets; others that collide only look less private."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))


def _distinct(sets: list[np.ndarray], buckets: int):
    value = _values(sets, buckets)
    order = np.argsort(value, kind="stable")
    start = cuts(value[order])
    return value, order, start, value[order[start]]


def _ask(table: pa.Table, first: pa.Table, buckets: int, words: int) -> pa.Table:
    """Each distinct shingle of a piece once, with the number of documents that hold it (255 for more)."""
    if not table.num_rows:
        return blobs([])
    _, sets = _sets(table, first, words)
    value, _, start, distinct = _distinct(sets, buckets)
    many = np.minimum(np.diff(np.append(start, len(value))), 255).astype(np.uint8)
    bucket = (distinct >> np.uint64(32)).astype(np.int64)
    piece, out = table.column("piece")[0].as_py(), []
    edges = np.append(cuts(bucket), len(bucket))
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        out.append((piece, int(bucket[s]), 0, np.uint32(e - s).tobytes() + (distinct[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + many[s:e].tobytes()))
    return blobs(out)


def _classify(table: pa.Table, frequent: int) -> pa.Table:
    """0 private, 1 rare, 2 frequent, for each asked shingle."""
    rows = rows_of(table, "piece")
    sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for *_, b in rows]
    value = np.concatenate([np.frombuffer(b, np.uint32, n, 4) for (*_, b), n in zip(rows, sizes, strict=True)])
    many = np.concatenate([np.frombuffer(b, np.uint8, n, 4 + 4 * n) for (*_, b), n in zip(rows, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(value, kind="stable")
    start = cuts(value[order])
    number = np.add.reduceat(many[order], start) if len(start) else many
    klass = np.where(number > frequent, 2, np.where(number > 1, 1, 0)).astype(np.uint8)
    back = np.empty(len(value), np.uint8)
    back[order] = np.repeat(klass, np.diff(np.append(start, len(value))))
    ends = np.cumsum(sizes)
    return blobs([(p, k, 0, np.packbits(back[e - n : e] > 0).tobytes() + np.packbits(back[e - n : e] > 1).tobytes()) for (p, k, _, _), n, e in zip(rows, sizes, ends, strict=True)])


def prefix_keys(shingles: np.ndarray, klass: np.ndarray, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and for each the largest overlap of a link that first shows up under it.

    Of n shingles, a set that links has all but ``spare`` = n - ceil(t n).  In the order private, rare,
    frequent, what stands before a first shared shingle is not shared.  So a first shared shingle stands in
    the first spare + 1 places; if it is rare, it is a key.

    If it is frequent, the r others are not shared.  A combination is k frequent shingles in a row, by
    their hashes.  Where a set that links lacks d of these n shingles and has e others, d + t e <= (1 - t) n;
    at least r of the d are none of the frequent ones.  A shingle that is lacking breaks k combinations, one that
    only the other set has k - 1.  For t >= (k - 1) / k most are broken where e is 0: k ((1 - t) n - r).  So of
    any combinations more than that, the two sets share one; both index so many of those with the
    smallest hashes, and one more.  Sets with too few combinations, and all sets if t is lower, index their
    frequent shingles one by one, besides.
    """
    n = len(shingles)
    least = (percent * n + 99) // 100
    spare = n - least
    order = np.lexsort((shingles, klass))
    s, kind = shingles[order], klass[order]
    rare = np.flatnonzero(kind[: spare + 1] == 1)
    keys, room = [s[rare]], [n - rare]
    r = n - int((klass == 2).sum())
    if r <= spare:
        common = s[r:]
        broken = k * ((100 - percent) * n - 100 * r) // 100
        many = len(common) - k + 1
        if many > 0:
            combined = common[:many].copy()
            for j in range(1, k):
                combined = mix(combined * np.uint64(0x9E3779B97F4A7C15) + common[j : j + many])
            keys.append(np.sort(combined)[: broken + 1])
            room.append(np.full(len(keys[-1]), n - r))
        if many <= broken or percent * k < 100 * (k - 1):
            single = common[: spare + 1 - r]
            keys.append(mix(single + np.uint64(k)))
            room.append(n - r - np.arange(len(single)))
    return np.concatenate(keys), np.concatenate(room)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Which of MAP_WORDS x 64 places an odd number of shingles falls on; two maps differ in no more places than the sets do in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(_SIGNED)


_INDEX_SCHEMA = "key long, doc_id long, n long, room long, lead boolean"


def _index(table: pa.Table, more: pa.Table, buckets: int, words: int, percent: int, k: int, lead: int) -> pa.Table:
    """A row for each index key of each document; lead marks the few smallest keys of a document."""
    parts: list[tuple] = []
    if table.num_rows:
        ids, sets = _sets(table, more.filter(pc.equal(more.column("kind"), 9)), words)
        value, order, start, distinct = _distinct(sets, buckets)
        bucket = (distinct >> np.uint64(32)).astype(np.int64)
        per = np.bincount(bucket, minlength=buckets) if len(bucket) else np.zeros(buckets, np.int64)
        at = np.cumsum(per) - per
        klass = np.zeros(len(distinct), np.uint8)
        for _, p, kind, b in rows_of(more, "bucket"):
            if kind == 0:
                bits = np.frombuffer(b, np.uint8)
                half = len(bits) // 2
                klass[at[p] : at[p] + per[p]] = np.unpackbits(bits[:half], count=per[p]) + np.unpackbits(bits[half:], count=per[p])
        every = np.empty(len(value), np.uint8)
        every[order] = np.repeat(klass, np.diff(np.append(start, len(value))))
        done = 0
        for i, s in zip(ids.tolist(), sets, strict=True):
            own = every[done : done + len(s)]
            done += len(s)
            if own.any():
                keys, room = prefix_keys(s, own, percent, k)
                if len(keys):
                    first = np.zeros(len(keys), bool)
                    first[np.argpartition(keys, lead - 1)[:lead] if 0 < lead < len(keys) else slice(0, lead and None)] = True
                    parts.append((keys.view(_SIGNED), np.full(len(keys), i), np.full(len(keys), len(s)), room, first))
    names, kinds = ["key", "doc_id", "n", "room", "lead"], [pa.int64()] * 4 + [pa.bool_()]
    return pa.table({c: pa.array(np.concatenate([p[j] for p in parts]) if parts else [], t) for j, (c, t) in enumerate(zip(names, kinds, strict=True))})


def index(docs: DataFrame, first: DataFrame, percent: int = PERCENT, words: int = WORDS, frequent: int = FREQUENT, lead: int = LEAD) -> DataFrame:
    """key, doc_id, n, room, lead: the index of those documents whose doc_id is in first."""
    pieces, buckets = piece_count(docs), bucket_count(docs)
    k = 2 if first.count() <= 64 * frequent**2 else 3
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)).cast("int")
    dealt = grouped(_plain(docs).where("doc_id is not null").select(piece("doc_id").alias("piece"), "doc_id", "text"), "piece", pieces)
    marks = first.select(piece("doc_id").alias("piece"), F.lit(None).cast("int").alias("bucket"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("blob"), F.col("doc_id").alias("node"))
    asked = dealt.cogroup(grouped(marks.select("piece", "node"), "piece", pieces)).applyInArrow(lambda x, y: _ask(x, y, buckets, words), BLOB_SCHEMA)
    classes = grouped(asked, "bucket", buckets).applyInArrow(lambda t: _classify(t, frequent), BLOB_SCHEMA)
    more = grouped(classes.withColumn("node", F.lit(None).cast("long")).unionAll(marks), "piece", pieces)
    return dealt.cogroup(more).applyInArrow(lambda x, y: _index(x, y, buckets, words, percent, k, lead), _INDEX_SCHEMA)


def leftover(found: DataFrame, groups: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of documents of different components that share an index key and may link."""
    own = found.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    own, _ = written(own.select("key", "doc_id", "n", "room", "component"), "index-rows")
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("many")).where("many > 1")
    mixed = mixed.select(F.col("key").alias("mixed_key"), F.xxhash64("key").alias("h"), F.col("main.component").alias("main"))
    rows = own.withColumn("h", F.xxhash64("key")).join(mixed, "h").where(F.col("key") == F.col("mixed_key")).drop("mixed_key", "h")
    maps = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), *_MAP).distinct()
    rows, _ = written(rows.join(maps, ["doc_id", "n"]), "mixed-rows")
    minor = rows.where("component <> main").drop("main")
    other = rows.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("room").alias("room_b"), "main", *[F.col(m).alias(f"w{m}") for m in _MAP])
    # o of a union of n + nb - o is t or more if and only if o (1 + t) is t (n + nb) or more
    enough = F.least("room", "room_b") * (100 + percent) >= percent * (F.col("n") + F.col("nb"))
    # sets that link differ in (1 - t) / (1 + t) of n + nb shingles at most
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"w{m}"))) for m in _MAP), F.lit(0))
    enough = enough & (apart * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("nb"))) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
    # two rows outside the main component meet twice, and count once
    once = (F.col("cb") == F.col("main")) | (F.col("doc_id") < F.col("b"))
    met = minor.join(other, "key").where((F.col("component") != F.col("cb")) & once & enough)
    return met.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def join_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, frequent: int = FREQUENT, lead: int = LEAD) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) for each row of docs."""
    signed, _ = written(signatures(docs, words), "signatures")
    ids = signed.where("doc_id is not null and n_shingles > 0")
    equal = _stars(ids.select("doc_id", "digest"), "digest")
    # of equal sets, one goes on
    first, _ = written(ids.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "first")
    found, _ = written(index(docs, first, percent, words, frequent, lead), "index")
    near, _ = written(verified(docs, _stars(found.where("lead").select("doc_id", "key"), "key"), percent, words), "near-links")
    groups, _ = written(components(equal.unionByName(near)), "groups")
    missed, _ = written(verified(docs, leftover(found, groups, signed, percent), percent, words), "more-links")
    links = groups.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(missed)
    final = groups if missed.isEmpty() else components(links)
    final = final.select(F.col("node"), "component")
    return signed.join(final, signed["doc_id"] == final["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents without those that link, directly or not, to one with a smaller id; all columns stay."""
    own = fresh(docs, "lost")
    found = join_components(docs, percent, words).where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(own), "left_anti")


SQL = r"""
with recursive t as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select row_no, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from t
), e as (
  select row_no, unnest(g) as x from s where doc_id is not null
), o as (
  select a.row_no as i, b.row_no as j, count(*) as n_both from e a join e b on a.x = b.x and a.row_no < b.row_no group by 1, 2
), l as (
  select distinct p.doc_id as a, q.doc_id as b from o join s p on p.row_no = i join s q on q.row_no = j where 100 * n_both >= 80 * (len(p.g) + len(q.g) - n_both)
), both_ways as (
  select a, b from l union select b, a from l
), reach as (
  select a as node, a as seen from both_ways union select node, b from reach join both_ways on seen = a
), c as (
  select node, min(seen) as component_id from reach group by node
)
select doc_id, cast(len(g) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id from s left join c on node = doc_id
"""
