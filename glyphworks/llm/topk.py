"""Exact top-k inner products over norm-sorted, SVD-rotated blocks.

Components become integers, floor(scale * x).  Candidates are dealt into levels by
descending length, and each level into blocks by a hash, so that equal vectors do not meet
in one block.  The longest vectors give each query a lower bound of its k-th score, and so a
length below which no candidate can enter (Cauchy-Schwarz): queries are dealt by the
last level that matters to them, and pairs of a block and a query part beyond it are
never made.  In a block the leading coordinates of the rotation that diagonalises
the second moments give partial sums; the Cauchy-Schwarz inequality bounds the
rest, and the length of the next vectors bounds all that follow.  Only pairs
whose bound reaches the query's k-th score so far get an integer inner product,
so results are exact.

Vectors that are null, lack an id or hold null or non-finite components take no
part.  Shorter vectors count as filled up with zeros; an empty one has score 0 with all.  A query's own
rows are all rows with its id; a repeated query is asked once.  Ties go to the smaller id.
Components or scores that do not fit into 64 bits are an error.  Empty tables, or no queries, give no rows.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphworks.llm._shared import written

K, SCALE = 10, 1024
BLOCK, QUERIES, LEVELS, SEED_ROWS = 8192, 2048, 16, 512
_OUT = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>, norm): those vectors that take part."""
    e = F.col(vector_col)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    error = F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long")
    # Spark may evaluate this for rows that the filter below drops: those get nulls
    v = F.transform(e, lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).when(F.abs(x.cast("double")) < float("inf"), error))
    out = vectors.where(F.col(id_col).isNotNull() & e.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as int64, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(np.asarray(column.offsets))
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() if len(column) else 0 :]
    if len(lens) and (lens == width).all():
        return flat[: len(lens) * width].reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    inside = np.arange(width) < lens[:, None]
    out[inside] = flat[: int(lens.sum())]
    return out


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((width, width))
    for b in batches:
        m = _matrix(b.column("v"), width).astype(np.float64)
        total += m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def _rotation(v: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the summed second moments (width x width)."""
    parts = v.select("v").mapInArrow(lambda it: _moments(it, width), "m binary")

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for b in it:
            for x in b.column("m"):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    merged = parts.repartition(8).mapInArrow(add, "m binary").collect()
    moment = sum(np.frombuffer(r.m) for r in merged).reshape(width, width)
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products; an OverflowError if one does not fit into 64 bits."""
    if len(q) and float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1] >= 2.0**62:
        sums = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
        return np.array([_checked(s) for s in sums], np.int64)
    return np.einsum("ij,ij->i", q, x)


def _checked(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError("a score does not fit into 64 bits")
    return score


def _search(queries, cand, rotation: np.ndarray, seeds, k: int) -> tuple[np.ndarray, ...]:
    """Best k of a block for each query: query index, vec_id, score."""
    (qid, q), (cid, c), width = queries, cand, rotation.shape[0]
    norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    cid, c, norm = cid[order], c[order], norm[order]
    lead = max(1, width // 4)
    qr, xr = q @ rotation, c @ rotation
    q_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    q_rest = np.sqrt((qr[:, lead:] ** 2).sum(1))
    x_rest = np.sqrt((xr[:, lead:] ** 2).sum(1))
    bound = seeds.astype(np.float64).copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(c), 1024):
        slack = 1e-9 * q_norm * norm[at] + 0.5
        live = np.flatnonzero(q_norm * norm[at] + slack >= bound)
        if not len(live):
            break
        end = at + 1024
        upper = qr[live, :lead] @ xr[at:end, :lead].T + q_rest[live, None] * x_rest[None, at:end]
        qi, xi = np.nonzero((upper + slack[live, None] >= bound[live, None]) & (qid[live, None] != cid[None, at:end]))
        if not len(qi):
            continue
        qi, xi = live[qi], xi + at
        score = np.concatenate([_exact(q[qi[s : s + 65536]], c[xi[s : s + 65536]]) for s in range(0, len(qi), 65536)])
        qi, ids, score = (np.concatenate([a, b]) for a, b in zip(best, (qi, cid[xi], score), strict=True))
        o = np.lexsort((ids, ~score, qi))
        qi, ids, score = qi[o], ids[o], score[o]
        start = np.flatnonzero(np.append(True, qi[1:] != qi[:-1]))
        size = np.diff(np.append(start, len(qi)))
        rank = np.arange(len(qi)) - np.repeat(start, size)
        keep = rank < k
        best = (qi[keep], ids[keep], score[keep])
        full = start[size >= k]
        np.maximum.at(bound, qi[full], score[full + k - 1].astype(np.float64))
    return best


def _first_bounds(q: np.ndarray, qid: np.ndarray, seed_id: np.ndarray, seed: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score, from the longest vectors."""
    first = np.full(len(q), -np.inf)
    for s in range(0, len(q), 256):
        dots = q[s : s + 256].astype(np.float64) @ seed.T.astype(np.float64)
        dots[qid[s : s + 256, None] == seed_id] = -np.inf
        if dots.shape[1] >= k:
            first[s : s + 256] = np.partition(dots, -k, 1)[:, -k]
    return first - np.abs(np.where(np.isfinite(first), first, 0)) * 1e-9 - 0.5


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, levels: int = LEVELS, block: int = BLOCK, part: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k highest inner products of each query.

    is_query: a condition on vec_id.  Work is cut into pairs of a candidate block and a query part, both of bounded
    size, whatever their number.
    """
    spark = vectors.sparkSession
    v = integer_vectors(vectors, scale)
    n, width, top = v.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n or not width:
        return spark.createDataFrame([], empty)
    queries = v.where(is_query).select("vec_id", "v", "norm").distinct()
    rotation = _rotation(v, width)
    edge = v.select("norm").orderBy(F.desc("norm")).limit(SEED_ROWS).agg(F.min("norm")).first()[0]
    longest = v.where(F.col("norm") >= edge).select("vec_id", "v").limit(SEED_ROWS).collect()
    seeds = (np.array([r.vec_id for r in longest]), np.array([list(r.v) + [0] * (width - len(r.v)) for r in longest], np.int64))
    shared = spark.sparkContext.broadcast((rotation, seeds))
    # tops[l]: no vector of level l is longer
    tops = [top, *sorted({e for e in v.approxQuantile("norm", [i / levels for i in range(1, levels)], 0.01) if e < top}, reverse=True)]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("v"), width)
            first = _first_bounds(q, b.column("vec_id").to_numpy(), *shared.value[1], k)
            norm = b.column("norm").to_numpy()
            # a candidate needs this length at least; a little less, for rounding
            need = np.where(norm > 0, first / np.maximum(norm, 1e-300), -np.inf) * (1 - 1e-9)
            last = np.maximum(0, np.searchsorted(-np.array(tops), -need, "right") - 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(first), pa.array(last.astype(np.int32))], names=["vec_id", "v", "first", "last"])

    asked, _ = written(queries.mapInArrow(bounded, "vec_id long, v array<long>, first double, last int"), "queries")
    asked = asked.withColumn("query_key", F.xxhash64("v"))
    per = {r["last"]: r["count"] for r in asked.groupBy("last").count().collect()}  # a row for each level at most
    if not per:
        return spark.createDataFrame([], empty)
    # parts are numbered from the queries that reach farthest, so that a level is asked by the first few parts
    cuts, begin, parts = [0] * len(tops), [0] * len(tops), 0
    for level in reversed(range(len(tops))):
        begin[level] = parts
        parts += -(-per.get(level, 0) // part)
        cuts[level] = parts
    salts = -(-n // (len(tops) * block))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), at + 1)
    level = sum(((F.col("norm") <= t).cast("int") for t in tops[1:]), F.lit(0))
    cands = v.select("vec_id", "v", level.alias("level"), F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(salts)).cast("int").alias("salt")).where(pick(cuts, F.col("level")) > 0)
    cands = cands.select("vec_id", "v", (F.col("level") * F.lit(salts) + F.col("salt")).alias("block"), F.explode(F.sequence(F.lit(0), pick(cuts, F.col("level")) - 1)).alias("part"))
    own_part = pick(begin, F.col("last")) + F.pmod(F.xxhash64("vec_id"), pick([max(1, -(-per.get(x, 0) // part)) for x in range(len(tops))], F.col("last"))).cast("int")
    asked = asked.select("vec_id", "v", "first", "query_key", own_part.alias("part"), F.explode(F.sequence(F.lit(0), (F.col("last") + 1) * F.lit(salts) - 1)).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            picked, ids, score, qid, key = [], [], [], [], []
        else:
            qid, key = right.column("vec_id").to_numpy(), right.column("query_key").to_numpy()
            candidates = left.column("vec_id").to_numpy(), _matrix(left.column("v"), width)
            picked, ids, score = _search((qid, _matrix(right.column("v"), width)), candidates, shared.value[0], right.column("first").to_numpy(), k)
            qid, key = qid[picked], key[picked]
        return pa.table({"query_id": pa.array(qid, pa.int64()), "query_key": pa.array(key, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    found = cands.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(lambda x, y: search(x, y), _OUT)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, greatest(len(q.e), len(c.e)) + 1), lambda i: coalesce(q.e[i] * c.e[i], 0))) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
