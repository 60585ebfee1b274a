"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of shuffled documents, taken at most EPOCHS times over.
A copy's virtual finish time is the running number of its source's words, its
own included, divided by the source's target.  Copies of all sources are sorted
by that time over all, and the mix ends where the budget - the words of the whole
input - is used up.

The shuffle order is an md5 of the id, so reruns agree.  Running sums are made in
two levels: by source and leading digits of the md5, then within such a cell, so
that a source with a third of all rows is spread over all tasks.  The end of the
mix is found by histograms of finish times, each of the bin of the one before in which the
budget ends, down to a few rows.  All sources run from time 0 to 1 at their targets' pace, so equal spans of time hold
equal shares of words: mix() deals copies by spans and sorts each.

All running sums include ties, so rows that are equal in every respect get equal results, and so do rows
of one source and id.  Nulls: a null text has size 0, a null source is a source of its own (last in
order), a null id is shuffled like an empty one.  A source without words has
target 0 and nothing of it is taken.  Very long texts are one row each.  An empty table gives no rows.  Extra columns, whatever their names, are
kept by mix() and not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphworks.llm._pieces import planned_bytes, shuffle_width
from glyphworks.llm._shared import fresh, remove, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Bytes of input for each span of finish times in mix().
SPAN_BYTES = 16 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> also target: shares of the total by weight, none above epochs times its size.

    Water filling in closed form: sources reach their limit in the order of limit
    over weight; the level is what remains for the others.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    limit = F.lit(float(epochs)) * F.col("source_size")
    ordered = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy()
    t = sizes.withColumn("weight", w).withColumn("limit", limit)
    t = t.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    t = t.withColumn("below", F.coalesce(F.sum("limit").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    # the level if this source and all after it are open; the first source that stays below its limit sets it
    t = t.withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
    t = t.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(all_rows)["level"])
    return t.select("source", "source_size", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("weight"))).alias("target"))


#: Bins of a histogram, and rows of a bin that one task may sort.
BINS, FEW = 4096, 10_000


def _timed(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: str) -> DataFrame:
    """A written table: doc_id, source, size, key, source_size, target, finish (the finish time of each copy; null without a target)."""
    digits = min(5, max(2, math.ceil(math.log(max(2, planned_bytes(docs) / (1 << 20)), 16))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # texts are read once, to count their words; all that follows works on a few small columns
    rows, path = written(docs.select("doc_id", "source", word_count().alias("size"), key.alias("key")), "sizes")
    rows = rows.withColumn("cell", F.substring("key", 1, digits))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    shares = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, epochs)
    offsets = offsets.join(shares, offsets["source"].eqNullSafe(shares["source"])).select(offsets["source"].alias("s"), F.col("cell").alias("c"), "before", "source_size", "target")
    joined = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    done = F.col("before") + F.sum("size").over(Window.partitionBy("source", "cell").orderBy("key"))
    finish = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (e.cast("long") * F.col("source_size") + F.col("done")).cast("double") / F.col("target"))
    timed = joined.withColumn("done", done).select("doc_id", "source", "size", "key", F.col("source_size").cast("long").alias("source_size"), "target", F.when(F.col("target") > 0, finish).alias("finish"))
    timed, _ = written(timed, "finish-times")
    remove(docs.sparkSession, path)
    return timed


def _taken(timed: DataFrame) -> Column:
    """array of struct(t, key, e): the copies of a row that the mix takes."""
    copies = F.transform("finish", lambda t, e: F.struct(t.alias("t"), F.col("key").alias("key"), e.alias("e")))
    end = _end(timed)
    none = F.filter(copies, lambda c: F.lit(False))
    if end is None:
        return none
    last = F.struct(F.lit(end[0]).alias("t"), F.lit(end[1]).alias("key"), F.lit(end[2]).alias("e"))
    return F.coalesce(F.filter(copies, lambda c: c <= last), none)


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to epochs) and taken = copies x size."""
    timed = _timed(docs, weights, epochs, seed)
    copies = F.coalesce(F.size(_taken(timed)), F.lit(0))
    copies = F.when(F.col("finish").isNull(), F.lit(0)).otherwise(copies)
    return timed.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _end(timed: DataFrame) -> tuple[float, str, int] | None:
    """The last copy of the mix in the order (finish time, key, epoch).

    The driver gets the sums of a histogram's bins; the bin in which the budget ends is cut
    into bins again, by time and, where all its times are one, by the digits of the key.
    """
    copies = timed.where("finish is not null").select("size", "key", F.posexplode("finish").alias("e", "t"))
    rest = timed.agg(F.sum("size")).first()[0] or 0
    low, high = copies.agg(F.min("t"), F.max("t")).first()
    if low is None:
        return None
    last = None  # the last copy before the bin at hand
    here, digits = copies, 0
    order = F.struct("t", "key", "e")
    while True:
        if digits:
            bin_of = F.conv(F.substring("key", 1, digits), 16, 10).cast("decimal(38,0)") if digits <= 15 else F.col("key")
        else:
            bin_of = F.floor((F.col("t") - low) / (high - low) * BINS) if high > low else F.lit(0).cast("long")
        bins = here.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("many"), F.min("t").alias("low"), F.max("t").alias("high"), F.max(order).alias("last"), F.min("key").alias("key"))
        over = None
        for b in sorted(bins.collect(), key=lambda b: b.bin):
            if b["size"] > rest:
                over = b
                break
            rest, last = rest - b["size"], tuple(b["last"])
        if over is None:
            return last
        if digits:
            here = here.where(F.substring("key", 1, digits) == over.key[:digits])
        else:
            here = here.where(F.col("t").between(over.low, over.high))
        if over.many <= FEW or digits >= 15:
            break
        digits, low, high = (digits + 3 if over.low == over.high else 0), over.low, over.high
    # rows that are equal in all three count as one
    few = here.groupBy("t", "key", "e").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(Window.orderBy("t", "key", "e")))
    found = few.where(F.col("upto") <= rest).agg(F.max(order)).first()[0]
    return tuple(found) if found is not None else last


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs, in the order of finish times over all partitions."""
    timed = _timed(docs, weights, epochs, seed)
    own_id, own_source, copies, copy = (fresh(docs, n) for n in ("mix_id", "mix_source", "copies", "copy"))
    taken, _ = written(timed.select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), _taken(timed).alias(copies)).where(F.size(copies) > 0).distinct(), "taken")
    end = taken.agg(F.max(F.array_max(copies)["t"])).first()[0]
    every = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source))).withColumn(copy, F.explode(copies))
    spans = max(shuffle_width(docs), math.ceil(planned_bytes(docs) / SPAN_BYTES))
    span = F.least(F.lit(spans - 1), F.floor(F.col(copy)["t"] / F.lit(end or 1.0) * F.lit(spans))).cast("int")
    return every.withColumn(copies, span).repartitionById(spans, copies).sortWithinPartitions(copy).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), '')) as key from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, cast(list_value(5, 2, 1)[(row_number() over (order by source is null, source) - 1) % 3 + 1] as double) as weight from d group by source
), t as (
  select *, 3.0::double * source_size as lim, cast(sum(source_size) over () as double) as total from s
), u as (
  select *, coalesce(sum(lim) over (order by lim / weight, source is null, source rows between unbounded preceding and 1 preceding), 0) as below,
    sum(weight) over (order by lim / weight, source is null, source rows between current row and unbounded following) as open from t
), lv as (
  select min(case when (total - below) / open * weight <= lim then {'a': lim / weight, 'level': (total - below) / open} end)['level'] as level from u
), g as (
  select source, source_size, case when level is null then lim else least(lim, level * weight) end as target from u, lv
), f as (
  select d.doc_id, d.source, d.size, d.key, g.source_size, g.target, sum(d.size) over (partition by d.source order by d.key) as done from d join g on d.source is not distinct from g.source
), c as (
  select f.*, e, cast(e * source_size + done as double) / target as t from f, (select unnest(range(3)) as e) where target > 0
), m as (
  select *, sum(size) over (order by t, key, e) as upto from c
), k as (
  select doc_id, source, key, size, any_value(source_size) as ss, count(*) / any_value(n_rows) as copies from
    (select *, count(*) over (partition by doc_id, source, key, size, e) as n_rows from m) where upto <= (select sum(size) from d) group by 1, 2, 3, 4
)
select f.doc_id, f.size, cast(f.source_size as bigint) as source_size, f.target, cast(coalesce(k.copies, 0) * f.size as bigint) as taken
from f left join k on f.doc_id is not distinct from k.doc_id and f.source is not distinct from k.source and f.key = k.key and f.size = k.size
"""
