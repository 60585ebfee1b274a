"""A sliding-log quota: an event is admitted unless its actor had ``limit`` admissions in the last ``window`` seconds.

Rejected events are not logged, and an admission just ``window`` seconds old still counts.
Events of one time are taken in the order of their number.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

LIMIT, WINDOW = 60, 60.0
_OUT = "actor string, event_id long, ts timestamp, admitted boolean"


def admit(times: list[float], log: deque, limit: int, window: float) -> list[bool]:
    """Decisions for ascending times; log holds the admissions that may still count."""
    out = []
    for t in times:
        while log and log[0] < t - window:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out


def admissions(events: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """Batch form: actor, event_id, ts -> also admitted.  Actors are independent.

    An actor's rows come sorted and in batches, and only its log of at most
    ``limit`` times is kept between them, so an actor with very many rows needs no
    more memory; a null time is not admitted.
    """
    keyed = events.select(F.col("actor").cast("string").alias("actor"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = keyed.where("ts is not null").repartition("actor").sortWithinPartitions("actor", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        actor, log = object(), deque()
        for b in batches:
            if not len(b):
                continue
            times = b["ts"].to_numpy("datetime64[us]").astype(np.int64)
            names = b["actor"].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(b)]
            decided: list[bool] = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if names[s] != actor:
                    actor, log = names[s], deque()
                decided += admit(times[s:e].tolist(), log, limit, window * 1e6)
            yield b.assign(admitted=decided)

    late = keyed.where("ts is null").withColumn("admitted", F.lit(False))
    return timed.mapInPandas(run, _OUT).unionByName(late)


def stream_admissions(events: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """Streaming form with the log as state, which is dropped once it is a window old.  Events count in the order of their arrival in batches."""

    def run(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = (rows["ts"].to_numpy("datetime64[us]").astype(np.int64) / 1e6).tolist()
        decided = admit(times, log, limit, window)
        state.update((list(log),))
        state.setTimeoutDuration(int(window * 2000) + 1000)
        yield rows.assign(actor=key[0], admitted=decided)[["actor", "event_id", "ts", "admitted"]]

    keyed = events.select(F.col("actor").cast("string").alias("actor"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts")).where("ts is not null and actor is not null")
    return keyed.groupBy("actor").applyInPandasWithState(run, _OUT, "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def actor_key(address: str, secret: bytes, prefix: str = "anon_") -> str:
    """A keyed digest of an address, so that logs hold no addresses."""
    digest = hmac.new(secret, address.encode(), hashlib.sha256).digest()
    return prefix + base64.urlsafe_b64encode(digest).decode().rstrip("=")


def with_actor(df: DataFrame, secret: bytes, forwarded: str = "forwarded_for", peer: str = "peer") -> DataFrame:
    """The first forwarded address, or else the peer's, as an actor key."""
    first = F.trim(F.substring_index(F.col(forwarded), ",", 1))
    address = F.coalesce(F.when(F.length(first) > 0, first), F.col(peer), F.lit("unknown"))

    @F.pandas_udf("string")
    def keyed(addresses: pd.Series) -> pd.Series:
        return addresses.map(lambda a: actor_key(a, secret))

    return df.withColumn("actor", keyed(address))
