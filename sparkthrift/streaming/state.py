"""Streaming twins of the stateful operators.

Keyed state lives in the state store (use the RocksDB provider).  Results equal the
batch folds' on input that arrives in order within each key; all columns are carried.

State ends.  With ``delay`` (how late rows may come) a watermark runs on ``ts``, and
event-time timers drop what can change no answer any more: an expired response, a
sighting beyond its time, a bucket that is full again, a handle that has lapsed.
Without it keys are kept for good.  A key's state is a few numbers, or a list that a
cap bounds.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from sparkthrift.operators import metrics
from sparkthrift.operators.caching import Ring

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """One value of state per key; rows of a batch are taken in order of time, those without time get nothing.

    A subclass reads the columns ``reads`` and makes the columns ``adds``:
    ``load`` turns the stored value into whatever ``step`` works on, ``save``
    turns it back (null: nothing to keep), and ``ends`` tells when that will be so.
    """

    state_schema = "v double"
    reads: tuple[str, ...] = ()
    adds: tuple[StructField, ...] = ()
    timed = False

    def load(self, value: tuple | None):
        return None if value is None else value[0]

    def save(self, state) -> tuple | None:
        return None if state is None else (float(state),)

    def step(self, state, t: float, *values) -> tuple[object, tuple]:
        raise NotImplementedError

    def ends(self, state) -> float | None:
        return None

    def expired(self, state, now: float):
        """What is left of the state when time has come to ``now``."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def _store(self, state) -> None:
        value = self.save(state)
        if value is None:
            self.state.clear()
        else:
            self.state.update(value)
        if not self.timed:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if value is not None and (end := self.ends(state)) is not None and math.isfinite(end):
            self.handle.registerTimer(math.floor(end * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable", na_position="first")
        state, made = self.load(self.state.get() if self.state.exists() else None), []
        for t, *values in zip(*(data[c] for c in ("ts", *self.reads)), strict=True):
            if t is None or t != t:
                made.append((None,) * len(self.adds))
                continue
            state, told = self.step(state, float(t), *values)
            made.append(told)
        self._store(state)
        for i, field in enumerate(self.adds):
            data[field.name] = pd.Series([x[i] for x in made], index=data.index, dtype=object)
        yield data.drop(columns="_time", errors="ignore")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            left = self.expired(self.load(self.state.get()), expiredTimerInfo.getExpiryTimeInMs() / 1000)
            value = self.save(left) if left is not None else None
            if value is None:
                self.state.clear()
            else:
                self.state.update(value)
                end = self.ends(left)
                if end is not None and math.isfinite(end):
                    self.handle.registerTimer(math.floor(end * 1000) + 1)
        yield from ()

    def close(self) -> None:
        pass


class PrefixSeen(_Keyed):
    """Was the key sighted at most ``ttl`` seconds before?"""

    adds = (StructField("seen", BooleanType()),)

    def __init__(self, ttl: float):
        self.ttl = ttl

    def step(self, state, t):
        return t, (state is not None and t - state <= self.ttl,)

    def ends(self, state):
        return state + self.ttl


class SeenSet(_Keyed):
    """Was the digest sighted at most ``ttl`` seconds before?  A key (a tenant) remembers its ``most`` latest digests."""

    state_schema = "digests array<string>, at array<double>"
    reads = ("digest",)
    adds = (StructField("seen", BooleanType()),)

    def __init__(self, ttl: float, most: int):
        self.ttl, self.most = ttl, max(1, most)

    def load(self, value):
        return OrderedDict() if value is None else OrderedDict(zip(value[0], value[1], strict=True))

    def save(self, state):
        return (list(state), [float(x) for x in state.values()]) if state else None

    def step(self, state, t, digest):
        if digest is None or digest != digest:
            return state, (False,)
        last = state.pop(digest, None)
        state[digest] = t  # the latest sighting comes last
        while len(state) > self.most:
            state.popitem(last=False)
        return state, (last is not None and t - last <= self.ttl,)

    def ends(self, state):
        return next(iter(state.values())) + self.ttl

    def expired(self, state, now):
        while state and next(iter(state.values())) + self.ttl < now:
            state.popitem(last=False)
        return state


class ExactCache(_Keyed):
    """Replay of the exact cache: a miss stores for ``ttl`` seconds, a hit does not extend."""

    adds = (StructField("hit", BooleanType()),)

    def __init__(self, ttl: float):
        self.ttl = ttl

    def step(self, state, t):
        hit = state is not None and t < state + self.ttl
        return state if hit else t, (hit,)

    def ends(self, state):
        return state + self.ttl


class TokenBucket(_Keyed):
    """A bucket per key that starts full and refills at ``per_second``; full again, it is forgotten."""

    state_schema = "tokens double, updated double"
    adds = (StructField("allowed", BooleanType()), StructField("retry_after", DoubleType()))

    def __init__(self, capacity: float, per_second: float):
        self.capacity, self.rate = float(capacity), float(per_second)

    def load(self, value):
        return (self.capacity, None) if value is None else tuple(value)

    def save(self, state):
        return (float(state[0]), float(state[1])) if state[1] is not None else None

    def step(self, state, t):
        tokens, updated = state
        tokens = min(self.capacity, tokens + max(0.0, t - (t if updated is None else updated)) * self.rate)
        allowed = tokens >= 1.0
        wait = 0.0 if allowed or not self.rate else (1.0 - tokens) / self.rate
        return (tokens - allowed, t), (allowed, wait)

    def ends(self, state):
        return state[1] + (self.capacity - state[0]) / self.rate if self.rate else None


class SimilarCache(_Keyed):
    """The similarity cache of a scope: a ring of directions, first in, first out beyond ``most``.

    Slots of the ring are entries of a map, so an event that is remembered
    writes one slot, and what is pushed out is overwritten.
    """

    reads = ("entry", "vector")
    adds = (StructField("answered_by", StringType()), StructField("similarity", DoubleType()))

    def __init__(self, threshold: float, ttl: float, most: int):
        self.threshold, self.ttl, self.most = threshold, ttl, most

    def init(self, handle):
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "n long, at double, entry string, unit array<double>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        data = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable", na_position="first")
        ring, n = Ring(self.most), 0
        for _, (i, at, entry, unit) in sorted(((k, v) for k, v in self.slots.iterator()), key=lambda x: x[1][0]):
            ring.add((i, at, entry), np.array(unit, float))
            n = i + 1
        told = []
        for t, entry, vector in zip(data["ts"], data["entry"], data["vector"], strict=True):
            unit = None if t is None or t != t else Ring.direction(vector)
            found = None
            if unit is not None:
                while ring.entries and ring.entries[0][1] + self.ttl <= t:
                    self.slots.removeKey((ring.entries[0][0] % self.most,))
                    ring.drop()
                found = ring.nearest(unit, self.threshold)
                if not found and self.most > 0:
                    ring.add((n, float(t), entry), unit)
                    self.slots.updateValue((n % self.most,), (n, float(t), entry, unit.tolist()))
                    n += 1
            told.append((found[0][2], found[1]) if found else (None, None))
        self._timer(ring)
        for i, field in enumerate(self.adds):
            data[field.name] = pd.Series([x[i] for x in told], index=data.index, dtype=object)
        yield data.drop(columns="_time", errors="ignore")

    def _timer(self, ring: Ring) -> None:
        if self.timed:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if ring.entries and math.isfinite(ring.entries[0][1] + self.ttl):
                self.handle.registerTimer(math.floor((ring.entries[0][1] + self.ttl) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, left = expiredTimerInfo.getExpiryTimeInMs() / 1000, []
        for slot, (_, at, _, _) in list(self.slots.iterator()):
            if at + self.ttl <= now:
                self.slots.removeKey(slot)
            else:
                left.append(at + self.ttl)
        if left:
            self.handle.registerTimer(math.floor(min(left) * 1000) + 1)
        yield from ()


class Handles(_Keyed):
    """Paid context caches of one pool: reuse a live handle, create one, or refuse at ``max_live``."""

    state_schema = "names array<string>, handles array<string>, until array<double>"
    reads = ("event_id", "digest")
    adds = (StructField("handle", StringType()), StructField("action", StringType()))

    def __init__(self, ttl: float, max_live: int):
        self.ttl, self.max_live = ttl, max_live

    def load(self, value):
        return OrderedDict() if value is None else OrderedDict((k, (h, u)) for k, h, u in zip(*value, strict=True))

    def save(self, state):
        return (list(state), [h for h, _ in state.values()], [float(u) for _, u in state.values()]) if state else None

    def expired(self, state, now):
        while state and next(iter(state.values()))[1] <= now:  # made in order of time, so they lapse in it
            state.popitem(last=False)
        return state

    def step(self, state, t, event, digest):
        state = self.expired(state, t)
        if digest in state:
            return state, (state[digest][0], "reuse")
        if len(state) >= self.max_live:
            return state, (None, "refuse")
        state[digest] = (f"handle-{digest[:12]}-{event}", t + self.ttl)
        return state, (state[digest][0], "create")

    def ends(self, state):
        return next(iter(state.values()))[1]


def _keyed(events: DataFrame, processor: _Keyed, delay: str | None) -> DataFrame:
    schema = StructType([*events.schema.fields, *processor.adds])
    processor.timed = delay is not None
    if delay is not None:
        events = events.withColumn("_time", F.timestamp_millis(F.floor(F.col("ts") * 1000).cast("long"))).withWatermark("_time", delay)
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none" if delay is None else "eventTime")


def seen_within(events: DataFrame, ttl: float, delay: str | None = None) -> DataFrame:
    """Adds ``seen`` to events (key, ts, ...)."""
    return _keyed(events, PrefixSeen(ttl), delay)


def seen_set(events: DataFrame, ttl: float, most: int, delay: str | None = None) -> DataFrame:
    """Adds ``seen`` to events (key, ts, digest, ...): of each key the ``most`` latest digests are remembered."""
    return _keyed(events, SeenSet(ttl, most), delay)


def replay(events: DataFrame, ttl: float, delay: str | None = None) -> DataFrame:
    """Adds ``hit`` to events (key, ts, ...)."""
    return _keyed(events, ExactCache(ttl), delay)


def token_bucket(events: DataFrame, capacity: float, per_second: float, delay: str | None = None) -> DataFrame:
    """Adds allowed and retry_after to events (key, ts, ...)."""
    return _keyed(events, TokenBucket(capacity, per_second), delay)


def similar_replay(events: DataFrame, threshold: float, ttl: float, most: int, delay: str | None = None) -> DataFrame:
    """Adds answered_by and similarity to events (key, ts, entry: string, vector, ...)."""
    return _keyed(events, SimilarCache(threshold, ttl, most), delay)


def ensure_handles(asks: DataFrame, ttl: float, max_live: int, delay: str | None = None) -> DataFrame:
    """Adds handle and action to asks (key: pool, ts, event_id, digest, ...); the cap is a pool's."""
    return _keyed(asks, Handles(ttl, max_live), delay)


def running_totals(events: DataFrame) -> DataFrame:
    """Totals so far (update or complete mode)."""
    return events.groupBy().agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("cache") == "hit").alias("hits"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))


def running_epochs(bumps: DataFrame) -> DataFrame:
    return bumps.groupBy("tenant").agg(F.count(F.lit(1)).alias("epoch"))


#: The keyed sums from which all metric tables follow, by what they are kept for.
_SUMS = "part string, name string, requests bigint, hits bigint, similar bigint, tokens_before bigint, tokens_after bigint, checked bigint, held bigint"


def partial_sums(events: DataFrame) -> DataFrame:
    """Sums of a batch of events (cache, tenant, tokens_before, tokens_after, stages): over all, by tenant and by stage."""
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    own = [n.alias("requests"), F.count_if(F.col("cache") == "hit").alias("hits"), F.count_if(F.col("cache") == "similar").alias("similar"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), none.alias("checked"), none.alias("held")]
    whole = events.groupBy(F.lit("all").alias("part"), F.lit("").alias("name")).agg(*own)
    tenants = events.where(F.coalesce("tenant", F.lit("")) != "").groupBy(F.lit("tenant").alias("part"), F.col("tenant").alias("name")).agg(*own)
    staged = events.select(F.inline("stages")).groupBy(F.lit("stage").alias("part"), F.col("stage").alias("name"))
    stages = staged.agg(n.alias("requests"), none.alias("hits"), none.alias("similar"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.count("ok").alias("checked"), F.count_if("ok").alias("held"))
    return whole.unionByName(tenants).unionByName(stages)


def keep_sums(events: DataFrame, path: str):
    """A writer that keeps each micro-batch's sums under ``path`` by batch id: a batch that comes again replaces its own, so nothing counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_sums(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write)


def running_metrics(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``metrics.totals``, ``by_stage`` and ``by_tenant`` from the sums kept so far."""
    numbers = [f.split()[0] for f in _SUMS.split(", ")[2:]]
    sums = spark.read.schema(_SUMS).parquet(path).groupBy("part", "name").agg(*(F.sum(x).alias(x) for x in numbers))
    return metrics.from_sums(sums)


def fan_out(events: DataFrame, *sinks):
    """A writer that gives each micro-batch to all sinks in order (functions of a DataFrame)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch)
        batch.unpersist()

    return events.writeStream.foreachBatch(write)
