"""Exact and near-duplicate response caches over tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from sparkthrift.functions import terms as V


def latest(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key; aggregates combine before the shuffle."""
    rest = [c for c in writes.columns if c != key]
    last = writes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, *(F.col("_last")[c].alias(c) for c in rest))


def put(rows: DataFrame, now: str, ttl: float) -> DataFrame:
    """Rows as they are stored: with created_at and expires_at; none if the ttl is not positive."""
    stored = rows.withColumn("created_at", F.col(now)).withColumn("expires_at", F.col(now) + F.lit(float(ttl)))
    return stored if ttl > 0 else stored.limit(0)


def probe(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with ``hit``, status_code, content_type and body of an entry of their ``key`` that is stored by then and live."""
    stored = F.col("created_at") <= now if "created_at" in cache.columns else F.lit(True)
    live = requests.join(cache, "key", "left").withColumn("hit", F.coalesce((F.col("expires_at") > now) & stored, F.lit(False)))
    out = {c: F.when(F.col("hit"), F.col(c)) for c in ("status_code", "content_type", "body") if c in cache.columns}
    return live.withColumns(out)


def similar_response(probes: DataFrame, index: DataFrame, threshold: float, cache: DataFrame, now: Column) -> DataFrame:
    """probe_id, key, hit, ... : the response of the best similar entry; if that has expired the probe misses."""
    found = probes.select("probe_id").join(similar(probes, index, threshold), "probe_id", "left")
    return probe(found, cache, now)


def storable(status: Column, compacted: Column) -> Column:
    """Is an upstream response stored: only a success, and only of a request whose history was not compacted."""
    return F.coalesce((status >= 200) & (status < 300) & ~compacted, F.lit(False))


def _folded(events: DataFrame, order: tuple[str, ...], added: list[StructField], start: Callable[[], Callable[..., tuple]], reads: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns to events (key, ts, ...) by a fold over each key's rows in order of ts and ``order``.

    Rows are sorted inside hash partitions of the key and streamed through the
    fold, so a key of any size takes linear time and only the fold's own memory.
    A step gets ts and the columns ``reads``.  Rows without ts come to no step:
    they keep null in the added columns.
    """
    names, kinds, nothing = [f.name for f in added], [to_arrow_type(f.dataType) for f in added], (None,) * len(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            made = []
            for key, *values in zip(*(batch.column(x).to_pylist() for x in ("key", "ts", *reads)), strict=True):
                if step is None or key != last:
                    last, step = key, start()
                made.append(step(*values) if values[0] is not None else nothing)
            columns = [pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    rows = events.repartition("key").sortWithinPartitions("key", "ts", *order)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added]))


def replay(events: DataFrame, ttl: float, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``hit`` to events (key, ts): a miss stores, hits do not extend, t0 + ttl is a miss.

    Of rows of one key and time the first in ``order`` stores, and the others
    hit; a row without ts neither hits nor stores.  With a column ``stores``, a
    miss for which it isn't true stores nothing.
    """
    reads = ("stores",) if "stores" in events.columns else ()

    def start() -> Callable[..., tuple]:
        stored: float | None = None

        def step(t: float, stores: bool | None = True) -> tuple:
            nonlocal stored
            hit = stored is not None and t < stored + ttl
            stored = stored if hit else t if stores else None
            return (hit,)

        return step

    return _folded(events, order, [StructField("hit", BooleanType())], start, reads).withColumn("hit", F.coalesce("hit", F.lit(False)))


class Ring:
    """The newest ``most`` entries with their directions, oldest first; a search is one product with them."""

    def __init__(self, most: int):
        self.most, self.entries = most, deque()
        self.units, self.lo = np.empty((0, 0)), 0  # the entries' directions are units[lo : lo + len(entries)]

    @staticmethod
    def direction(vector: list[float] | None) -> np.ndarray | None:
        """Null for vectors that are null, zero, or hold null or non-finite components."""
        v = np.array([np.nan] if vector is None or not len(vector) else vector, float)
        size = float(np.sqrt((v * v).sum()))
        return v / size if np.isfinite(size) and size > 0.0 else None

    def nearest(self, unit: np.ndarray, threshold: float) -> tuple[object, float] | None:
        """The entry of the largest cosine at or over the threshold (ties: the latest)."""
        if not self.entries:
            return None
        if self.units.shape[1] != len(unit):
            raise ValueError("vectors of different lengths")
        close = self.units[self.lo : self.lo + len(self.entries)] @ unit
        best = len(close) - 1 - int(np.argmax(close[::-1]))
        return (self.entries[best], float(close[best])) if close[best] >= threshold else None

    def drop(self) -> None:
        self.entries.popleft()
        self.lo += 1

    def add(self, entry: object, unit: np.ndarray) -> None:
        if self.most <= 0:
            return
        if len(self.entries) == self.most:
            self.drop()
        end = self.lo + len(self.entries)
        if end == len(self.units) or self.units.shape[1] != len(unit):  # move to the front of a roomier array
            room = np.empty((2 * len(self.entries) + 16, len(unit)))
            if self.entries:
                room[: len(self.entries)] = self.units[self.lo : end]
            self.units, self.lo, end = room, 0, len(self.entries)
        self.units[end] = unit
        self.entries.append(entry)


def similar_replay(events: DataFrame, threshold: float, ttl: float, most: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``answered_by`` and ``similarity`` to events (key, ts, entry, vector): the similarity cache over time.

    ``key`` is the scope (model and tenant) in which entries are compared.  An
    event is answered by the live entry of the largest cosine at or over the
    threshold (ties: the later entry); one that is not answered becomes an
    entry, and beyond ``most`` the oldest entry of the scope goes.  Vectors that
    are null, zero, or hold null or non-finite components are neither answered
    nor remembered.  A scope is one fold, in time linear in its events.
    """

    def start() -> Callable[..., tuple]:
        ring = Ring(most)

        def step(t: float, entry: object, vector: list[float] | None) -> tuple:
            unit = Ring.direction(vector)
            if unit is None:
                return None, None
            while ring.entries and ring.entries[0][0] + ttl <= t:
                ring.drop()
            found = ring.nearest(unit, threshold)
            if found:
                return found[0][1], found[1]
            ring.add((t, entry), unit)
            return None, None

        return step

    kind = events.schema["entry"].dataType
    return _folded(events, order, [StructField("answered_by", kind), StructField("similarity", DoubleType())], start, ("entry", "vector"))


def answers(events: DataFrame, ttl: float, threshold: float, most: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``answer`` (hit, similar or miss) and ``answered_by`` to events (key, ts, entry, vector, stores): both caches over time.

    ``key`` is the scope (model and tenant), ``entry`` the exact key.  An exact
    live entry hits.  Else the nearest remembered key at or over the threshold
    answers, if its response is still live.  What misses is stored under its key
    and remembered, if ``stores``; remembered keys go first in, first out beyond
    ``most``.  A null entry misses and is not stored.  A scope is one fold.
    """

    def start() -> Callable[..., tuple]:
        ring, until, ends = Ring(most), {}, deque()

        def step(t: float, entry: str | None, vector: list[float] | None, stores: bool | None) -> tuple:
            while ends and ends[0][0] <= t:
                end, gone = ends.popleft()
                if until.get(gone) == end:
                    del until[gone]
            if entry is None:
                return "miss", None
            if entry in until:
                return "hit", entry
            unit = Ring.direction(vector)
            found = ring.nearest(unit, threshold) if unit is not None else None
            if found and found[0] in until:
                return "similar", found[0]
            if stores:
                until[entry] = t + ttl
                ends.append((t + ttl, entry))
                if unit is not None:
                    ring.add(entry, unit)
            return "miss", None

        return step

    told = _folded(events, order, [StructField("answer", StringType()), StructField("answered_by", StringType())], start, ("entry", "vector", "stores"))
    return told.withColumn("answer", F.coalesce("answer", F.lit("miss")))


def seen_within(sightings: DataFrame, ttl: float, keys: tuple[str, ...] = ("tenant", "digest"), ts: str = "ts", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``seen``: was the key sighted at most ``ttl`` before (every sighting refreshes)?  Equal times go by ``order``."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, *order))
    return sightings.withColumn("seen", F.coalesce(F.col(ts) - before <= ttl, F.lit(False)))


def newest(entries: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The newest ``n`` entries: a top-n, not a sort of all."""
    return entries.orderBy(F.desc(order)).limit(n)


def hydrate(entries: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """What a similarity cache starts with: of the newest ``n`` entries those whose vector decodes, oldest first (``place`` from 1)."""
    kept = newest(entries, n, order).where(F.col("vector").isNotNull())
    return kept.withColumn("place", F.row_number().over(Window.orderBy(order)))  # at most n rows


def similar(probes: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """probe_id, key, similarity: the best entry of the probe's model and tenant at or over the threshold.

    Ties go to the latest entry (seq).  The index is a first-in-first-out cache
    of a bounded number of entries (``newest``), which bounds the comparison.
    """
    same = F.col("p.model").eqNullSafe(F.col("i.model")) & F.col("p.tenant").eqNullSafe(F.col("i.tenant"))
    left, right = (df.withColumn("norm", V.norm(F.col("vector"))) for df in (probes, index))  # once a vector, not once a pair
    pairs = left.alias("p").join(right.alias("i"), same)
    scale = F.col("p.norm") * F.col("i.norm")
    close = F.when(scale == 0, 0.0).otherwise(V.dot(F.col("p.vector"), F.col("i.vector")) / scale)
    scored = pairs.select("p.probe_id", "i.key", "i.seq", close.alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("probe_id").agg(F.max(F.struct("similarity", "seq", "key")).alias("b"))
    return best.select("probe_id", F.col("b.key").alias("key"), F.col("b.similarity").alias("similarity"))


def token_bucket(events: DataFrame, capacity: float, per_second: float, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds allowed, retry_after to events (key, ts): a bucket that starts full.  Equal times go by ``order``.

    A row without ts drains nothing and is let through.
    """
    most, rate = float(capacity), float(per_second)

    def start() -> Callable[[float], tuple]:
        tokens, updated = most, None

        def step(t: float) -> tuple:
            nonlocal tokens, updated
            tokens = min(most, tokens + max(0.0, t - (t if updated is None else updated)) * rate)
            updated = t
            if tokens >= 1.0:
                tokens -= 1.0
                return True, 0.0
            return False, (1.0 - tokens) / rate if rate else 0.0

        return step

    told = _folded(events, order, [StructField("allowed", BooleanType()), StructField("retry_after", DoubleType())], start)
    return told.withColumns({"allowed": F.coalesce("allowed", F.lit(True)), "retry_after": F.coalesce("retry_after", F.lit(0.0))})


def epochs(bumps: DataFrame) -> DataFrame:
    """(tenant, epoch): the number of bumps; tenants without one have epoch 0 at the join."""
    return bumps.groupBy("tenant").agg(F.count(F.lit(1)).alias("epoch"))
