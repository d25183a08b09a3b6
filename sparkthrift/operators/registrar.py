"""Lifecycle of paid context caches: reuse, expiry, and a cap on live handles.

The cap makes decisions depend on all earlier ones, but only where it can be
reached.  Without it each key is a fold of its own.  Time is cut into spans of one
lifetime: what is live in a span was created in it or in the span before, so if
those creations, counted without the cap, are no more than the cap, it wasn't
reached there.  An empty span ends all handles, so what follows it does not depend
on what came before.  Such runs of spans are folded by key, in parallel, up to the
first span in which the cap might be reached; the rest of that run alone is one
ordered fold, which starts with the handles that are live then.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .caching import _folded


def _each_key(asks: DataFrame, ttl: float) -> DataFrame:
    """Adds ``made_by``: the event that created the handle which answers, were there no cap."""

    def start() -> Callable[..., tuple]:
        until, by = float("-inf"), None

        def step(t: float, event: object) -> tuple:
            nonlocal until, by
            if t >= until:
                until, by = t + ttl, event
            return (by,)

        return step

    return _folded(asks, ("event_id",), [StructField("made_by", asks.schema["event_id"].dataType)], start, ("event_id",))


def _capped(asks: DataFrame, ttl: float, max_live: int) -> DataFrame:
    """Adds ``by`` and ``what`` to asks (key: run, ts, event_id, name, seed) in order of time; seeds are live handles to start with."""

    def start() -> Callable[..., tuple]:
        live: OrderedDict[str, tuple[float, object]] = OrderedDict()  # made in order of time, so they lapse in it

        def step(t: float, event: object, name: str, seed: bool) -> tuple:
            while live and next(iter(live.values()))[0] <= t:
                live.popitem(last=False)
            if not seed and name in live:
                return live[name][1], "reuse"
            if not seed and len(live) >= max_live:
                return None, "refuse"
            live[name] = (t + ttl, event)
            return event, "create"

        return step

    added = [StructField("by", asks.schema["event_id"].dataType), StructField("what", StringType())]
    return _folded(asks, ("event_id",), added, start, ("event_id", "name", "seed"))


def ensure(asks: DataFrame, ttl: float, max_live: int) -> DataFrame:
    """(event_id, handle, action): asks (event_id, ts, credential, model, prefix) in order of ts, event_id.

    ``reuse`` a live handle, ``create`` one, or ``refuse`` at the cap (null
    handle).  An ask without ts is refused.
    """
    digest = F.concat_ws("/", F.sha2(F.coalesce("credential", F.lit("")), 256), F.coalesce("model", F.lit("")), F.sha2(F.coalesce("prefix", F.lit("")), 256))
    span = F.floor(F.col("ts") / ttl).cast("long")
    free = _each_key(asks.select("event_id", F.col("ts").cast("double").alias("ts"), F.sha2(digest, 256).alias("key")), ttl).withColumn("span", span)
    created = F.col("made_by") == F.col("event_id")
    # one row a span of time in which anything is asked
    spans = free.where("ts is not null").groupBy("span").agg(F.count_if(created).alias("made"))
    order = Window.orderBy("span")
    last, before = F.lag("span").over(order), F.lag("made").over(order)
    spans = spans.withColumns({"begins": F.coalesce(last < F.col("span") - 1, F.lit(True)).cast("long"), "most": F.col("made") + F.when(last == F.col("span") - 1, before).otherwise(0)})
    spans = spans.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.min(F.when(F.col("most") > max_live, F.col("span"))).over(Window.partitionBy("run"))
    spans = spans.select(F.col("span").alias("at"), "run", full.alias("full"))
    rows = free.join(spans, F.col("span") == F.col("at"), "left").drop("at")

    open_ = F.col("ts").isNull() | F.col("full").isNull() | (F.col("span") < F.col("full"))
    easy = rows.where(open_).select("event_id", "key", F.col("made_by").alias("by"), F.when(F.col("ts").isNull(), "refuse").when(created, "create").otherwise("reuse").alias("what"))
    seeds = rows.where(created & (F.col("span") == F.col("full") - 1)).withColumn("seed", F.lit(True))
    rest = rows.where(~open_).withColumn("seed", F.lit(False)).unionByName(seeds)
    rest = _capped(rest.select(F.col("run").alias("key"), "ts", "event_id", F.col("key").alias("name"), "seed"), ttl, max_live)
    hard = rest.where("not seed").select("event_id", F.col("name").alias("key"), "by", "what")
    handle = F.concat(F.lit("handle-"), F.substring("key", 1, 12), F.lit("-"), F.col("by").cast("string"))
    return easy.unionByName(hard).select("event_id", handle.alias("handle"), F.col("what").alias("action"))
