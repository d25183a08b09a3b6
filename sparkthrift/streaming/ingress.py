"""Requests as a stream: what the lifecycle does row by row, and the exact cache as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkthrift.plans import lifecycle
from sparkthrift.plans.config import Config

from . import state

REQUESTS = "request_id long, ts double, path string, headers array<struct<k string, v string>>, body string"


def requests(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """A stream of request lines (JSON) that arrive as files below ``path``; ``files`` of them a batch at most."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files).json(path)


def outcomes(rows: DataFrame, config: Config, delay: str | None = None) -> DataFrame:
    """A row per request of a stream: request_id, ts, dialect, tenant, status, cache, tokens_before, tokens_after, memory, stages.

    Equal to the batch's on input in order of ts within a cache key.  Limits,
    breakpoints, the similarity cache and memory by retrieval look across keys:
    they are for the batch.
    """
    if config.rate or config.inject or config.similarity or config.memory == "retrieval":
        raise ValueError("limits, breakpoints, similarity and retrieval are not for this stream")
    narrow = lifecycle.narrowed(rows, config)
    early = F.when(F.col("provider").isNull(), 502).when(~F.col("authorized"), 401)
    narrow = narrow.withColumns({"status": early, "cache_key": F.when(early.isNull(), F.col("cache_key")), "told": F.to_json("stages")})
    keyed = narrow.select("request_id", "ts", "dialect", "provider", "tenant", "status", "cache_key", "streamed", "tokens_before", "tokens_after", "memory", "told", lifecycle._alone(F.col("cache_key")).alias("key"))
    seen = state.replay(keyed, config.ttl, delay)
    cache = F.when(F.col("status").isNotNull(), "none").when(F.col("cache_key").isNull(), F.when(F.col("streamed"), "stream-bypass").otherwise("bypass")).when(F.col("hit"), "hit").otherwise("miss")
    dialect = F.when(F.col("provider").isNull(), "unknown").otherwise(F.col("dialect"))
    return seen.select("request_id", "ts", dialect.alias("dialect"), "tenant", F.coalesce("status", F.lit(200)).alias("status"), cache.alias("cache"), "tokens_before", "tokens_after", "memory", F.from_json("told", f"array<{lifecycle._STAGE}>").alias("stages"))
