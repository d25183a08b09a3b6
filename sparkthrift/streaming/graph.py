"""The retrieval memory of tenants, fed by a stream.

Each micro-batch writes its nodes and edges under its batch id and replaces what an
earlier run of the same batch wrote, so a replayed batch changes nothing.  Reading
folds the batches: a text is one node of its tenant, first seen where it first came.
A request's messages come in one batch, as one request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkthrift.functions import terms as V
from sparkthrift.operators import memory

_NODES = "tenant string, id string, kind string, text string, ts double, request_id long, msg_idx long, batch long"
_EDGES = "tenant string, request_id long, src string, dst string, batch long"


def remember(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes the nodes and edges of messages (tenant, request_id, ts, msg_idx, role, text)."""
    rows = batch.select("tenant", F.col("request_id").cast("long").alias("request_id"), F.col("ts").cast("double").alias("ts"), F.col("msg_idx").cast("long").alias("msg_idx"), "role", "text")
    turns = memory._turns(rows)
    first = turns.groupBy("tenant", "id").agg(F.min(F.struct("ts", "request_id", "msg_idx")).alias("at"), F.first("kind").alias("kind"), F.first("text").alias("text"))
    first.select("tenant", "id", "kind", "text", "at.*").write.mode("overwrite").parquet(f"{path}/nodes/batch={batch_id}")
    edges = memory.follows(rows).join(rows.select("request_id", "tenant").distinct(), "request_id")
    edges.select("tenant", "request_id", "src", "dst").write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")


def ingest(messages: DataFrame, path: str):
    """A writer of a stream of messages into the memory at ``path``."""
    return messages.writeStream.foreachBatch(lambda batch, batch_id: remember(batch, batch_id, path))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, id, kind, text, terms, ts, request_id, msg_idx): each node once, where it first came."""
    rows = spark.read.schema(_NODES).parquet(f"{path}/nodes")
    found = rows.groupBy("tenant", "id").agg(F.min(F.struct("ts", "request_id", "msg_idx")).alias("at"), F.first("kind").alias("kind"), F.first("text").alias("text"))
    return found.select("tenant", "id", "kind", "text", F.array_sort(V.terms(F.col("text"))).alias("terms"), "at.*")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(tenant, request_id, src, dst): a multiset."""
    return spark.read.schema(_EDGES).parquet(f"{path}/edges").drop("batch")
