"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few numbers or short strings) that a broadcast side may have; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: A word, in Java's and RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"


_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """A folder in the one that all executors share, spark.checkpoint.dir; a local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stage-{spark.sparkContext.applicationId}{_scope.get()}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: the lineage ends
    here and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[str]:
    """Tables staged inside get a folder of their own, whose name ``release`` takes."""
    own = f"-{name}-{uuid.uuid4().hex}"
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession, own: str = "") -> None:
    """Removes the staged tables of a scope (or those of no scope).  Call it only when every result built on them has been written."""
    token = _scope.set(own)
    try:
        remove(spark, shared_dir(spark))
    finally:
        _scope.reset(token)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows and their bytes
    (eight a value, and those of strings) allow it; beyond the bounds the join
    shuffles, with the same result."""
    wide = [F.octet_length(f.name) for f in small.schema if f.dataType.typeName() in ("string", "binary")]
    each = reduce(Column.__add__, [F.coalesce(x, F.lit(0)) for x in wide], F.lit(8 * len(small.columns)))
    n, held = small.agg(F.count(F.lit(1)), F.sum(each)).first()
    return F.broadcast(small) if n <= rows and (held or 0) <= size else small


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lost(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text mod 5 is 0: the rows held out of learning (a null id hashes as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def gapless(df: DataFrame, key: str, row: str, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each ``key``, without one task per key.

    ``df`` must be staged and ``row`` unique in it.  Rows are ranked inside
    (key, block of at most 2**16 row numbers); block counts give the offsets.
    """
    from pyspark.sql import Window

    blocked = df.withColumn("_block", F.shiftright(row, 16))
    inner = Window.partitionBy(key, "_block").orderBy(row)
    counts = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    offsets = bounded(stage(offsets, "offsets"))
    ranked = blocked.withColumn("_rank", F.row_number().over(inner) - 1)
    joined = ranked.join(offsets, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_block") == F.col("_at")))
    return joined.withColumn(out, (F.col("_base") + F.col("_rank")).cast("long")).drop("_block", "_rank", "_key", "_at", "_base")
