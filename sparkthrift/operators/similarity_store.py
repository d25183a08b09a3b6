"""The durable side of the similarity cache: sealed vectors in the order in which they were remembered.

An entry's vector is written as JSON and, with tenant keys, sealed and bound to its
cache key.  Loading takes the newest ``n`` entries first and then skips those that
can't be read: another shape, a changed value, or a tenant whose key is shredded.
So a broken entry takes up one of the ``n`` places, as it does in the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import caching, crypto


def encode(vector: Column) -> Column:
    """A vector as JSON text, in UTF-8."""
    return F.to_json(vector.cast("array<double>")).cast("binary")


def decode(blob: Column) -> Column:
    """The vector that JSON text holds; null unless it is a list of finite numbers."""
    made = F.from_json(blob.cast("string"), "array<double>", {"mode": "PERMISSIVE"})
    whole = blob.cast("string").rlike(r"\A\s*\[[^\[\]{}\"]*\]\s*\z") & F.forall(made, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), made)


def append(entries: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Rows as they are stored (seq, key, model, tenant, blob, created_at) from entries with a vector.

    ``keys`` (tenant, dek) seals the blobs; entries of tenants without a key are
    not stored then.
    """
    rows = entries.withColumn("blob", encode(F.col("vector"))).drop("vector")
    if keys is not None:
        rows = rows.join(keys, "tenant").withColumn("blob", crypto.seal(F.col("blob"), F.col("dek"), F.col("key").cast("binary"))).drop("dek")
    return rows.select("seq", "key", "model", "tenant", "blob", "created_at")


def trim(store: DataFrame, most: int) -> DataFrame:
    """What first in, first out leaves: the ``most`` newest entries."""
    return caching.newest(store, most)


def load(store: DataFrame, n: int, keys: DataFrame | None = None) -> DataFrame:
    """(place, seq, key, model, tenant, vector, created_at): the newest ``n`` entries that can be read, oldest first from place 1."""
    rows = caching.newest(store, n)
    if keys is not None:
        rows = rows.join(keys, "tenant", "left").withColumn("blob", crypto.open_sealed(F.col("blob"), [F.col("dek")], F.col("key").cast("binary"))).drop("dek")
    rows = rows.withColumn("vector", decode(F.col("blob"))).where(F.col("vector").isNotNull())
    return rows.select(F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"), "seq", "key", "model", "tenant", "vector", "created_at")  # at most n rows
