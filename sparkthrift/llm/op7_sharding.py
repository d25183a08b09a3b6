"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group (all rows of one text) is placed whole.  Its vector is its share of all
bytes, tokens and rows.  Largest first, each group goes to the shard with room
for its bytes where the dot product of its vector with the residual capacity is
highest, so sizes come out near equal, and tokens and rows with them.

Groups that hold more than 1 / (shards * parts) of any of the three are placed
first, on the driver; there are at most 3 * shards * parts of them.  The others
are dealt by hash into bins of about ``bin_groups``; each bin places its own
groups, largest first, into its share of what room the heavy ones left in every
shard.  A bin's shards come out even up to its smallest groups, so the sum does.
Rows find their group's shard by a join that shuffles: groups grow with the input.

Defined cases: null text has size 1 and is grouped with other null texts; an empty text also has size 1; repeated
rows are one group; a group larger than a shard fills its shard alone, as far
as others fit elsewhere; a null doc_id is a row like others; extra columns are
ignored; no rows give no rows.  Tokens are words.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, gapless, stage, table

#: Items that a shard's mean is made of, about.
PARTS = 256
#: Groups of a bin, about; a bin is placed by one task.
BIN_GROUPS = 50_000


def place(items: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows), largest first; ``room``, a row a shard, becomes what is left.

    Of the shards that still have room for the item's bytes, the one with the
    highest dot product; without such a shard, the one with the most room.
    """
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.sum(1), -items.max(1))):
        fits = room[:, 0] >= items[i, 0]
        out[i] = int(np.argmax(np.where(fits, room @ items[i], -np.inf) if fits.any() else room[:, 0]))
        room[out[i]] -= items[i]
    return out


def _fill(total: list[int], room: np.ndarray):
    """Places a bin's groups into its share of ``room``."""
    share = room / room.sum(axis=0, where=room > 0, initial=1e-300)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("group", kind="stable")
        items = group[["bytes", "tokens", "rows"]].to_numpy(float) / total
        return pd.DataFrame({"group": group["group"], "light": place(items, np.maximum(share, 0) * items.sum(0))})

    return run


def shard(docs: DataFrame, *, shards: int = 8, parts: int = PARTS, bin_groups: int = BIN_GROUPS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), text), 256)).alias("group"),
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = stage(rows.groupBy("group").agg(*sums), "groups")
    count, *all_of = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    total = [max(1, x or 0) for x in all_of]
    least = shards * parts
    heavy = (F.col("bytes") * least > total[0]) | (F.col("tokens") * least > total[1]) | (F.col("rows") * least > total[2])
    alone = groups.where(heavy).orderBy("group").collect()  # at most 3 * shards * parts, as each holds more than 1 / least of a sum
    room = np.full((shards, 3), 1.0 / shards)
    items = np.array([[r[x] / t for x, t in zip(("bytes", "tokens", "rows"), total, strict=True)] for r in alone], float).reshape(-1, 3)
    placed = place(items, room).tolist()
    of_group = spark.createDataFrame([(bytes(r["group"]), p) for r, p in zip(alone, placed, strict=True)], "group binary, alone int")
    bins = max(1, math.ceil(count / bin_groups))
    light = groups.where(~heavy).withColumn("bin", F.pmod(F.xxhash64("group", F.lit(5)), F.lit(bins)))
    light = stage(light.groupBy("bin").applyInPandas(_fill(total, room), "group binary, light int"), "light")
    put = rows.join(F.broadcast(of_group), "group", "left").join(light, "group", "left")
    put = stage(put.select("row", "doc_id", "size", "text_crc32", F.coalesce("alone", "light").alias("shard")), "placed")
    out = gapless(put, "shard", "row", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
