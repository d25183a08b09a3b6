"""Exact dedup by exchange of Golomb-coded fingerprints.

1. A partition cuts its rows into blocks.  A block sends each owner of a hash
   range its sorted distinct fingerprints as Golomb-Rice coded gaps, with a
   bitmap of those it has several times itself.  Messages are written once.
2. An owner merges its messages and answers each block with a bitmap: which of
   your fingerprints are duplicates anywhere?
3. Message and answer together name the suspects' fingerprints.  Only suspects'
   texts are shuffled, and grouped by their bytes; partial aggregates combine
   copies before the shuffle, so a text that fills a third of all rows costs
   one row a task.  Everything else is unique already.

Suspects' fingerprints are broadcast to the texts if they are few enough
(``BROADCAST_ROWS``); beyond that the join shuffles, with the same result.

Defined cases: null text counts as empty, and empty texts are equal; of equal
texts the row with the largest doc_id stays (rows without doc_id only if no row
has one); of rows that also share that doc_id exactly one stays; extra columns
are carried by ``deduplicate``, whatever their names, and ignored by the report;
no rows give no rows.  Groups are made of the bytes; the report then finds its
rows' groups by 48 + 256 + 64 hashed bits.  Calling either runs the exchange; the
last join is left to the caller.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stage, table, text_or_empty

#: Rows of a block; an owner's fingerprints, about.
BLOCK_ROWS = 1 << 16
OWNER_ROWS = 500_000
#: Bits of a fingerprint: a false suspect costs a shuffled text, never a wrong result.
BITS = 48


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct integers of [0, span) as Rice-coded gaps: count, parameter, unary parts, rests."""
    n = len(values)
    if not n:
        return np.array([0, 0], "<u4").tobytes()
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, math.floor(math.log2(max(1.0, 0.69 * span / n))))
    unary = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(unary + 1) - 1
    bits = np.zeros(int(stops[-1]) + 1, np.uint8)
    bits[stops] = 1
    rests = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([n, k], "<u4").tobytes() + np.uint64(len(bits)).tobytes() + np.packbits(bits).tobytes() + np.packbits(rests.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, k = np.frombuffer(data, "<u4", 2).tolist()
    if not n:
        return np.empty(0, np.uint64)
    length = int(np.frombuffer(data, "<u8", 1, 8)[0])
    raw = np.frombuffer(data, np.uint8, offset=16)
    cut = -(-length // 8)
    stops = np.flatnonzero(np.unpackbits(raw[:cut], count=length))
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(k)
    if k:
        rests = np.unpackbits(raw[cut:], count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= rests @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)


_MESSAGE = ["owner", "block", "prints", "own"]


def _send(owners: int, block_rows: int):
    span = -(-(1 << BITS) // owners)

    def message(values: np.ndarray, block: int) -> pa.RecordBatch:
        prints, counts = np.unique(values, return_counts=True)
        owner = (prints // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            o = int(owner[a])
            rows.append((o, block, golomb_encode(prints[a:b] - np.uint64(o * span), span), np.packbits(counts[a:b] > 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _MESSAGE)

    def run(batches):
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for lo in range(0, len(values), block_rows):
                held.append(values[lo : lo + block_rows])
                n += len(held[-1])
                if n >= block_rows:
                    yield message(np.concatenate(held), block)
                    block, held, n = block + 1, [], 0
        if n:
            yield message(np.concatenate(held), block)

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: fingerprints that another block has too, or their own block twice."""
    parts = [golomb_decode(x) for x in group["prints"]]
    everything = np.concatenate(parts)
    values, counts = np.unique(everything, return_counts=True)
    several = values[counts > 1]
    made = []
    for part, own in zip(parts, group["own"], strict=True):
        mine = np.unpackbits(np.frombuffer(own, np.uint8), count=len(part)).astype(bool)
        made.append(np.packbits(mine | np.isin(part, several, assume_unique=True)).tobytes())
    return pd.DataFrame({"owner": group["owner"], "block": group["block"], "bitmap": made})


def _suspects(owners: int):
    span = -(-(1 << BITS) // owners)

    def run(batches):
        for batch in batches:
            for owner, prints, bitmap in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = golomb_decode(prints)
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array((values[hit] + np.uint64(owner * span)).astype(np.int64))], ["print"])

    return run


def fingerprint(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def suspect_prints(docs: DataFrame, *, block_rows: int = BLOCK_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """(print): fingerprints that more than one row of ``docs`` has, staged."""
    prints = stage(docs.select(fingerprint(text_or_empty()).alias("print")), "prints")
    owners = max(64, math.ceil(prints.count() / owner_rows))
    sent = stage(prints.mapInArrow(_send(owners, block_rows), "owner long, block long, prints binary, own binary"), "messages")
    answers = sent.groupBy("owner").applyInPandas(_answer, "owner long, block long, bitmap binary")
    told = sent.join(answers, ["owner", "block"]).select("owner", "prints", "bitmap")
    return stage(told.mapInArrow(_suspects(owners), "print long").distinct(), "suspects")


def exact_groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row."""
    text = text_or_empty()
    suspects = bounded(suspect_prints(docs, **sizes)).withColumn("suspect", F.lit(True))
    rows = docs.select("doc_id", text.alias("text"), fingerprint(text).alias("print"), F.sha2(text, 256).alias("text_sha256")).join(suspects, "print", "left")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows.select("row", "doc_id", "print", "text_sha256", "suspect", F.when(F.col("suspect"), F.col("text")).alias("text")), "rows")
    # the bytes decide: rows of one print and hash but different texts fall into different groups
    groups = rows.where("suspect").groupBy("print", "text_sha256", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("row", F.struct("doc_id", "row")).alias("keep_row"))
    groups = stage(groups.select("print", "text_sha256", F.xxhash64("text", F.lit("|")).alias("more"), "group_size", "keep_id", "keep_row").where("group_size > 1"), "groups")
    mine = rows.select("row", "doc_id", "print", "text_sha256", F.xxhash64("text", F.lit("|")).alias("more"))
    out = mine.join(bounded(groups), ["print", "text_sha256", "more"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )


def deduplicate(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (carried as one struct, so any names will do)."""
    suspects = bounded(suspect_prints(docs, **sizes))
    printed = docs.select(F.struct("*").alias("row"), "doc_id", fingerprint(text_or_empty()).alias("print"))
    alone = printed.join(suspects, "print", "left_anti").select("row.*")
    doubted = stage(printed.join(suspects, "print", "left_semi").withColumn("place", F.monotonically_increasing_id()), "doubted")
    text = F.coalesce("row.text", F.lit(""))
    best = doubted.groupBy("print", F.sha2(text, 256).alias("hash"), text.alias("text")).agg(F.max_by("place", F.struct("doc_id", "place")).alias("place"))
    stays = bounded(stage(best.select("place"), "stays"))
    return alone.unionByName(doubted.join(stays, "place", "left_semi").select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


OP10_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS rank FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, rank = 1 AS kept, sha256(text) AS text_sha256
FROM t
"""
