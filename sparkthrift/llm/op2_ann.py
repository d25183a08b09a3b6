"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are lengthened by one component so that all have one norm and the
largest inner product is the smallest angle.  Several rotations are learned
(iterative quantisation) on a bounded sample; the signs of the rotated
components are a vector's code.  Codes are cut into 16-bit substrings and each
substring is indexed.  A code within Hamming radius r of a query must, in at
least one of the m substrings, be within r // m of it (one less for the later
substrings: the sharpened pigeonhole rule), so probing those buckets finds
every code of the radius.  What is found is checked in full, and reranked by
inner products of the original vectors in double precision.  A query with
fewer than k codes in the radius probes larger ones until it has k.

The radius holds a fixed share of the true neighbours, among all rows, of a
bounded set of asked vectors, so it shrinks as the rows grow denser.

Every row is indexed.  Blocks of the index meet blocks of the queries; a task
holds one of each and emits k rows a query.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without vec_id; vectors are searched among
those of their own width, width by width; rows without candidates give no rows; rows that share a query's vec_id are not its candidates; repeated query
rows are answered once; ties go to the smaller vec_id; fewer than k candidates
are all returned; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, union_all

#: Vectors that the rotations are learned on, at most, and those of them whose true neighbours set the radius.
SAMPLE, ASKS = 8_000, 200
ROTATIONS = 4
#: Vectors of an index block and of a query block.
INDEX_ROWS, QUERY_ROWS = 16_384, 4_096
#: Share of these true neighbours that the radius must hold.
HELD = 0.97
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def learn_rotations(x: np.ndarray, rotations: int = ROTATIONS, rounds: int = 25) -> np.ndarray:
    """Columns of ``rotations`` orthogonal matrices that bring the vectors near to their signs."""
    out = []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return np.concatenate(out, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """16-bit substrings of the codes; bits that fill up the last substring are 0."""
    bits = np.packbits(x @ rotation > 0, axis=1)
    if bits.shape[1] % 2:
        bits = np.pad(bits, ((0, 0), (0, 1)))
    return np.ascontiguousarray(bits).view("<u2")


def distances(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _ONES[a ^ q].sum(axis=1, dtype=np.int64)


class Index:
    """Buckets of each substring: its values, and the codes that have them."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.tables = []
        for j in range(code.shape[1]):
            order = np.argsort(code[:, j], kind="stable")
            values, counts = np.unique(code[:, j], return_counts=True)
            self.tables.append((values, counts, order))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """All codes within ``radius`` of ``q``, by pigeonhole probing."""
        m = len(self.tables)
        each, more = divmod(radius, m)
        hit = np.zeros(len(self.code), bool)
        for j, (values, counts, order) in enumerate(self.tables):
            near = _ONES[values ^ q[j]] <= (each if j <= more else each - 1)
            if near.any():
                hit[order[np.repeat(near, counts)]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.code[found], q) <= radius]


def nearest_distances(rows: DataFrame, ids: np.ndarray, asks: np.ndarray, index_codes: Callable[[np.ndarray], np.ndarray], query_codes: np.ndarray, k: int) -> DataFrame:
    """(ask, score, distance): code distances of the ``k`` true neighbours of a bounded set of asked vectors among all rows.

    Each partition keeps ``k`` rows an ask while it streams, so what is shuffled
    does not depend on the rows.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, apart = np.full((k, len(asks)), -np.inf), np.zeros((k, len(asks)), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 4_096):
                part = batch.iloc[lo : lo + 4_096]
                v = np.array(part["v"].tolist(), float)
                if not len(v):
                    continue
                near = v @ asks.T
                near[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-near, axis=0, kind="stable")[:k]
                code = index_codes(v)
                far = np.stack([distances(code[t], q) for t, q in zip(top.T, query_codes, strict=True)], axis=1)
                score = np.concatenate((score, np.take_along_axis(near, top, 0)))
                apart = np.concatenate((apart, far))
                keep = np.argsort(-score, axis=0, kind="stable")[:k]
                score, apart = np.take_along_axis(score, keep, 0), np.take_along_axis(apart, keep, 0)
        at, ask = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"ask": ask, "score": score[at, ask], "distance": apart[at, ask]})

    some = rows.select("vec_id", "v").mapInPandas(best, "ask int, score double, distance int")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "distance"))
    return some.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, sample: int = SAMPLE, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest of each row whose vec_id is divisible by ``every``."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    rows = rows.where(_usable(F.col("v"))).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stage(rows.withColumn("width", F.size("v")), "vectors")
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).orderBy("width").collect()
    if not widths:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    return union_all([_nearest(rows.where(F.col("width") == w["width"]), w["n"], w["most"], k, every, sample, index_rows, query_rows) for w in widths])


def _nearest(rows: DataFrame, n: int, most: float, k: int, every: int, sample: int, index_rows: int, query_rows: int) -> DataFrame:
    """The same for staged rows of one width."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = f"query_id {kind}, vec_id {kind}, score double"
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()

    def lengthen(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(most - (v * v).sum(1), 0.0)) / math.sqrt(most)
        return np.concatenate((v / math.sqrt(most), rest[:, None]), axis=1)

    def query_codes(v: np.ndarray) -> np.ndarray:
        return codes(np.concatenate((v / math.sqrt(most), np.zeros((len(v), 1))), axis=1), rotation)

    def index_codes(v: np.ndarray) -> np.ndarray:
        return codes(lengthen(v), rotation)

    seen = np.array(fit["v"].tolist(), float)
    rotation = learn_rotations(lengthen(seen))
    asks = seen[:ASKS]
    found = nearest_distances(rows, fit["vec_id"].to_numpy()[:ASKS], asks, index_codes, query_codes(asks), k)
    held = found.agg(F.percentile("distance", F.lit(HELD))).first()[0]
    radius = math.ceil(held) if held is not None else 16 * query_codes(asks).shape[1]
    blocks = max(24, math.ceil(n / index_rows))
    asked = max(1, math.ceil(n / every / query_rows))
    spread = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks).cast("long")).alias("b"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(asked).cast("long")).alias("q"))
    queries = spread.where(F.col("vec_id") % every == 0).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    index = spread.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            v, ids = np.array(left["v"].tolist(), float), left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            v, ids = v[order], ids[order]
            table_of = Index(index_codes(v))
            right = right.drop_duplicates("vec_id")
            asks = np.array(right["v"].tolist(), float)
            for name, ask, c in zip(right["vec_id"], asks, query_codes(asks), strict=True):
                r, others = radius, int((ids != name).sum())
                while True:
                    at = table_of.within(c, r)
                    at = at[ids[at] != name]
                    if len(at) >= min(k, others) or r >= 16 * len(c):
                        break
                    r = min(16 * len(c), r + max(1, len(c) // 2))
                score = (v[at] * ask).sum(axis=1)
                best = np.argsort(-score, kind="stable")[:k]
                found.append(pd.DataFrame({"query_id": name, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    some = index.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInPandas(search, out)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
