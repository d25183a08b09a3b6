"""Neighbours by cosine against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkthrift.operators import memory
from sparkthrift.plans import memory_queries


def brute(asked, rows, k):
    ids = [i for i, _ in rows]
    unit = [np.array([v for _, v in x], float) for x in (asked, rows)]
    unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in unit]
    out = []
    for (q, _), scores in zip(asked, (unit[0] @ unit[1].T).round(9).tolist(), strict=True):
        best = sorted(zip((-s for s in scores), ids, strict=True))[:k]
        out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(best) if s < 0]
    return out


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)] + [(3000, [0.0] * 8)]
    odd = [(4000, None), (4001, [None] + [1.0] * 7), (4002, [float("nan")] * 8)]
    frame = spark.createDataFrame(rows + odd, "id long, vector array<double>").withColumn("seq", F.col("id"))
    asked = frame.select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"))
    got = memory.semantic(asked, frame, 5, block_rows=200).collect()
    found = sorted((r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in got)
    want = sorted(brute(rows, rows, 5))
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in want], abs=1e-8)


def test_every_row_is_asked(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = memory_queries.semantic_topk(spark, sf_dir).collect()
    assert {r["query_id"] for r in got} == {i for i, _ in rows}
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == sorted(x[:3] for x in brute(rows, rows, 10))
