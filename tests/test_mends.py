"""Exact rounding, rows without time, capped hydration, one path of retrieval, the entry guard."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkthrift.operators import caching, memory, metrics


def test_rounding_equals_exact_binary_rounding(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-50, 4000), rng.randint(1, 4000)) for _ in range(60_000)]
    pairs += [(k, n) for n in (2, 4, 8, 16, 32, 64, 128, 1024, 1 << 20) for k in range(-40, 400)] + [(k, 20_000) for k in range(-200, 20_000)] + [(0, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long").select(F.col("a") / F.col("b").cast("double")).toDF("x")
    got = frame.select("x", metrics.rounded(F.col("x"), 4).alias("r"), metrics.rounded(F.col("x"), 2).alias("q")).toPandas()
    assert got["r"].tolist() == [round(x, 4) for x in got["x"]] and got["q"].tolist() == [round(x, 2) for x in got["x"]]
    assert spark.range(1).select(metrics.rounded(F.lit(None).cast("double"), 4).alias("n")).first()["n"] is None


def test_rows_without_time_stay(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 1.0, 2), ("a", 2.0, 3), (None, None, 4)], "key string, ts double, id long")
    assert {r["id"]: r["hit"] for r in caching.replay(rows, 10.0).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert {r["id"]: r["allowed"] for r in caching.token_bucket(rows, 1, 0.01).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_hydration_caps_before_it_decodes(spark):
    rows = spark.createDataFrame([(i, i, None if i == 3 else [1.0]) for i in range(1, 5)], "key long, seq long, vector array<double>")
    assert [r["key"] for r in caching.hydrate(rows, 3).orderBy("place").collect()] == [2, 4]


@pytest.mark.parametrize("asked", [1, 1100])
def test_retrieval_is_the_same_for_few_and_many_queries(spark, asked):
    rows = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [1.0, 0.11]), (2, 2, [float("nan"), 0.0])], "id long, seq long, vector array<double>")
    queries = spark.range(asked).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("qvector"))
    got = [(r["id"], round(r["score"], 3)) for r in memory.semantic(queries, rows, 2).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 0.994)]


def test_entry_imports_without_what_the_other_operators_need():
    code = "import sys; sys.modules['numpy.absent'] = None; import builtins; real = builtins.__import__\n"
    code += "def fake(name, *a, **b):\n    if name == 'ahocorasick': raise ImportError(name)\n    return real(name, *a, **b)\n"
    code += "builtins.__import__ = fake\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    assert int(out.stdout) >= 85, out.stderr


def test_similarity_store(spark):
    """A cap counts what can't be read; a restart reads what was written; shredded, changed and malformed entries are skipped."""
    from sparkthrift.operators import crypto
    from sparkthrift.operators import similarity_store as S

    rows = spark.createDataFrame([(i, f"k{i}", None if i == 1 else "m", f"t{i % 2}", [float(i), 0.1], 1.0 * i) for i in range(1, 7)], "seq long, key string, model string, tenant string, vector array<double>, created_at double")
    assert [(r["place"], r["seq"], r["model"], list(r["vector"])) for r in S.load(S.append(rows), 9).orderBy("place").collect()][0] == (1, 1, None, [1.0, 0.1])
    keys = crypto.tenant_keys(rows, bytes(range(32)))
    stored = S.append(rows, keys)
    assert not any(b"[" in bytes(r["blob"])[:1] for r in stored.collect())
    assert [r["seq"] for r in S.load(stored, 3, keys).orderBy("place").collect()] == [4, 5, 6]
    assert [r["seq"] for r in S.load(stored, 3, keys.where("tenant = 't0'")).orderBy("place").collect()] == [4, 6]
    moved = stored.withColumn("key", F.when(F.col("seq") == 5, "k4").otherwise(F.col("key")))  # a blob under another key does not open
    assert [r["seq"] for r in S.load(moved, 3, keys).orderBy("place").collect()] == [4, 6]
    bad = spark.createDataFrame([(i, "k", "m", "t", bytearray(x), 0.0) for i, x in enumerate([b"[1.0,2]", b"nope", b'["x"]', b"{}", b"[1,null]", b"\xff", b"[]", b"[1", b""])], "seq long, key string, model string, tenant string, blob binary, created_at double")
    assert [r["seq"] for r in S.load(bad, 99).orderBy("place").collect()] == [0, 6]
    assert S.trim(bad, 2).count() == 2 and S.load(bad.limit(0), 3).count() == 0


def test_alignment(spark):
    from sparkthrift.functions import text as T

    cases = [("a b a c", "a c", [0, 3]), ("a b", "a b", [0, 1]), ("a", "", []), ("", "", []), ("a b", "b a", [1, None]), ("x x y", "x y", [0, 2])]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(T.alignment(F.col("a"), F.col("b")).alias("p"))
    assert [r["p"] for r in rows.collect()] == [p for _, _, p in cases]
