"""Stateful operators: golden traces, and streams against batch folds."""

import pytest
from pyspark.sql import functions as F

from sparkthrift.operators import caching as C
from sparkthrift.operators import registrar
from sparkthrift.streaming import state as S


def events(spark, rows):
    return spark.createDataFrame(rows, "key string, ts double")


def test_bucket_denies_the_fourth(spark):
    got = C.token_bucket(events(spark, [("a", 0.0)] * 4 + [("a", 1.0)]), 3, 1.0).orderBy("ts").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, True]
    assert got[3]["retry_after"] == pytest.approx(1.0)


def test_bucket_without_refill(spark):
    got = C.token_bucket(events(spark, [("a", 0.0), ("a", 100.0)]), 1, 0.0).orderBy("ts").collect()
    assert [(r["allowed"], r["retry_after"]) for r in got] == [(True, 0.0), (False, 0.0)]


def test_seen_is_inclusive_and_refreshes(spark):
    rows = spark.createDataFrame([("t", "d", x) for x in (0.0, 301.0, 302.0, 602.0)] + [("u", "d", 1.0)], "tenant string, digest string, ts double")
    got = {(r["tenant"], r["ts"]): r["seen"] for r in C.seen_within(rows, 300).collect()}
    assert got == {("t", 0.0): False, ("t", 301.0): False, ("t", 302.0): True, ("t", 602.0): True, ("u", 1.0): False}


def test_replay_expires_at_the_ttl(spark):
    got = C.replay(events(spark, [("k", x) for x in (0.0, 9.0, 10.0, 19.0, 21.0)]), 10).orderBy("ts").collect()
    assert [r["hit"] for r in got] == [False, True, False, True, False]


def test_put_without_ttl_stores_nothing(spark):
    assert C.put(events(spark, [("k", 1.0)]), "ts", 0).count() == 0


def test_probe_expiry(spark):
    cache = spark.createDataFrame([("k", 200, b"x", 10.0)], "key string, status_code int, body binary, expires_at double")
    got = C.probe(events(spark, [("k", 9.9), ("k", 10.0), ("z", 0.0)]), cache, F.col("ts")).orderBy("ts").collect()
    assert [(r["key"], r["hit"], r["status_code"]) for r in got] == [("z", False, None), ("k", True, 200), ("k", False, None)]


def test_similar_ties_go_to_the_latest(spark):
    index = spark.createDataFrame([(1, "a", None, "t", [1.0, 0.0]), (2, "b", None, "t", [2.0, 0.0]), (3, "c", "m", "t", [1.0, 0.0])], "seq long, key string, model string, tenant string, vector array<double>")
    probes = spark.createDataFrame([(7, None, "t", [3.0, 0.0]), (8, None, "t", [0.0, 1.0])], "probe_id long, model string, tenant string, vector array<double>")
    assert [(r["probe_id"], r["key"]) for r in C.similar(probes, index, 0.97).collect()] == [(7, "b")]


def test_registrar_reuses_expires_and_caps(spark):
    asks = [(1, 0.0, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, 3.0, "c"), (5, 10.0, "a"), (6, 10.5, "c")]
    rows = spark.createDataFrame([(e, t, "cred", "m", p) for e, t, p in asks], "event_id long, ts double, credential string, model string, prefix string")
    got = [r["action"] for r in registrar.ensure(rows, 10, 2).orderBy("event_id").collect()]
    assert got == ["create", "reuse", "create", "refuse", "create", "refuse"]


@pytest.mark.parametrize("which", ["seen", "hit", "bucket"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, which):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    for i in range(2):  # two micro-batches, in order
        middle = rows.approxQuantile("ts", [0.5], 0.0)[0]
        rows.where(F.col("ts") <= middle if i == 0 else F.col("ts") > middle).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = {"seen": lambda: S.seen_within(stream, 86400), "hit": lambda: S.replay(stream, 86400), "bucket": lambda: S.token_bucket(stream, 2, 1 / 21600)}[which]()
    query = live.writeStream.format("memory").queryName(f"out_{which}").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    batch = {"seen": lambda: C.seen_within(rows, 86400, ("key",)), "hit": lambda: C.replay(rows, 86400), "bucket": lambda: C.token_bucket(rows, 2, 1 / 21600)}[which]()
    columns = sorted(batch.columns)
    tidy = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(columns).collect())
    assert tidy(spark.table(f"out_{which}")) == tidy(batch)


def test_running_totals_and_fan_out(spark, tmp_path):
    spark.createDataFrame([("hit", 4, 2), ("miss", 5, 5)], "cache string, tokens_before long, tokens_after long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("cache string, tokens_before long, tokens_after long").parquet(f"{tmp_path}/in")
    seen = []
    S.fan_out(stream, lambda b: seen.append(b.count()), lambda b: seen.append(-b.count())).option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [2, -2]
    q = S.running_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", f"{tmp_path}/b").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("totals").first()) == (2, 1, 9, 7)
