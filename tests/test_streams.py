"""Streams with timers, caps, rings and upserts against batch folds and golden traces; restarts."""

import pytest
from pyspark.sql import functions as F

from sparkthrift.operators import caching as C
from sparkthrift.operators import memory, metrics, registrar
from sparkthrift.streaming import graph
from sparkthrift.streaming import state as S


def run(spark, tmp_path, rows, make, name, parts=3):
    """Rows in order of ts, a file a micro-batch; the stream is stopped and started again after each, from its checkpoint."""
    rows, out = rows.withColumn("ts", F.col("ts").cast("double")), None
    total = rows.count()
    bounds = rows.select("ts").orderBy("ts").collect()
    cuts = [bounds[min(total - 1, total * (i + 1) // parts - 1)]["ts"] for i in range(parts)]
    for i in range(parts):
        low = cuts[i - 1] if i else float("-inf")
        rows.where((F.col("ts") > low) & (F.col("ts") <= cuts[i])).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        out = query.lastProgress or out
    return spark.read.parquet(f"{tmp_path}/out"), out


def tidy(df, columns):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.select(columns).collect())


def test_seen_set_forgets_the_least_recent(spark, tmp_path):
    # With room for two, a third pushes out the first, whose return pushes out the second
    rows = spark.createDataFrame([("t", 1.0, "a"), ("t", 2.0, "b"), ("t", 3.0, "c"), ("t", 4.0, "a"), ("t", 5.0, "b"), ("t", 6.0, "b"), ("u", 1.5, "a")], "key string, ts double, digest string")
    out, _ = run(spark, tmp_path, rows, lambda s: S.seen_set(s, 300.0, 2), "lru")
    assert {(r["key"], r["ts"]): r["seen"] for r in out.collect()} == {("t", 1.0): False, ("t", 2.0): False, ("t", 3.0): False, ("t", 4.0): False, ("t", 5.0): False, ("t", 6.0): True, ("u", 1.5): False}


def test_timers_end_the_state(spark, tmp_path):
    """Many digests, each seen twice; what is kept stays far below what came, and answers equal the batch's."""
    rows = spark.createDataFrame([(f"t{i // 2 % 3}", 1e6 + float(i // 2 * 10 + i % 2), f"d{i // 2}") for i in range(600)], "key string, ts double, digest string")
    rows = rows.withColumn("key", F.concat("key", F.lit("/"), "digest"))
    out, progress = run(spark, tmp_path, rows, lambda s: S.seen_within(s, 50.0, "1 second"), "timers", parts=4)
    assert tidy(out, ["key", "ts", "seen"]) == tidy(C.seen_within(rows, 50.0, ("key",)), ["key", "ts", "seen"])
    state = progress["stateOperators"][0]
    assert state["numRowsTotal"] < 200  # 300 keys came, and a key is a value and a timer; those of the last batch remain


@pytest.mark.parametrize("which", ["hit", "bucket"])
def test_streams_with_timers_equal_batch(spark, sf_dir, tmp_path, which):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "event_id")
    make = {"hit": lambda s: S.replay(s, 3600.0, "0 seconds"), "bucket": lambda s: S.token_bucket(s, 2, 1 / 21600, "0 seconds")}[which]
    out, _ = run(spark, tmp_path, rows, make, which)
    batch = {"hit": lambda: C.replay(rows, 3600.0), "bucket": lambda: C.token_bucket(rows, 2, 1 / 21600)}[which]()
    assert tidy(out, batch.columns) == tidy(batch, batch.columns)


def test_similarity_ring_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(4)
    made = [(f"s{i % 2}", 1e6 + i, f"e{i}", [round(rng.gauss(0, 1), 3) for _ in range(3)] if i % 9 else None) for i in range(120)]
    rows = spark.createDataFrame(made, "key string, ts double, entry string, vector array<double>")
    out, _ = run(spark, tmp_path, rows, lambda s: S.similar_replay(s, 0.9, 60.0, 7, "0 seconds"), "ring")
    batch = C.similar_replay(rows, 0.9, 60.0, 7)
    columns = ["key", "ts", "entry", "answered_by", "similarity"]
    assert tidy(out, columns) == tidy(batch, columns)
    assert out.where("answered_by is not null").count() > 20


def _loop(asks, ttl, most):
    live, out = {}, []
    for event, now, key in sorted(asks, key=lambda x: (x[1], x[0])):
        live = {k: v for k, v in live.items() if now < v[0]}
        if key in live:
            out.append((event, "reuse", live[key][1]))
        elif len(live) >= most:
            out.append((event, "refuse", None))
        else:
            live[key] = (now + ttl, event)
            out.append((event, "create", event))
    return sorted(out)


def _asks(seed, n, keys, span):
    import random

    rng = random.Random(seed)
    return [(i, float(int(rng.random() * span)), f"p{int(keys * rng.random() ** 2)}") for i in range(n)]


@pytest.mark.parametrize(("keys", "most", "span"), [(30, 1000, 3000), (30, 12, 3000), (300, 3, 400), (8, 5, 100_000), (200, 30, 20_000)])
def test_registrar_equals_a_plain_loop(spark, keys, most, span):
    asks = _asks(keys, 800, keys, span)
    rows = spark.createDataFrame([(e, t, "cred", "m", p) for e, t, p in asks], "event_id long, ts double, credential string, model string, prefix string")
    got = registrar.ensure(rows, 50.0, most).collect()
    assert sorted((r["event_id"], r["action"], None if r["handle"] is None else int(r["handle"].rsplit("-", 1)[1])) for r in got) == _loop(asks, 50.0, most)


def test_registrar_stream_equals_a_plain_loop(spark, tmp_path):
    asks = [(i, 1e6 + i, k) for i, (_, _, k) in enumerate(_asks(9, 300, 20, 300))]
    rows = spark.createDataFrame([("pool", t, e, p) for e, t, p in asks], "key string, ts double, event_id long, digest string")
    out, _ = run(spark, tmp_path, rows, lambda s: S.ensure_handles(s, 15.0, 5, "0 seconds"), "handles")
    got = sorted((r["event_id"], r["action"], None if r["handle"] is None else int(r["handle"].rsplit("-", 1)[1])) for r in out.collect())
    assert got == _loop(asks, 15.0, 5)


def test_graph_ingest_is_idempotent(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") % 3).cast("string").alias("tenant"), F.col("conv_id").alias("request_id"), F.col("conv_id").cast("double").alias("ts"), F.col("turn").alias("msg_idx"), "role", "text")
    for part in range(2):
        rows.where(F.col("request_id") % 2 == part).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    graph.ingest(stream, f"{tmp_path}/mem").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    before = (tidy(graph.nodes(spark, f"{tmp_path}/mem"), ["tenant", "id", "ts", "request_id", "msg_idx"]), tidy(graph.edges(spark, f"{tmp_path}/mem"), ["tenant", "request_id", "src", "dst"]))
    graph.remember(spark.read.parquet(f"{tmp_path}/in").where("request_id % 2 = 0"), 0, f"{tmp_path}/mem")  # a batch comes again
    assert before == (tidy(graph.nodes(spark, f"{tmp_path}/mem"), ["tenant", "id", "ts", "request_id", "msg_idx"]), tidy(graph.edges(spark, f"{tmp_path}/mem"), ["tenant", "request_id", "src", "dst"]))
    assert tidy(graph.edges(spark, f"{tmp_path}/mem"), ["request_id", "src", "dst"]) == tidy(memory.follows(rows), ["request_id", "src", "dst"])
    for tenant in "012":
        own = memory.nodes(rows.where(F.col("tenant") == tenant))
        assert tidy(graph.nodes(spark, f"{tmp_path}/mem").where(F.col("tenant") == tenant), ["id", "kind", "text", "terms"]) == tidy(own, ["id", "kind", "text", "terms"])


def test_running_metrics_equal_batch_after_each_batch(spark, tmp_path):
    kind = "cache string, tenant string, tokens_before long, tokens_after long, stages array<struct<stage string, tokens_before long, tokens_after long, ok boolean>>"
    made = [(("hit", "miss", "similar")[i % 3], f"t{i % 4}" if i % 4 else "", 10 + i, 9, [("lossless", 10 + i, 10, i % 2 == 0), ("dedup", 10, 9, None)]) for i in range(40)]
    so_far = []
    for part in (made[:15], made[15:]):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        S.keep_sums(stream, f"{tmp_path}/sums").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
        so_far += part
        batch = spark.createDataFrame(so_far, kind)
        wants = (metrics.totals(batch), metrics.by_stage(batch.select(F.inline("stages"))), metrics.by_tenant(batch))
        for got, want in zip(S.running_metrics(spark, f"{tmp_path}/sums"), wants, strict=True):
            assert tidy(got, want.columns) == tidy(want, want.columns)


def test_ingress_equals_the_batch(spark, sf_dir, tmp_path):
    from sparkthrift.plans import lifecycle
    from sparkthrift.plans.config import Config
    from sparkthrift.plans.lifecycle_queries import _requests
    from sparkthrift.streaming import ingress

    config = Config(filler=True, structured=True, elide=True, elide_keep_recent=3, dedup=True, memory="summary", memory_keep_recent=2, memory_min_messages=4)
    rows = _requests(spark, sf_dir)[0].withColumn("ts", F.col("ts") + 1e6)
    columns = ["request_id", "dialect", "tenant", "status", "cache", "tokens_before", "tokens_after", "memory", "stages"]
    middle = rows.agg(F.avg("ts")).first()[0]
    for part in (F.col("ts") <= middle, F.col("ts") > middle):
        rows.where(part).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
        stream = ingress.outcomes(ingress.requests(spark, f"{tmp_path}/in"), config, "0 seconds")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert tidy(got, columns) == tidy(lifecycle.handled(rows, config), columns)
    assert got.where("cache = 'hit'").count() > 5
    with pytest.raises(ValueError, match="not for this stream"):
        ingress.outcomes(rows, Config(rate=1.0))
