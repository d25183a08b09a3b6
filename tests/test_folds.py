"""Folds over keys: order of equal times, hot keys, the lifecycle's rows."""

import time

import pytest
from pyspark.sql import functions as F

from sparkthrift.functions import redaction
from sparkthrift.operators import caching as C
from sparkthrift.operators import crypto, requests
from sparkthrift.plans import lifecycle
from sparkthrift.plans.config import Config

BODY = '{"model": "m", "max_tokens": 5, "messages": [{"role": "user", "content": "hello there"}]}'


def asked(spark, rows):
    made = [(i, ts, "/v1/messages", [("x-api-key", "k")], body) for i, ts, body in rows]
    return spark.createDataFrame(made, "request_id string, ts double, path string, headers array<struct<k string, v string>>, body string")




def test_of_equal_requests_at_one_second_the_first_misses(spark):
    got = {r["request_id"]: r["cache"] for r in lifecycle.outcomes(asked(spark, [("b", 1.0, BODY), ("a", 1.0, BODY), ("c", 1.0, BODY)])).collect()}
    assert got == {"a": "miss", "b": "hit", "c": "hit"}


def test_a_burst_of_one_lets_one_request_pass(spark):
    got = {r["request_id"]: r["status"] for r in lifecycle.outcomes(asked(spark, [("b", 1.0, BODY), ("a", 1.0, BODY)]), Config(rate=1, burst=1)).collect()}
    assert got == {"a": 200, "b": 429}


def test_folds_of_a_hot_key_are_linear(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("ts"), "id")
    began = time.perf_counter()
    assert C.replay(rows, 10.0).where("hit").count() == 180_000
    assert C.token_bucket(rows, 5, 0.5).where("allowed").count() in range(100_000, 100_010)
    assert time.perf_counter() - began < 60


def test_an_entry_of_later_is_no_hit(spark):
    cache = spark.createDataFrame([("k", 5.0, 50.0, 200)], "key string, created_at double, expires_at double, status_code int")
    rows = spark.createDataFrame([("k", 4.0), ("k", 5.0), ("k", 50.0)], "key string, ts double")
    assert [(r["ts"], r["hit"]) for r in C.probe(rows, cache, F.col("ts")).orderBy("ts").collect()] == [(4.0, False), (5.0, True), (50.0, False)]


@pytest.mark.parametrize(("value", "want"), [("true", True), ("false", False), ('"yes"', True), ('""', False), ("2.5", True), ("0", False), ("0.0", False), ("null", False), ("[]", False), ("[0]", True), ("{}", False), ('{"a": 1}', True), ('"false"', True)])
def test_any_truthy_value_streams(spark, value, want):
    row = spark.createDataFrame([("/v1/messages", f'{{"stream": {value}}}')], "path string, body string")
    assert row.select(requests.is_stream(F.col("path"), F.col("body"))).first()[0] is want


def test_bearer_behind_a_no_break_blank_is_redacted(spark):
    text = "Bearer " + "a" * 24
    row = spark.createDataFrame([(text,)], "t string").select(redaction.redact(F.col("t")).alias("r")).first()["r"]
    assert row["categories"] == ["bearer_token"] and "aaaa" not in row["text"]


def test_derived_keys_equal_the_plain_derivation(spark):
    tenants = spark.createDataFrame([("a",), ("é",), ("",)], "tenant string")
    epochs = spark.createDataFrame([("a", 3)], "tenant string, epoch long")
    master = bytes(range(32))
    assert {r["tenant"]: bytes(r["dek"]) for r in crypto.tenant_keys(tenants, master).collect()} == {t: crypto.tenant_key(master, t) for t in ("a", "é", "")}
    assert {r["tenant"]: bytes(r["dek"]) for r in crypto.tenant_keys(tenants, master, epochs=epochs).collect()} == {t: crypto.tenant_key(master, t, 3 if t == "a" else 0) for t in ("a", "é", "")}
