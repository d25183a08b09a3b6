"""Parsing, keys, crypto and sources on golden and odd input."""

import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkthrift.functions import keys as K
from sparkthrift.functions import terms as V
from sparkthrift.operators import crypto, memory, metrics, requests
from sparkthrift.sources import files


def parsed(spark, path, body, structured=True):
    rows = spark.createDataFrame([(path, body if isinstance(body, str) else json.dumps(body))], "path string, body string")
    return requests.parse_requests(rows, structured).first()


def test_three_dialects(spark):
    r = parsed(spark, "/v1/messages", {"model": "m", "system": "s", "stream": True, "messages": [{"role": "user", "content": "hi"}]})
    assert (r["dialect"], r["parsed"]["system"], r["parsed"]["stream"], r["parsed"]["messages"][0]["text"]) == ("anthropic", "s", True, "hi")
    r = parsed(spark, "/v1/chat/completions", {"messages": [{"role": "system", "content": "a"}, {"role": "tool", "content": "b", "tool_call_id": "1"}]})
    assert [(m["role"], m["text"]) for m in r["parsed"]["messages"]] == [("system", "a"), ("tool", None)]
    r = parsed(spark, "/v1beta/models/g:generateContent", {"systemInstruction": {"parts": [{"text": "s"}]}, "contents": [{"role": "model", "parts": [{"text": "x"}]}]})
    assert (r["parsed"]["model"], r["parsed"]["system"], r["parsed"]["messages"][0]["role"]) == ("g", "s", "assistant")


@pytest.mark.parametrize("body", ["", "[1]", "{", {"messages": 3}, {"messages": [3]}, {"messages": [{"role": "wizard", "content": "x"}]}, {"system": [1], "messages": []}])
def test_odd_bodies_pass_untouched(spark, body):
    assert parsed(spark, "/v1/messages", body)["parsed"]["messages"] is None


def test_blocks_are_raw_only_if_structured(spark):
    body = {"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}]}
    assert parsed(spark, "/v1/messages", body)["parsed"]["messages"][0]["raw"]
    assert parsed(spark, "/v1/messages", body, structured=False)["parsed"]["messages"] is None


def test_serialize_keeps_unknown_fields_and_marks(spark):
    body = {"model": "m", "temperature": 0.5, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}
    rows = spark.createDataFrame([("/v1/messages", json.dumps(body))], "path string, body string")
    sent = requests.serialize_requests(requests.parse_requests(rows).withColumn("breakpoint", F.lit(0))).first()["sent"]
    got = json.loads(sent)
    assert got["temperature"] == 0.5 and got["messages"][0]["content"][0]["cache_control"] == {"type": "ephemeral"} and got["messages"][1] == body["messages"][1]


def test_usage(spark):
    rows = spark.createDataFrame([("anthropic", '{"usage":{"input_tokens":3.9,"output_tokens":true,"cache_read_input_tokens":"4"}}'), ("openai", '{"usage":{"prompt_tokens":5,"prompt_tokens_details":{"cached_tokens":2}}}'), ("gemini", '{"usage":{}}'), ("unknown", '{"usage":{}}'), ("openai", "oops")], "d string, b string")
    got = [r["u"] and tuple(r["u"]) for r in rows.select(requests.parse_usage(F.col("d"), F.col("b")).alias("u")).collect()]
    assert got == [(3, 0, 0, 0), (5, 0, 2, 0), None, None, None]


def test_cache_key_escapes_like_json(spark):
    import hashlib

    text = 'a"\\\x1f\né \\u001F'
    payload = {"dialect": "openai", "messages": [["user", text]], "model": None, "system": None, "tools": None, "v": "v1"}
    want = "v1:" + hashlib.sha256(b"s\0" + json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    rows = spark.createDataFrame([(text,)], "t string")
    none = F.lit(None).cast("string")
    assert rows.select(K.cache_key(F.lit("openai"), none, none, F.array(F.array(F.lit("user"), "t")), none, "s").alias("k")).first()["k"] == want


def test_sealing(spark):
    k, old = bytes(range(32)), bytes(32)
    rows = spark.createDataFrame([(bytearray(b"body"),)], "b binary").withColumn("blob", crypto.seal(F.col("b"), F.lit(k), F.lit("aad")))
    opened = lambda keys, aad="aad", blob=F.col("blob"): rows.select(crypto.open_sealed(blob, [F.lit(x) for x in keys], F.lit(aad)).alias("x")).first()["x"]
    assert bytes(opened([k])) == b"body" and bytes(opened([old, k])) == b"body"
    assert opened([old]) is None and opened([k], "other") is None
    assert opened([k], blob=F.concat(F.lit(b"\x02"), F.substring("blob", 2, 999))) is None and opened([k], blob=F.lit(b"\x01")) is None


def test_hkdf_known_answer():
    import hashlib
    import hmac

    prk = hmac.new(bytes(32), bytes(32), hashlib.sha256).digest()
    assert crypto.tenant_key(bytes(32), "t") == hmac.new(prk, b"cache-tenant:t\x01", hashlib.sha256).digest()
    assert crypto.tenant_key(bytes(32), "t", 1) != crypto.tenant_key(bytes(32), "t", 0) != crypto.tenant_key(bytes(32), "u", 0)
    with pytest.raises(ValueError):
        crypto.check_key(b"short")


def test_jaccard_and_embedding(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    assert rows.select(V.jaccard(F.col("a"), F.col("b")).alias("x")).first()["x"] == pytest.approx(1 / 3)
    assert rows.select(V.jaccard(F.col("a"), F.col("e")).alias("x")).first()["x"] == 0
    v = spark.createDataFrame([("alpha beta alpha",)], "t string").select(V.hashing_embedding(F.col("t")).alias("v"), V.cosine(V.hashing_embedding(F.col("t")), V.hashing_embedding(F.col("t"))).alias("c")).first()
    assert len(v["v"]) == 256 and sum(x * x for x in v["v"]) == pytest.approx(1) and v["c"] == pytest.approx(1)


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"path": "/v1/messages", "body": {"b": 1}}\n\n{"name": "n", "dialect": "openai", "body": {}}\n')
    got = files.load_jsonl(spark, str(path)).orderBy("line").collect()
    assert [(r["line"], r["name"], r["dialect"], r["body"]) for r in got] == [(1, "sample-1", "anthropic", '{"b":1}'), (3, "n", "openai", "{}")]
    for bad in ('{"path": "x"}\n', "nope\n", '{"dialect": "x", "body": {}}\n'):
        path.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017, PT011 (the JVM's own classes differ)
            files.load_jsonl(spark, str(path)).collect()


def test_vectors_from_blobs(spark):
    values = [0.0, -0.0, 1.5, -2.25, 1e-310, 1.7e308, float("inf"), 3.14159]
    rows = spark.createDataFrame([(bytearray(struct.pack("<8d", *values)),), (bytearray(b"abc"),)], "b binary")
    got = [r["v"] for r in rows.select(files.read_vectors(F.col("b")).alias("v")).collect()]
    assert got == [values, None]


def test_compaction_steps_back_to_a_user_turn(spark):
    roles = ["user", "assistant"] * 5
    rows = spark.createDataFrame([(1, i, r, f"turn {i}. more") for i, r in enumerate(roles)], "request_id long, msg_idx int, role string, text string")
    start = memory.window_start(rows, 3).first()
    assert (start["n"], start["start"], start["latest"]) == (10, 6, "turn 8. more")
    out = memory.compact_by_summary(rows, keep_recent=3, max_items=2).orderBy("msg_idx").collect()
    assert [r["msg_idx"] for r in out] == [6, 7, 8, 9] and out[0]["text"] == memory.SUMMARY_HEADER + "- turn 0.\n- turn 1.\n\nturn 6. more"


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "cache string, tenant string, tokens_before long, tokens_after long")
    assert tuple(metrics.totals(none).first()) == (0, 0, 0, 0.0, 0, 0, 0, 0.0)


def test_verdicts_must_be_complete(spark):
    cases, verdicts = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", True)], "id string, ok boolean")
    with pytest.raises(PySparkException):
        files.assert_joined(cases, verdicts).collect()
