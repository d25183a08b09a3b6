"""Settings, raw blocks, the lifecycle of requests, and golden compressions."""

import json

import pytest
from pyspark.sql import functions as F

from sparkthrift.functions import text as T
from sparkthrift.operators import blocks, evaluation
from sparkthrift.plans import lifecycle
from sparkthrift.plans.config import Config

# A prompt, and what the filler tiers leave of it.
PROMPT = "Could you please just go ahead and refactor the `parse_config` function so that it basically validates the input is a dict, and honestly make sure it raises ValueError on a missing 'host' key, really keeping the existing return type unchanged."
SHORT = "Could you go ahead and refactor the `parse_config` function so that it validates the input is a dict, and make sure it raises ValueError on a missing 'host' key, keeping the existing return type unchanged."


@pytest.mark.parametrize("bad", [{"rate": -1}, {"similarity_threshold": 1.1}, {"learned_ratio": 0.0}, {"encryption_key": b"x"}, {"shredded": ("t",)}, {"similarity": True, "similarity_embedder": "hashing"}, {"similarity": True, "similarity_embedder": "x"}, {"allowed": ("t",)}, {"verify_sample": 2}])
def test_settings_that_cannot_work(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_settings_from_env():
    got = Config.from_env({"SPARKTHRIFT_RATE": "2.5", "SPARKTHRIFT_MULTI_TENANT": "yes", "SPARKTHRIFT_ALLOWED": "a, b,,", "SPARKTHRIFT_ENCRYPTION_KEY": "00" * 32, "OTHER": "x"})
    assert (got.rate, got.multi_tenant, got.allowed, got.encryption_key) == (2.5, True, ("a", "b"), bytes(32))


def test_golden_compression(spark):
    r = spark.createDataFrame([(PROMPT,)], "t string").select(T.filler(F.col("t")).alias("a"), T.filler(F.col("t"), T.AGGRESSIVE_FILLERS).alias("b"), T.heuristic_tokens(F.col("t")).alias("n"), T.heuristic_tokens(T.filler(F.col("t"))).alias("m")).first()
    assert (r["a"], r["b"], r["n"], r["m"]) == (SHORT, SHORT, 61, 52)


RAW = {"role": "user", "content": [{"type": "text", "text": "please  do\n\n\n\n```x  \n```  ", "id": 1}, {"type": "tool_result", "tool_use_id": "t", "content": "long " * 20}, {"type": "image", "cache_control": {}}]}


def raw(spark, column, value):
    text = value if isinstance(value, str) or value is None else json.dumps(value)
    return spark.createDataFrame([(text,)], "raw string").select(column.alias("x")).first()["x"]


def test_text_blocks_only(spark):
    got = raw(spark, blocks.change_text_blocks(F.col("raw"), blocks.lossless_prose), RAW)
    made = json.loads(got["raw"])
    assert got["touched"] == 1 and made["content"][0] == {"type": "text", "text": "please  do\n\n```x  \n```", "id": 1} and made["content"][1:] == RAW["content"][1:]
    got = raw(spark, blocks.change_text_blocks(F.col("raw"), blocks.filler_prose(T.DEFAULT_FILLERS)), RAW)
    assert json.loads(got["raw"])["content"][0]["text"] == "do\n\n\n\n```x  \n```"


@pytest.mark.parametrize("value", ['{"a":  1}', "nope", None, '{"content": "x"}', "[]"])
def test_untouched_messages_stay_as_they_are(spark, value):
    for column in (blocks.change_text_blocks(F.col("raw"), blocks.lossless_prose), blocks.elide_results(F.col("raw"), "stub")):
        assert tuple(raw(spark, column, value)) == (value, 0)
    assert raw(spark, blocks.has_cache_control(F.col("raw")), value) is False


def test_elision_keeps_ids(spark):
    got = raw(spark, blocks.elide_results(F.col("raw"), "[elided]"), RAW)
    assert got["touched"] == 1 and json.loads(got["raw"])["content"][1] == {"type": "tool_result", "tool_use_id": "t", "content": "[elided]"}
    assert raw(spark, blocks.elide_results(F.col("raw"), "x" * 200), RAW)["touched"] == 0
    assert raw(spark, blocks.has_cache_control(F.col("raw")), RAW) is True


def test_a_failing_reducer_fails_open(spark):
    half = lambda texts, keep: [t[: int(len(t) * keep)] for t in texts]
    wrong = lambda texts, keep: 1 / 0
    picky = lambda texts, keep: [t[:1] for t in texts if len(texts) == 1 and t != "efgh"]  # noqa: E731  no batches, and not this one
    rows = spark.createDataFrame([(["abcd```x```efgh", None],)], "t array<string>")
    for reducer, want in ((half, "ab```x```ef"), (wrong, "abcd```x```efgh"), (picky, "a```x```efgh")):
        assert blocks.reduce_prose(rows, "t", reducer, 0.5, "out").first()["out"] == [want, None]


def sent(spark, rows):
    return spark.createDataFrame([(i, float(t), path, [{"k": "Authorization", "v": who}], json.dumps(body)) for i, t, path, who, body in rows], "request_id long, ts double, path string, headers array<struct<k string, v string>>, body string")


HELLO = {"model": "m", "messages": [{"role": "user", "content": "please say   hello  "}]}


def test_lifecycle_order_of_exits(spark):
    rows = [(1, 0, "/v1/messages", "a", HELLO), (2, 1, "/v1/messages", "a", HELLO), (3, 2, "/v1/messages", "b", HELLO), (4, 3, "/v1/messages", "zz", HELLO), (5, 4, "/v1/messages", "a", HELLO), (6, 5, "/v1/messages", "b", {**HELLO, "stream": True})]
    names = [r["t"] for r in spark.createDataFrame([("a",), ("b",)], "c string").select(F.substring(F.sha2(F.concat(F.lit("|"), "c"), 256), 1, 16).alias("t")).collect()]
    config = Config(filler=True, multi_tenant=True, allowed=tuple(names), rate=2.0, burst=2.0)
    got = {r["request_id"]: (r["status"], r["cache"]) for r in lifecycle.outcomes(sent(spark, rows), config).collect()}
    assert got == {1: (200, "miss"), 2: (200, "hit"), 3: (200, "miss"), 4: (401, "none"), 5: (429, "none"), 6: (200, "stream-bypass")}


def test_lifecycle_passes_and_guards(spark):
    secret = {"messages": [{"role": "user", "content": "password = hunter2hunter2"}]}
    rows = [(1, 0, "/nowhere", "a", HELLO), (2, 0, "/v1/messages", "a", {"messages": 1}), (3, 0, "/v1/messages", "a", secret), (4, 0, "/v1beta/models/:generateContent", "a", {"contents": []}), (5, 0, "/v1/messages", "a", HELLO)]
    got = {r["request_id"]: (r["dialect"], r["status"], r["cache"], r["tokens_before"], r["tokens_after"]) for r in lifecycle.outcomes(sent(spark, rows), Config(filler=True)).collect()}
    assert got[1][:3] == ("unknown", 200, "bypass")  # an authorisation header routes it
    assert got[2] == ("anthropic", 200, "bypass", 0, 0) and got[3][2] == "bypass" and got[4][2] == "bypass"
    assert got[5] == ("anthropic", 200, "miss", 5, 3)
    told = lifecycle.meta_headers(lifecycle.outcomes(sent(spark, rows), Config(filler=True)).where("request_id = 5")).first()["headers"]
    assert told["x-sparkthrift-tokens-saved"] == "2" and told["x-sparkthrift-cache"] == "miss"


def test_gates(spark):
    none = spark.createDataFrame([], "score double, passed boolean")
    assert tuple(evaluation.report(none).first()) == (0, 0.0, 0, True)
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], True), ([1.0, 0.0], [1.0, 0.01], False), ([1.0, 0.0], [0.0, 1.0], True)], "anchor array<double>, variant array<double>, should_hit boolean")
    assert tuple(evaluation.similarity_report(pairs, 0.97).first()) == (0.5, 0.5, 1, False)
    sweep = spark.createDataFrame([(0.3, False, 0.9), (0.5, True, 0.8), (0.7, True, 1.0)], "ratio double, passed boolean, mean_score double")
    assert evaluation.best_ratio(sweep).first()[0] == 0.5 and evaluation.best_ratio(sweep.where("not passed")).first()[0] == 0.3
    r = spark.createDataFrame([("Keep THIS text", ["this", "missing"], [])], "c string, m array<string>, e array<string>").select(evaluation.recall(F.col("c"), F.col("m")).alias("a"), evaluation.recall(F.col("c"), F.col("e")).alias("b"), evaluation.all_dropped(F.col("c"), F.array(F.lit("this"))).alias("d"), evaluation.says_yes(F.lit(" YES, kept")).alias("y")).first()
    assert tuple(r) == (0.5, 1.0, True, True)
