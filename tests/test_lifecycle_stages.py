"""The lifecycle with its stages on: memory over time, learned tier, breakpoints, responses, similarity, shredding, bodies."""

import json

import pytest
from pyspark.sql import functions as F

from sparkthrift.operators import metrics
from sparkthrift.plans import lifecycle
from sparkthrift.plans.config import Config

from .test_lifecycle import sent


def chat(*texts, **more):
    return {"model": "m", "messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)], **more}


LONG = chat("My cat Whiskers likes tuna.", "Noted.", "Rome is in Italy.", "Yes.", "Paris is in France.", "Yes.", "Tell me about the weather", "Sunny.", "what does whiskers like")


def by_id(df):
    return {r["request_id"]: r for r in df.collect()}


def test_summary_replaces_old_turns(spark):
    config = Config(memory="summary", memory_keep_recent=2, memory_min_messages=4)
    rows = sent(spark, [(1, 1, "/v1/messages", "a", LONG), (2, 2, "/v1/messages", "a", chat("hi"))])
    told = lifecycle.handled(rows, config)
    got = by_id(told)
    assert (got[1]["memory"], got[1]["cache"], got[2]["memory"], got[2]["cache"]) == ("summary", "bypass", "ingest", "miss")
    assert [s["stage"] for s in got[1]["stages"]] == ["memory", "lossless"] and got[1]["stages"][0]["ok"]
    bodies = {r["request_id"]: json.loads(r["sent"]) for r in lifecycle.sent(rows, told, config).collect()}
    first = bodies[1]["messages"][0]
    assert first["role"] == "user" and first["content"].startswith("Conversation summary so far:\n- My cat Whiskers likes tuna.\n- Noted.\n- Rome is in Italy.")
    assert first["content"].endswith("\n\nTell me about the weather") and len(bodies[1]["messages"]) == 3


def test_retrieval_reads_the_memory_of_the_tenant_so_far(spark):
    config = Config(memory="retrieval", memory_keep_recent=2, memory_min_messages=4, multi_tenant=True, memory_retrieve=1)
    other = chat("Whiskers like salmon best", "ok")
    asks = chat("one thing", "Noted.", "another thing", "Yes.", "third thing", "Yes.", "more", "Sunny.", "what does whiskers like")
    rows = sent(spark, [(1, 1, "/v1/messages", "a", other), (2, 2, "/v1/messages", "a", asks), (3, 3, "/v1/messages", "b", asks), (4, 4, "/v1/messages", "b", other)])
    told = lifecycle.handled(rows, config)
    got = by_id(told)
    # the second finds its own question first, as does the third: it is the nearest text there is
    assert got[2]["memory"] == "compact" and got[3]["memory"] == "compact" and got[1]["memory"] == "ingest"
    config2 = Config(memory="retrieval", memory_keep_recent=2, memory_min_messages=4, multi_tenant=True, memory_retrieve=2)
    bodies = {r["request_id"]: json.loads(r["sent"])["messages"][0]["content"] for r in lifecycle.sent(rows, lifecycle.handled(rows, config2), config2).collect()}
    assert "- Whiskers like salmon best" in bodies[2] and "salmon" not in bodies[3]


def test_breakpoint_only_on_a_prefix_seen_before(spark):
    body = chat("long prefix " * 50, "ok", "question")
    rows = sent(spark, [(1, 0, "/v1/messages", "a", body), (2, 100, "/v1/messages", "a", {**body, "max_tokens": 1}), (3, 1000, "/v1/messages", "a", body), (4, 1001, "/v1/chat/completions", "a", body)])
    config = Config(inject=True, inject_least_tokens=20, cache=False)
    told = lifecycle.handled(rows, config)
    assert {k: (r["inject"], r["breakpoint"]) for k, r in by_id(told).items()} == {1: ("off", None), 2: ("on", 1), 3: ("off", None), 4: ("off", None)}
    bodies = {r["request_id"]: json.loads(r["sent"]) for r in lifecycle.sent(rows, told, config).collect()}
    assert bodies[2]["messages"][1]["content"] == [{"type": "text", "text": "ok", "cache_control": {"type": "ephemeral"}}] and bodies[2]["max_tokens"] == 1
    eager = by_id(lifecycle.handled(rows, Config(inject=True, inject_least_tokens=20, inject_repeat_aware=False)))
    assert [eager[i]["inject"] for i in (1, 2, 3, 4)] == ["on", "on", "on", "off"]


def test_structured_tiers_and_learned_tier(spark):
    block = {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "content": "long " * 40}, {"type": "text", "text": "really  please look"}]}
    body = {"model": "m", "messages": [block, {"role": "assistant", "content": "ok"}, {"role": "user", "content": "abcdefgh"}]}
    rows = sent(spark, [(1, 0, "/v1/messages", "a", body)])
    config = Config(structured=True, filler=True, elide=True, elide_keep_recent=1)
    half = lambda texts, keep: [t[: int(len(t) * keep)] for t in texts]
    told = lifecycle.handled(rows, config, reducer=half)
    assert [s["stage"] for s in told.first()["stages"]] == ["lossless", "filler", "learned", "elision"]
    made = json.loads(lifecycle.sent(rows, told, config, half).first()["sent"])["messages"]
    assert made[0]["content"] == [{"type": "tool_result", "tool_use_id": "t", "content": "[tool result elided]"}, {"type": "text", "text": "look"}]
    assert [m["content"] for m in made[1:]] == ["o", "abcd"]


def test_failed_answers_are_not_stored_and_usage_is_read(spark):
    rows = sent(spark, [(1, 0, "/v1/messages", "a", chat("hi")), (2, 1, "/v1/messages", "a", chat("hi")), (3, 2, "/v1/messages", "a", chat("hi"))])
    answers = spark.createDataFrame([(1, 500, "", 1.0), (2, 200, '{"usage": {"input_tokens": 7, "output_tokens": 2}}', 2.5)], "request_id long, status int, body string, duration_ms double")
    got = by_id(lifecycle.handled(rows, Config(), responses=answers))
    assert [(got[i]["cache"], got[i]["status"]) for i in (1, 2, 3)] == [("miss", 500), ("miss", 200), ("hit", 200)]
    assert got[2]["usage"]["input"] == 7 and got[1]["usage"] is None and got[3]["usage"] is None and got[2]["duration_ms"] == 2.5


def test_similar_answers_and_shredded_tenants(spark):
    texts = ["the quick brown fox jumps", "the quick brown fox jumps today", "something else entirely", "the quick brown fox jumps"]
    rows = sent(spark, [(i, i, "/v1/messages", "a", chat(t)) for i, t in enumerate(texts)])
    config = Config(similarity=True, similarity_embedder="hashing", similarity_allow_lexical=True, similarity_threshold=0.8)
    told = lifecycle.handled(rows, config)
    assert [by_id(told)[i]["cache"] for i in range(4)] == ["miss", "similar", "miss", "hit"]
    assert metrics.totals(told).first()["similar_hits"] == 1
    port = lifecycle.handled(rows, Config(similarity=True), embed=lambda batch: [[1.0, 0.0] if "fox" in x else [0.0, 1.0] for x in batch])
    assert [by_id(port)[i]["cache"] for i in range(4)] == ["miss", "similar", "miss", "hit"]
    tenant = by_id(lifecycle.handled(rows, Config(multi_tenant=True)))[0]["tenant"]
    gone = lifecycle.handled(rows, Config(multi_tenant=True, shredded=(tenant,), encryption_key=bytes(32)))
    assert {r["cache"] for r in gone.collect()} == {"miss"}


@pytest.mark.parametrize("memory", ["off", "ingest", "summary", "retrieval"])
def test_odd_rows_stay(spark, memory):
    rows = sent(spark, [(1, 0, "/v1/messages", "a", chat("hi")), (2, 1, "/v1/messages", "a", {"messages": []}), (3, 1, "/nowhere", "a", {})])
    rows = rows.unionByName(rows.where("request_id = 1").withColumn("request_id", F.lit(4)).withColumn("ts", F.lit(None).cast("double")).withColumn("extra", F.lit(1)).drop("extra"))
    rows = rows.unionByName(rows.where("request_id = 1").withColumn("request_id", F.lit(5)).withColumn("body", F.lit(None).cast("string")))
    config = Config(memory=memory, structured=True, elide=True, dedup=True, inject=True, similarity=True, similarity_embedder="hashing", similarity_allow_lexical=True, rate=100.0)
    told = lifecycle.handled(rows, config)
    assert sorted(r["request_id"] for r in told.collect()) == [1, 2, 3, 4, 5]
    assert lifecycle.handled(rows.limit(0), config).count() == 0


def test_events_and_verdicts_are_kept_and_read(spark, tmp_path):
    from sparkthrift.operators import evaluation
    from sparkthrift.sources import files

    rows = sent(spark, [(i, i, "/v1/messages", "a", chat("please   say hi  ", "ok", f"{i % 2}")) for i in range(4)])
    told = lifecycle.metric_events(lifecycle.handled(rows, Config(filler=True, multi_tenant=True)))
    for part in (0, 1):  # appended twice
        files.append_events(told.where(F.col("request_id") % 2 == part), f"{tmp_path}/events")
    back = files.read_events(spark, f"{tmp_path}/events")
    assert (metrics.totals(back).first()["requests"], metrics.totals(back).first()["hits"]) == (4, 2)
    assert {r["stage"] for r in metrics.by_stage(back.select(F.inline("stages"))).collect()} == {"lossless", "filler"} and metrics.by_tenant(back).count() == 1
    cases = spark.createDataFrame([(1.0, True), (0.5, False)], "score double, passed boolean")
    for at in (1, 2):
        report = evaluation.report(cases if at == 1 else cases.where("passed"))
        files.append_evals(metrics.evals_recorded("judged", F.col("mean_score"), F.col("passed"), report, F.lit(at).cast("long")), f"{tmp_path}/evals")
    assert tuple(metrics.latest_evals(files.read_evals(spark, f"{tmp_path}/evals")).first()) == ("judged", 1.0, True)
