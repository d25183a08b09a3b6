"""Similarity over time against a plain second version, reports of nothing, ids, logged events."""

import math
import random

import pytest

from sparkthrift.operators import caching as C
from sparkthrift.operators import evaluation as E
from sparkthrift.operators import metrics as X
from sparkthrift.operators import reports, requests

SCHEMA = "key string, ts double, entry long, vector array<double>"


def replayed(rows, threshold, ttl, most):
    scopes, out = {}, {}
    for key, ts, entry, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out[entry] = None
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        live = scopes[key] = [e for e in scopes.get(key, []) if ts < e[0] + ttl]
        cosine = lambda w: sum(a * b for a, b in zip(v, w, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in w))  # noqa: B023, E731
        best = max(((cosine(e[2]), i) for i, e in enumerate(live)), default=(-2, 0))
        if best[0] >= threshold:
            out[entry] = live[best[1]][1]
            continue
        live.append((ts, entry, v))
        del live[: max(0, len(live) - most)]
    return out


@pytest.mark.parametrize(("ttl", "most"), [(1e9, 1000), (40.0, 1000), (1e9, 3), (25.0, 5)])
def test_similarity_over_time(spark, ttl, most):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), float(i // 2), i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    rows += [("a", 5.0, 900, None), ("a", 5.0, 901, [0.0, 0.0, 0.0]), ("b", 5.0, 902, [1.0, None, 2.0]), ("b", 6.0, 903, [float("nan"), 1.0, 2.0])]
    got = {r["entry"]: r["answered_by"] for r in C.similar_replay(spark.createDataFrame(rows, SCHEMA), 0.9, ttl, most, ("entry",)).collect()}
    assert got == replayed(rows, 0.9, ttl, most)
    assert 0 < sum(v is not None for v in got.values()) < len(got)


def test_nothing_is_remembered_without_room(spark):
    rows = [("a", 1.0, 1, [1.0, 0.0]), ("a", 2.0, 2, [1.0, 0.0])]
    assert [r["answered_by"] for r in C.similar_replay(spark.createDataFrame(rows, SCHEMA), 0.5, 9.0, 0).collect()] == [None, None]
    assert C.similar_replay(spark.createDataFrame([], SCHEMA), 0.5, 9.0, 3).count() == 0


def test_reports_without_cases(spark):
    results = spark.createDataFrame([], "name string, canonicalized boolean, tokens_before long, tokens_after long, passed boolean")
    total = E.totals(results).first()
    assert (total["samples"], total["regressions"], total["passed"], total["overall_ratio"]) == (0, 0, True, 0.0)
    last = [r["line"] for r in reports.samples(results).orderBy("part", "name").collect()][-1]
    assert last == "TOTAL  samples=0 canonicalised=0  tokens 0->0 (saved 0, 0.0%)  regressions=0  PASS"
    assert reports.judged(spark.createDataFrame([], "name string, score double, passed boolean")).count() == 4


def test_shares_on_a_half_go_to_the_even_digit(spark):
    """96 to 90 tokens save 6.25 %, a half in binary too; 3 of 2000 are 0.15 %, in binary below the half that it shows."""
    pairs = [(b, a) for b in range(161) for a in range(b + 3)] + [(2000, 1997), (800, 798)]
    results = spark.createDataFrame([(f"{b}-{a}", True, b, a, True) for b, a in pairs], "name string, canonicalized boolean, tokens_before long, tokens_after long, passed boolean")
    got = {r["name"]: r["line"] for r in reports.samples(results).where("part = 2").collect()}
    want = {f"{b}-{a}": f"{f'{b}-{a}':<28} {'yes':>5} {b:>7} {a:>7} {(b - a) / b * 100 if b else 0.0:>6.1f}%  ok" for b, a in pairs}
    assert got == want
    assert " 6.2%" in got["96-90"] and " 0.1%" in got["2000-1997"]
    last = reports.samples(results.where("name = '96-90'")).where("part = 4").first()["line"]
    assert last == "TOTAL  samples=1 canonicalised=1  tokens 96->90 (saved 6, 6.2%)  regressions=0  PASS"


def test_reports_of_judges(spark):
    cases = spark.createDataFrame([("a" * 40, 1.0, True), ("b", 0.25, False)], "name string, score double, passed boolean")
    lines = [r["line"] for r in reports.retrieval(cases).orderBy("part", "name").collect()]
    assert lines[2:4] == ["a" * 28 + "  100.0%    ok", "b".ljust(28) + "   25.0%  FAIL"]
    assert lines[-1] == "TOTAL cases=2 passed=1 mean_recall=62.5%  FAIL"
    assert [r["line"] for r in reports.judged(cases).orderBy("part", "name").collect()][3] == "b".ljust(28) + "    25%  FAIL"


def test_ids_and_content_types(spark):
    rows = [(1, [("X-Correlation-Id", "c"), ("X-Request-ID", "r")]), (2, [("x-request-id", ""), ("x-correlation-id", "c")]), (3, [("Content-Type", "text/a"), ("content-type", "text/b")]), (4, [])]
    frame = spark.createDataFrame(rows, "n int, h array<struct<k string, v string>>")
    got = frame.select("n", requests.correlation_id(frame["h"], frame["n"].cast("string")).alias("id"), requests.content_type(frame["h"]).alias("kind")).orderBy("n").collect()
    assert [(r["id"], r["kind"]) for r in got] == [("r", "application/json"), ("c", "application/json"), ("3", "text/a"), ("4", "application/json")]


def test_logged_events(spark):
    rows = spark.createDataFrame([(10, 4, 1.005), (0, 0, 0.0), (3, 9, 2.0)], "tokens_before long, tokens_after long, duration_ms double")
    assert [(r["tokens_saved"], r["ratio"]) for r in X.event_rows(rows).collect()] == [(6, 0.6), (0, 0.0), (0, 0.0)]
