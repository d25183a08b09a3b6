"""Ports against plain Python; violations of whole requests."""

import pytest
from pyspark.sql import functions as F

from sparkthrift.functions import invariants
from sparkthrift.operators import ports

TEXTS = ["one two", None, "", "three  four five", "x" * 3000]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")


def column(frame, name):
    return {r["id"]: r[name] for r in frame.collect()}


def test_tokenizer_embedder_and_summariser(rows):
    assert column(ports.counted(rows, "text", lambda t: len(t.split())), "tokens") == {i: None if t is None else len(t.split()) for i, t in enumerate(TEXTS)}
    assert column(ports.embedded(rows, "text", lambda ts: [[len(t), 1] for t in ts]), "vector") == {i: None if t is None else [float(len(t)), 1.0] for i, t in enumerate(TEXTS)}

    def fails(t):
        if t.startswith("x"):
            raise ValueError
        return t[:3]

    assert column(ports.summarised(rows, "text", fails, lambda t: "short"), "summary") == {0: "one", 1: None, 2: "short", 3: "thr", 4: "short"}


def test_bpe_counts(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    count = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids)
    assert column(ports.counted(rows, "text", count), "tokens") == {i: None if t is None else count(t) for i, t in enumerate(TEXTS)}


def test_reducer_fails_open(rows):
    got = column(ports.reduced(rows, "text", lambda ts, keep: [t[: int(len(t) * keep)] if len(t) < 100 else t + "!" for t in ts], 0.5), "reduced")
    assert got == {0: "one", 1: None, 2: "", 3: "three  f", 4: "x" * 3000}
    assert column(ports.reduced(rows, "text", lambda ts, keep: ts[:1], 0.5), "reduced") == dict(enumerate(TEXTS))


CASES = [
    ((None, [("user", "a  b")]), (None, [("user", "a b")]), []),
    (("s", [("user", "a")]), (None, [("user", "a")]), ["system"]),
    (("s t", [("user", "a")]), ("s u", [("user", "a")]), ["system"]),
    ((None, [("user", "a"), ("assistant", "b")]), (None, [("user", "a")]), ["message count"]),
    ((None, [("user", "a"), ("assistant", "b")]), (None, [("user", "x"), ("user", "b")]), ["words 0", "role 1"]),
    ((None, [("user", "a ```x  y``` b")]), (None, [("user", "a ```x y``` b")]), ["code 0"]),
    ((None, [("user", "a ```x``` b")]), (None, [("user", "a x b")]), ["spans 0"]),
    ((None, [("user", None)]), (None, [("user", None)]), []),
    ((None, []), (None, []), []),
]


def test_request_violations(spark):
    kind = "struct<system: string, messages: array<struct<role: string, text: string>>>"
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CASES)], f"id int, a {kind}, b {kind}")
    got = {r["id"]: r["v"] for r in frame.select("id", invariants.request_violations(F.col("a"), F.col("b")).alias("v")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}
    fill = spark.createDataFrame([((None, [("user", "please just do it")]), (None, [("user", "do it")])), ((None, [("user", "please do it")]), (None, [("user", "please it")]))], f"a {kind}, b {kind}")
    assert [r["v"] for r in fill.select(invariants.filler_violations(F.col("a"), F.col("b")).alias("v")).collect()] == [[], ["words 0"]]
