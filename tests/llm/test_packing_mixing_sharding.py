"""Packing, mixing and sharding against their laws on odd input."""

import random
import re
import zlib

import numpy as np
import pytest

from sparkthrift.llm import op1_packing, op7_sharding, op8_mixing

ROWS = [(1, None, "a"), (2, "", None), (3, "one two three", "a"), (3, "one two three", "a"), (None, "null id", None), (5, "double  blank \n x ", "b"), (6, "it's <|endoftext|> 12 [INST] ok", "b"), (7, "word " * 4000, "hot"), (8, "été naïve — 日本語 \U0001f600", "b"), (9, "z" * 3000, "hot")]
ROWS += [(20 + i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma,", "delta."], k=i * 7 % 90)), f"s{i % 3}") for i in range(40)]


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def pieces(docs, **options):
    return op1_packing.pack(docs, **op1_packing.public_tokenizer(), **options).toPandas()


@pytest.mark.parametrize("options", [{}, {"window": 64, "quantum": 16}, {"window": 64, "quantum": 64, "weights": {"a": 3.0, "b": 1.0, "hot": 1.0, None: 0.5, "s0": 1.0, "s1": 1.0, "s2": 2.0}}])
def test_every_token_is_in_one_piece(spark, docs_of, ids, options):
    docs = docs_of([(i, t, s) for i, (_, t, s) in enumerate(ROWS)])
    out = pieces(docs, keep_ids=True, **options)
    window = options.get("window", 1024)
    for doc, g in out.sort_values("start").groupby("doc_id"):
        want = ids(ROWS[int(doc)][1])
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() == len(want)
        assert (g["doc_tokens"] == len(want)).all()
        for a, n, crc, data in zip(g["start"], g["length"], g["ids_crc32"], g["ids"], strict=True):
            assert bytes(data) == want[a : a + n].tobytes() and zlib.crc32(bytes(data)) == crc
    assert set(out["doc_id"]) == set(range(len(ROWS)))
    total = out.groupby("sequence_id")["length"].sum()
    assert (total[:-1] == window).all() and total.index.tolist() == list(range(len(total)))
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered["offset"] == ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]).all()


def test_windows_keep_the_proportions(spark, docs_of):
    docs = docs_of([(i, "many words of one kind " * 200, s) for i, s in enumerate("aaaaaabbbc")])
    out = pieces(docs, window=256, quantum=32)
    used = out.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0).cumsum()
    share = out.groupby("source")["length"].sum() / out["length"].sum()
    gap = used.sub(used.sum(axis=1), axis=0) * 0 + used - np.outer(used.sum(axis=1), share)
    assert gap.abs().to_numpy().max() <= 2 * 32  # a source's deficit stays within two quanta, whatever the window


def test_schedule_is_a_permutation_of_quanta():
    s = op1_packing.Schedule([1000, 10, 333, 1], None, 16)
    taken = np.zeros(1344, int)
    for source, total in enumerate(s.totals):
        turn = np.arange(s.quanta[source])
        at = s.position(np.full(len(turn), source), turn)
        for a, t in zip(at, turn, strict=True):
            taken[a : a + min(16, total - t * 16)] += 1
    assert (taken == 1).all()


def test_encoder_fast_path_equals_whole_text():
    code = op1_packing.encoder(*op1_packing.public_tokenizer().values())
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["<|endoftext|>", "a", "Foo", "it's", " ", " ", "  ", "\n", "\n ", " \n", " ", "12", "!!", "é", "\x1c"], k=rng.randint(0, 12)))
        assert code.encode(text) == np.array(code.own.encode(text, add_special_tokens=False).ids, code.kind).tobytes()


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000, "x" * 300_000, "<|endoftext|> a", "a <|endoftext|>b  <|endoftext|>", "1" * 100_000, "é " * 300_000, " x" * 3_000])
def test_long_texts_and_added_tokens(ids, text):
    code = op1_packing.encoder(*op1_packing.public_tokenizer().values())
    assert np.array_equal(np.frombuffer(code.encode(text), code.kind), ids(text)[:-1])


def test_packing_nothing(spark, docs_of):
    assert len(pieces(docs_of([]))) == 0


def test_shards_hold_groups_and_are_even(spark, docs_of):
    rng = random.Random(1)
    rows = [*ROWS, *((100 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))), "s") for i in range(600)), *((2000 + i, "a copy of many", "s") for i in range(60))]
    out = op7_sharding.shard(docs_of([(i, t, s) for i, (_, t, s) in enumerate(rows)])).toPandas()
    assert len(out) == len(rows)
    text = [r[1] for r in rows]
    assert all(n == len((text[i] or "").encode()) + 1 and c == zlib.crc32((text[i] or "").encode()) for i, n, c in zip(out["doc_id"], out["size"], out["text_crc32"], strict=True))
    assert out.assign(t=[str(text[i]) for i in out["doc_id"]]).groupby("t")["shard"].nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = out[out["size"] < 2500].groupby("shard")["size"].sum()
    total = out.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    big = out["size"].max()
    assert sizes.sum() and total.max() <= max(big, out["size"].sum() / 8) * 1.05 + 600
    assert op7_sharding.shard(docs_of([])).count() == 0


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, share=1.5, epochs=2):
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    budget, full, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        left, total = budget - sum(full.values()), sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > epochs * sizes[n]} if total else set()
        if not over:
            return {**full, **{n: left * weight[n] / total for n in open_}}
        full |= {n: epochs * sizes[n] for n in over}
        open_ -= over


def test_mixture_meets_its_targets(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), s) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [9, 4, 2, 1, 1], k=900))]
    rows += [(2000, None, "a"), (2001, "", "empty"), (2001, "", "empty"), (None, "x y", "b"), (None, "x y", "b")]
    docs = docs_of(rows)
    out = op8_mixing.mix(docs).toPandas()
    out["source"] = [None if s is None or s != s else s for s in out["source"]]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = fill(sizes)
    assert len(out) == len(rows)
    assert (out["taken"] <= 2 * out["size"]).all()
    for s in sizes:
        mine = out[[x == s for x in out["source"]]]
        assert (mine["source_size"] == sizes[s]).all()
        assert mine["target"].iloc[0] == pytest.approx(want[s])
        assert abs(mine["taken"].sum() - want[s]) <= 25
    again = op8_mixing.mix(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    mixed = op8_mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(count(r["text"]) for r in mixed.collect()) == out["taken"].sum()


def test_mixing_nothing(spark, docs_of):
    assert op8_mixing.mix(docs_of([])).count() == 0
    assert op8_mixing.mixed(docs_of([])).count() == 0


def test_a_larger_budget_takes_all_that_a_smaller_one_takes(spark, docs_of):
    docs = docs_of([(i, "w " * (i % 9), "a") for i in range(300)])
    small = {r["doc_id"] for r in op8_mixing.mix(docs, share=0.3, epochs=1).collect() if r["taken"]}
    large = {r["doc_id"] for r in op8_mixing.mix(docs, share=0.6, epochs=1).collect() if r["taken"]}
    assert small and small < large


def test_repeated_rows_are_taken_to_the_target(spark, docs_of):
    """One doc_id holds most rows of a source, as equal rows and with texts of its own."""
    rows = [(7, "six words are in this text", "x")] * 100 + [(7, f"text number {i}", "x") for i in range(20)] + [(i, "a b c", "y") for i in range(10)]
    out = op8_mixing.mix(docs_of(rows), share=0.77, epochs=2).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 6
    mixed = op8_mixing.mixed(docs_of(rows), share=0.77, epochs=2).collect()
    assert sum(count(r["text"]) for r in mixed) == out["taken"].sum()


@pytest.mark.parametrize("name", ["cut", "of", "passes", "_copy", "row", "copies", "hash", "place", "in", "col"])
def test_mixing_carries_columns_of_any_name(spark, docs_of, name):
    docs = docs_of([(i, "a b c", "y") for i in range(10)]).withColumnRenamed("hash", name)
    out = op8_mixing.mixed(docs)
    assert out.columns == docs.columns and {r[name] for r in out.collect()} == {"x"}


def test_place_is_the_best_dot_product():
    """Against a plain second version."""
    rng = np.random.default_rng(4)
    items = rng.random((200, 3)) / 300
    room = np.full((4, 3), 0.25)
    got = op7_sharding.place(items, room.copy())
    left = [[0.25] * 3 for _ in range(4)]
    order = sorted(range(200), key=lambda i: (-max(items[i]), -sum(items[i]), i))
    for i in order:
        able = [s for s in range(4) if left[s][0] >= items[i][0]]
        best = max(able, key=lambda s: (sum(a * b for a, b in zip(left[s], items[i], strict=True)), -s)) if able else max(range(4), key=lambda s: (left[s][0], -s))
        assert got[i] == best
        left[best] = [a - b for a, b in zip(left[best], items[i], strict=True)]


def test_bins_come_out_even(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(0, 80))), "s") for i in range(4000)] + [(i, "hot " * 30, "s") for i in range(2000)]
    out = op7_sharding.shard(docs_of(rows), shards=5, bin_groups=300).toPandas()
    size = out.groupby("shard")["size"].sum()
    hot = out[out["size"] == 121]["shard"].mode()[0]
    others = size.drop(hot)
    assert others.max() / others.min() < 1.02 and out.groupby("shard")["slot"].max().add(1).sum() == 6000
