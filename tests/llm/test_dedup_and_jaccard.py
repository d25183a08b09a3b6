"""Exact dedup, n-gram Jaccard join, components."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from sparkthrift.llm import common, op6_jaccard, op10_dedup
from sparkthrift.llm.components import connected
from sparkthrift.llm.shingles import shingle_sets, word_hashes


def shingles(text, n=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(1, len(words))))}


def components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    out = []
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label, strict=True) if x == label[i] and r[0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def near_copies(seed, n, base_words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


ODD = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, "One two", "s"), (5, "one TWO", "s"), (6, "one two", "s"), (7, "é" * 50, None), (7, "a b c d e f", "s"), (None, "a b c d e f", "s"), (9, "a b c d e f", "s"), (9, "a b c d e f", "s"), (10, "x " * 30_000, "s"), (11, "x " * 29_999 + "y", "s")]


def test_words_hash_by_place():
    """Thue-Morse words of 1,024 letters collide under any polynomial modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    assert len(set(word_hashes([one, two, b"ab", b"ba"])[0].tolist())) == 4


def paragraphs(n, of):
    rng = random.Random(n)
    pool = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(of)]
    return [(i, "\n".join(rng.sample(pool, 5)), "s") for i in range(n)]


def compared_rows(docs_of, monkeypatch, rows, **options):
    seen = [0]
    compared = op6_jaccard._compared

    def counted(parts, percent):
        seen[0] += parts.count()
        return compared(parts, percent)

    with monkeypatch.context() as m:
        m.setattr(op6_jaccard, "_compared", counted)
        found = op6_jaccard.near_components(docs_of(rows), block_docs=16, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == components(rows)
    return seen[0]


def test_chains_of_shared_paragraphs_do_not_meet(spark, docs_of, monkeypatch):
    """Documents that hang together by paragraphs, as many as documents, are compared in proportion to their number."""
    few, many = (compared_rows(docs_of, monkeypatch, paragraphs(n, n)) for n in (400, 800))
    assert many < 2.4 * few


def test_common_paragraphs_are_no_names_by_themselves(spark, docs_of, monkeypatch):
    """Of forty paragraphs, each in an eighth of the documents, far fewer documents meet than share one."""
    rows = paragraphs(600, 40)
    assert 4 * compared_rows(docs_of, monkeypatch, rows) < compared_rows(docs_of, monkeypatch, rows, hot=10**9)


@pytest.mark.parametrize("hot", [1, 2, 3])
def test_names_lose_no_link(monkeypatch, hot):
    """Documents of shared units of any size: each pair that shares enough has a name in common."""
    rng = random.Random(hot)
    monkeypatch.setattr(op6_jaccard, "HEAVY", 4)
    for _ in range(150):
        weights = [rng.randint(1, 12) for _ in range(8)]
        docs = [sorted(rng.sample(range(8), rng.randint(2, 8))) for _ in range(6)]
        held = [sum(u in d for d in docs) for u in range(8)]
        order = sorted(range(8), key=lambda u: (held[u], u))
        rank = {u: i for i, u in enumerate(order)}
        named = []
        for d in docs:
            mine = sorted((u for u in d if held[u] > 1), key=rank.get)
            size = sum(weights[u] for u in d)
            units = np.repeat(np.array([u + 1000 for u in mine], "<u8"), [weights[u] for u in mine])
            counts = np.repeat([held[u] for u in mine], [weights[u] for u in mine])
            need = -(-75 * size // 100)
            named.append(set(op6_jaccard._names(units, counts, need, hot).tolist()) if len(units) >= need else set())
        for a in range(6):
            for b in range(a):
                both = sum(weights[u] for u in set(docs[a]) & set(docs[b]))
                either = sum(weights[u] for u in set(docs[a]) | set(docs[b]))
                assert 100 * both < 75 * either or named[a] & named[b]


def test_overlaps_are_sums_of_several_fragments(spark, monkeypatch):
    """On sf0.01, that every block is cut by the global order."""
    cuts = []
    compared = op6_jaccard._compared
    monkeypatch.setattr(op6_jaccard, "_compared", lambda parts, percent: cuts.append(parts.agg({"cuts": "min"}).first()[0]) or compared(parts, percent))
    op6_jaccard.near_components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).count()
    assert cuts and min(c for c in cuts if c is not None) >= 4


@pytest.mark.parametrize("cuts", [1, 3])
def test_partial_overlaps_sum_to_the_overlap(cuts):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(2**63), 2**63, 40)) for _ in range(3)]
    sets.append(np.unique(np.concatenate((sets[0][:35], sets[1][:3]))))
    batch = pa.RecordBatch.from_arrays([pa.array(["t"] * 4), pa.array(["p"] * 4), pa.array([cuts] * 4), pa.array(range(4)), pa.array([len(s) for s in sets]), pa.array([s.tolist() for s in sets])], ["task", "part", "cuts", "node", "n", "shared"])
    rows = pa.Table.from_batches(op6_jaccard._cut([batch])).to_pandas()
    total = np.zeros((4, 4), int)
    for _, g in rows.groupby("fragment"):
        for _, m in op6_jaccard._partial(g).iterrows():
            at = np.frombuffer(m["nodes"], "<i8")
            total[np.ix_(at, at)] += np.frombuffer(op6_jaccard.zlib.decompress(m["counts"]), "<u4").reshape(len(at), -1)
    assert all(total[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(4) for b in range(4) if a != b)


@pytest.mark.parametrize("options", [{}, {"block_docs": 2, "block_bytes": 4000, "fragment_shingles": 500}, {"hot": 1}, {"hot": 2, "block_docs": 3}])
def test_jaccard_equals_brute_force(spark, docs_of, options):
    rows = list(ODD)
    for seed in range(4):
        rows += [(100 * (seed + 1) + i, t, "s") for i, t in enumerate(near_copies(seed, 14, 60, 5))]
    found = op6_jaccard.near_components(docs_of(rows), **options)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str)
    assert got == components(rows)


def test_jaccard_of_nothing(spark, docs_of):
    assert op6_jaccard.near_components(docs_of([])).count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark, docs_of):
    rows = [(i, t, "s") for i, t in enumerate(near_copies(9, 6, 80, 1))] + [(50, "quite another text of several words here", "s"), (51, None, "s"), (52, "", "s")]
    docs = docs_of(rows)
    out = op6_jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    want = {c for i, _, c in components(rows)}
    assert {r["doc_id"] for r in out.collect()} == want
    near = near_copies(3, 4, 80, 1)
    rows += [(None, t, "n") for t in near_copies(11, 5, 80, 1)] + [(70, near[0], "s"), (70, near[1], "s"), (70, near[1], "s"), (None, near[2], "s")]
    clash = docs_of(rows).withColumnsRenamed({"hash": "_id", "lang": "label"}).selectExpr("*", "1 as row", "2 as id", "3 as _hash", "4 as text_hash")
    out = op6_jaccard.one_of_each(clash)
    assert out.columns == clash.columns
    got = sorted((str(r["doc_id"]), r["source"]) for r in out.collect())
    assert got == sorted([(str(x), "s") for x in want | {70}] + [("None", "n")])


def test_hash_segments_do_not_change_hashes(monkeypatch):
    texts = [b"a bb  ccc\nD", b"", b"w" * 500 + b" z", "é ü".encode() * 40]
    whole = word_hashes(texts)
    monkeypatch.setattr("sparkthrift.llm.shingles.SEGMENT", 7)
    parts = word_hashes(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert [int(n) for n in shingle_sets(texts)[2]] == [len(shingles(t.decode())) for t in texts]


def test_packed_hashes_come_back():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (op6_jaccard._unpack(op6_jaccard._pack(values)) == values).all()
    assert len(op6_jaccard._unpack(op6_jaccard._pack(values[:0]))) == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(8, 60)] + [(500, 500)]
    rows = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in connected(common.stage(rows, "edges")).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, **{i: 7 for i in range(7, 60)}, 500: 500}


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n, span in ((0, 10), (1, 1), (1, 1 << 40), (1000, 1 << 41), (500, 700)):
        values = np.sort(rng.choice(span, n, replace=False)) if span < 1 << 20 else np.unique(rng.integers(0, span, n))
        values = values.astype(np.uint64)
        data = op10_dedup.golomb_encode(values, span)
        assert (op10_dedup.golomb_decode(data) == values).all()
        if n == 1000:
            assert len(data) < 8 * n * 0.55


def test_exact_groups_equal_brute_force(spark, docs_of):
    rng = random.Random(3)
    rows = [*ODD, *((i, f"text {rng.randrange(20)}", "s") for i in range(20, 90)), (88, "text 1", "s"), (None, "text 1", "s"), (None, "only null", "s"), (None, "only null", "s")]
    got = op10_dedup.exact_groups(docs_of(rows), block_rows=7, owner_rows=5).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    import hashlib

    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["group_size"], r["keep_id"]) == (len(ids), max(known) if known else None)
    for h, ids in by_hash.items():
        kept = [r["doc_id"] for r in got if r["text_sha256"] == h and r["kept"]]
        assert len(kept) == 1 and kept[0] == (max((i for i in ids if i is not None), default=None))


def test_deduplicate_keeps_columns(spark, docs_of):
    docs = docs_of(ODD)
    out = op10_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in ODD})
    clash = docs.withColumnsRenamed({"hash": "_row", "lang": "print"}).selectExpr("*", "1 as row", "2 as place", "3 as _print")
    assert op10_dedup.deduplicate(clash).columns == clash.columns and op10_dedup.deduplicate(clash).count() == len(texts)
    assert op10_dedup.deduplicate(docs_of([])).count() == 0
    assert op10_dedup.exact_groups(docs_of([])).count() == 0
