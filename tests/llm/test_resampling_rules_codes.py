"""op11, op12 and op13 against SQL, plain second versions and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkthrift.llm import op11_resampling, op12_quality_rules, op13_codes
from sparkthrift.llm.queries import oracle_sql, queries
from tests.oracle import check


@pytest.mark.parametrize("name", ["op11_resampling", "op12_quality_rules", "op13_codes"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_its_sql(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    check(queries()[name](spark, sf_dir).toPandas(), oracle_sql()[name], sf_dir)


LONG = "Wort " * 70_000 + "Ende"
ODD = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, "same words here " * 4, "a"), (4, "same words here " * 4, "a"), (None, "no id at all", "b"), (5, "É1 é1 Ünder_score x-y", None)]


# --- op11


def _brute_weights(texts, targets, longest, buckets):
    def of(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return Counter(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    docs, s, t = [of(x) for x in texts], Counter(), Counter()
    for found in docs:
        for f, c in found.items():
            s[bucket(f)] += c
    for x in targets:
        for f, c in of(x).items():
            t[bucket(f)] += c
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    return [(f.total(), sum(c * gain[bucket(x)] for x, c in f.items())) for f in docs]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, docs_of, longest):
    rng = random.Random(longest)
    rows = ODD + [(i, " ".join(rng.choices(["Ab", "ç", "d9", "e_f", "the", "of"], k=rng.randint(0, 40))), "s") for i in range(10, 150)]
    targets = [("the of THE",), (None,), ("ç d9",)]
    out = op11_resampling.scored(docs_of(rows), spark.createDataFrame(targets, "text string"), longest=longest, percent=20, pairs=7).toPandas()  # many blocks, and documents larger than one
    brute = _brute_weights([r[1] for r in rows], [t[0] for t in targets], longest, 10_000)

    def score(doc_id, weight):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def key(x):
        return (x[0] is None or x[0] != x[0], 0 if x[0] is None or x[0] != x[0] else int(x[0]), *x[1:])

    want = sorted(((r[0], n, w, score(r[0], w)) for r, (n, w) in zip(rows, brute, strict=True)), key=key)
    got = sorted(map(tuple, out[["doc_id", "n_features", "weight", "score"]].values.tolist()), key=key)
    assert [key(x) for x in got] == [key(x) for x in want]
    words = {i: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower())) for i, r in enumerate(rows)}
    able = sorted([(-score(r[0], brute[i][1]), r[0] is None, r[0] or 0) for i, r in enumerate(rows) if words[i] >= 20])
    drawn = out.dropna(subset=["rank"]).sort_values("rank")
    assert drawn["rank"].tolist() == list(range(1, len(able) * 20 // 100 + 1))
    assert [(-s, i) for s, i in zip(drawn["score"], drawn["doc_id"], strict=True)] == [(s, i) for s, _, i in able[: len(drawn)]]


def test_resampling_odd_inputs(spark, docs_of):
    nothing = spark.createDataFrame([], "text string")
    assert op11_resampling.scored(docs_of([]), nothing).count() == 0
    docs = docs_of(ODD + [(i, f"word{i} " * 30, "s") for i in range(20, 60)]).withColumnRenamed("hash", "rank")
    assert op11_resampling.scored(docs, nothing).count() == len(ODD) + 40
    drawn = op11_resampling.resampled(docs, spark.createDataFrame([("word21 word22",)], "text string"), percent=50)
    assert drawn.columns == docs.columns
    kept = drawn.toPandas()
    assert len(kept) == 20 and set(kept["rank"]) == {"x"} and {21, 22} <= set(kept["doc_id"])


# --- op12


def _brute_rules(rows, least_documents=10, share=0.01, keep=0.3):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def norm(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))

    texts = {}
    for _, text, host in rows:
        texts.setdefault(host, set()).add(text or "")
    docs = {host: Counter(line for t in found for line in {norm(x) for x in t.split("\n") if word.search(x)}) for host, found in texts.items()}
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(5)}
        most = max(least_documents, share * len(texts[host]))
        left = sum(len(word.findall(x)) for x in lines if docs[host][norm(x)] <= most)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, not failed and left >= 10 and left >= keep * len(words), left))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"]


def _sites():
    rng = random.Random(12)
    own = lambda: " ".join("".join(rng.choices("abcdefgé", k=5)) for _ in range(12))
    rows = [(i, f"Share this page {i}  NOW with your friends\n{own()}\n\n{own()}#*", "x.org") for i in range(60)]
    rows += [(100 + i, f"share this\tpage {i} now with your friends and all the others\n" * 2 + f"only {own()[:5]}", "y.org") for i in range(20)]
    rows += [(200 + i, "Share this page 7 NOW with your friends\n" + own(), "z.org") for i in range(5)]
    rows += [(300, "a b c d e f " * 40, None), (301, "x\r\n" * 40 + "a b c d e a b c d e a b c d e f", None)]
    return rows


def test_rules_equal_brute_force(docs_of):
    rows = _sites() + ODD
    got = op12_quality_rules.judge(docs_of(rows)).select(COLUMNS).toPandas()
    assert sorted(map(str, (tuple(None if x != x else int(x) for x in r) for r in got.values.tolist()))) == sorted(map(str, (tuple(None if x is None else int(x) for x in r) for r in _brute_rules(rows))))
    kept = dict(zip(got["doc_id"], got["kept"], strict=True))
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(20)) and all(kept[200 + i] for i in range(5))


def test_rules_copies_count_once(docs_of):
    """A clean text is not boilerplate because it was copied."""
    text = "\n".join(f"{x}one {x}two {x}three {x}four {x}five" for x in "abcdef")
    assert all(r["kept"] for r in op12_quality_rules.judge(docs_of([(i, text, "h") for i in range(50)])).collect())


def test_rules_cleaned(docs_of):
    docs = docs_of(_sites() + ODD).withColumnRenamed("hash", "common")
    out = op12_quality_rules.cleaned(docs)
    assert out.columns == docs.columns
    rows = out.toPandas()
    judged = op12_quality_rules.judge(docs).where("kept").toPandas()
    assert sorted(map(str, rows["doc_id"])) == sorted(map(str, judged["doc_id"]))
    assert not rows[rows["source"] == "x.org"]["text"].str.contains("Share").any()
    assert rows[rows["source"] == "z.org"]["text"].str.contains("Share").all()
    assert op12_quality_rules.cleaned(docs_of([])).count() == op12_quality_rules.judge(docs_of([])).count() == 0


def test_rules_run_no_python(spark, docs_of):
    plan = op12_quality_rules.judge(docs_of(_sites()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- op13


@pytest.mark.parametrize("k", [1, 2, 16, 200])
def test_nearest_entry_equals_all_entries(k):
    rng = np.random.default_rng(k)
    entries = rng.integers(-40, 40, (k, 3)) * rng.integers(1, 30, (k, 1))
    entries[k // 2 :: 3] = entries[0]  # repeated entries: ties to the lowest index
    x = np.concatenate((rng.integers(-60, 60, (500, 3)), entries, np.zeros((3, 3), np.int64), rng.integers(-(1 << 26), 1 << 26, (50, 3))))
    who, far, met = op13_codes.Codebook(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (far == every.min(1)).all()
    if k == 200:
        assert met < 0.5 * every.size  # the annulus leaves most entries out


def _brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(4096 * v) for v in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(3)
        who = far.argmin(2)
        if step < rounds:
            for p in range(parts):
                for e in set(who[:, p].tolist()):
                    books[p, e] = [int(v) // int((who[:, p] == e).sum()) for v in x[who[:, p] == e, p].sum(0)]
    error = far.min(2).sum(1).tolist()
    sums = Counter()
    for r, e in zip(kept, error, strict=True):
        sums[r[2]] += e
    return [(r[0], w.tolist(), e, sums[r[2]], books.ravel().tolist()) for r, w, e in zip(kept, who, error, strict=True)]


def _vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, width))
    return [(i, np.float32(centres[i % 5] + rng.normal(0, 0.1, width)).tolist(), [0, 1, None][i % 3]) for i in range(n)]


DDL = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("n", [300, 9])
def test_codes_equal_brute_force(spark, n):
    rows = _vectors(n, 16)
    rows += [rows[3], (None, rows[4][1], 1), (900, None, 0), (901, [float("nan")] * 16, 0), (902, [float("inf")] + [0.0] * 15, 0), (903, [None] + [0.0] * 15, 0), (904, [], 0), (905, [1.0] * 24, 0), (906, [0.0] * 16, 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], DDL).repartition(5)
    got = [(r["vec_id"], list(r["code"]), r["error"], r["label_error"], list(r["codebooks"])) for r in op13_codes.compress(frame).collect()]
    want = _brute_codes([r for r in rows if r[1] is None or len(r[1]) == 16])
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_codes_odd_inputs(spark):
    assert op13_codes.compress(spark.createDataFrame([], DDL)).count() == 0
    assert op13_codes.compress(spark.createDataFrame([(1, None, 1, "x")], DDL)).count() == 0
    uneven = op13_codes.compress(spark.createDataFrame([(*r, "x") for r in _vectors(40, 13)], DDL)).collect()  # filled up with zeros
    assert len(uneven) == 40 and len(uneven[0]["codebooks"]) == 16 * 16
    large = op13_codes.compress(spark.createDataFrame([(1, [3e38] * 8, 0, "x"), (2, [-3e38] * 8, 0, "x")], DDL), entries=1).collect()
    assert all(0 < r["error"] < 1 << 63 for r in large)
