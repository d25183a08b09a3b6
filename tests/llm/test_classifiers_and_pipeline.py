"""Toxicity, quality, the pipeline and the registered queries."""

import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkthrift.llm import op5_toxicity, op9_quality, queries
from tests.oracle import check

from .test_dedup_and_jaccard import ODD, components

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = pd.Series(scores).rank().to_numpy()  # ties count half
    p = sum(labels)
    return (order[np.array(labels) == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def held_out(frame, name, sf=SF):
    labels = dict(duckdb.sql(f"select doc_id, {name} from '{sf}/labels.parquet'").fetchall())
    rows = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in frame.collect() if r["held_out"] and r["doc_id"] in labels]
    return zip(*rows, strict=True)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # sf0.01 has six toxic rows held out, two of them without any telling word
    frame = op5_toxicity.op5_toxicity(spark, sf).cache()
    scores, labels, predicted = held_out(frame, "toxic", sf)
    assert auc(scores, labels) > 0.95  # a tenth of the toxic rows held out has no telling word: measured 0.963 and 0.973
    assert not any(p and not y for p, y in zip(predicted, labels, strict=True))
    assert np.mean(np.array(labels) == np.array(predicted)) > 0.94
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in frame.limit(50).collect())


def test_toxicity_on_few_rows(spark):
    """On sf0.01, that every toxic row with a telling word comes before every clean one, whatever the layout of the input.

    Two of the six toxic rows held out there share no word, beginning of a word,
    passage, length or language with toxic rows learned from, so their rank is chance.
    """
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, other = (op5_toxicity.toxicity(d, labels).toPandas().sort_values("doc_id") for d in (docs, docs.repartition(7, "text")))
    assert np.allclose(one["score"], other["score"], atol=1e-9)
    told = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    rows = [(s, told[i]) for i, h, s in one[["doc_id", "held_out", "score"]].itertuples(index=False) if h and i in told and i not in (259, 995)]
    assert auc(*zip(*rows, strict=True)) == 1.0
    predicted = {i: s >= 0.5 for i, h, s in one[["doc_id", "held_out", "score"]].itertuples(index=False) if h and i in told}
    assert np.mean([p == told[i] for i, p in predicted.items()]) > 0.94


def test_quality_on_held_out_rows(spark):
    scores, labels, predicted = held_out(op9_quality.op9_quality(spark, SF), "quality")
    assert auc(scores, labels) > 0.97
    assert np.mean(np.array(labels) == np.array(predicted)) > 0.94


@pytest.fixture(scope="module")
def channel(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a loser, such trash is worthless. hello there, the house is nice 2024 455 " * 20) for i in range(8)], "doc_id long, text string")
    return op5_toxicity.Channel(op5_toxicity.letter_model(docs))


TELLING = op5_toxicity.Telling({f: i for i, f in enumerate(f for w in ("idiot", "loser", "trash", "worthless") for f in op5_toxicity.features(w))})


def read(text, channel):
    return op5_toxicity.restore_text(text, channel, {}, TELLING)


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("l0$er", "loser"), ("tr@sh", "trash"), ("idiooooot", "idiot"), ("w*rthless", "worthless"), ("id.iot", "idiot"), ("idiot***", "idiot"), ("(idiot)!!", "idiot"), ("hello", "hello"), ("$ t r a s h", "trash"), ("7r45h", "trash"), ("id* ot", "idiot"), ("id*o t", "idiot"), ("tr*s h", "trash"), ("wor*h less", "worthless"), ("*diot", "idiot"), ("l*s*r", "loser"), ("t r * s h", "trash")])
def test_channel_restores(channel, token, word):
    assert word in read(token, channel)


def best_path(channel, text, gap, cut):
    """Brute force: the best of all paths through a lattice."""
    best = []
    for path in itertools.product(*channel.lattice(text, gap, cut), [(" ", 0.0)]):
        h, total = 0, 0.0
        for letters, cost in path:
            total += cost
            for x in letters:
                s = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27
                total += channel.model[h][s]
                h = (h * 28 + s) % 28**3
        best.append((total, "".join(x for x, _ in path).strip()))
    top = max(best)[0]
    return {made for total, made in best if total > top - 1e-9}


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("text", ["", "1d10t", "a b c", "lo $er", "x!y", "555", "tr@*h", "aaa b", "é1.", "id iot", "4!"])
def test_viterbi_equals_all_paths(channel, text, cut):
    for gap in (op5_toxicity._LOOSE, op5_toxicity._TIGHT):
        assert channel.restore(text, gap, cut) in best_path(channel, text, gap, cut)


def test_digits_are_in_the_lattice(channel):
    assert channel.restore("2024") == "2024"  # a digit may be itself
    assert {x for x, _ in next(channel.lattice("5"))} == {"s", "5"}


@pytest.mark.parametrize("text", ["what an I D I O T he is", "i-d-i-o-t", "you are an i d i o t", "a n i d i o t", "y o u i d i o t", "an i  d  i\to\nt", "1 d 1 0 t", "hello 1 d i o t", "i. d. i. o. t"])
def test_gaps_are_in_the_lattice(channel, text):
    assert "idiot" in read(text, channel)


def test_words_in_chunks(channel):
    for text in ("you are an id iot and a house", "you are an i di\n ot. and", "a lo ser, such"):
        assert {"idiot", "loser"} & read(text, channel)
    assert "idiot" not in read("an id is nice", channel)


@pytest.mark.parametrize("token", ["hello,idiot", "you.idiot", "you/idiot", "you!idiot", "hello,1d10t", "youareanidiot", "youarean" * 80 + "1d10t", ("hello," * 100) + "idiooooot"])
def test_tokens_are_read_to_their_end(channel, token):
    assert "idiot" in read(token, channel)


def test_folding_finds_words_across_parts(channel, monkeypatch):
    text = "x y " * 50 + "1 d 1 . 0 t" + " z" * 50
    whole = sorted(set(TELLING.hits(text)))
    monkeypatch.setattr(op5_toxicity, "PART", 40)
    assert whole and sorted(set(TELLING.hits(text))) == whole


@pytest.mark.parametrize("text", ["1" * 400_000, "ab" * 200_000, "9f" * 200_000, "x " * 200_000, "!" * 300_000, "sh1t" + "x9" * 100_000, "a1 " * 100_000, " " * 2_000_000])
def test_very_long_tokens_end_soon(channel, text):
    began = time.perf_counter()
    read(text, channel)
    assert time.perf_counter() - began < 60


def test_copies_are_no_evidence(spark, docs_of):
    """A word that stands in copies of one toxic text only is not chosen; the telling word is."""
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "nice", "house"], k=30))
    rows = [(i, plain() + (" idiot " + plain() if i % 3 == 0 else ""), "s") for i in range(300)]
    base = "idiot zebra " + plain()
    rows += [(1000 + i, f"{base} {i % 7}", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, int("idiot" in t), 0) for i, t, _ in rows], "doc_id long, toxic int, quality int")
    docs = docs_of([*rows, (5000, "zebra " + plain(), "s"), (5001, plain() + " 1d10t", "s")])
    got = {r["doc_id"]: r["score"] for r in op5_toxicity.toxicity(docs, labels).collect()}
    assert got[5000] < 0.5 < got[5001]


def test_letter_counts_grow_with_all_texts(spark):
    one = spark.createDataFrame([(1, "ab" * 700_000)], "doc_id long, text string").selectExpr("cast(text as binary) b")
    rows = {r["gram"]: r["n"] for r in one.mapInArrow(op5_toxicity._count_letters, "gram long, n long").collect()}
    assert sum(rows.values()) == 1_400_000


def odd_labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(3, 0, None), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_odd_input(spark, docs_of):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "nice"]
    rows = [(i, " ".join(rng.choices(words, k=20) + (["idiot"] if i % 2 else [])) + (" ###" * 20 if i % 2 == 0 else "."), "s") for i in range(200)]
    rows += [(1000, None, None), (1001, "", "s"), (None, "idiot idiot", "s"), (1002, "x" * 300_000, "s"), (1003, "idiot " * 50_000, "s"), (3, rows[3][1], "s")]
    docs = docs_of(rows)
    for found in (op5_toxicity.toxicity(docs, odd_labels(spark)), op9_quality.quality(docs, odd_labels(spark))):
        got = found.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    toxic = {r["doc_id"]: r["score"] for r in op5_toxicity.toxicity(docs, odd_labels(spark)).collect()}
    assert toxic[1] > 0.5 > toxic[2] and toxic[1003] > 0.5 > toxic[1001]
    kept = op5_toxicity.nontoxic(docs, odd_labels(spark))
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    clash = docs.withColumns({"_score": F.lit(1), "score": F.lit(2), "row": F.lit(3), "_text": F.lit("x")})
    assert op5_toxicity.nontoxic(clash, odd_labels(spark)).columns == clash.columns


def test_classifiers_without_labels_or_rows(spark, docs_of):
    none = odd_labels(spark).limit(0)
    docs = docs_of(ODD)
    assert {round(r["score"], 6) for r in op5_toxicity.toxicity(docs, none).collect()} == {0.0}
    assert {r["score"] for r in op9_quality.quality(docs, none).collect()} == {0.0}
    assert op5_toxicity.toxicity(docs_of([]), none).count() == 0
    assert op9_quality.quality(docs_of([]), odd_labels(spark)).count() == 0


def test_risk_is_not_negative_and_prior_is_near():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (1000, 4))
    unl = rng.permutation(np.concatenate((rng.normal(2, 1, (3000, 4)), neg)))
    first = op9_quality.separate(pos[::2], unl[::2])
    others = first.forward(unl[1::2])[0]
    prior = op9_quality.class_prior(first.forward(pos[1::2])[0], lambda cut: ([int((others >= c).sum()) for c in cut], len(others)))
    assert 0.6 < prior < 0.78
    net = op9_quality.fit(pos, unl, prior, steps=600)
    assert (net.forward(rng.normal(2, 1, (500, 4)))[0] > 0).mean() > 0.97 and (net.forward(rng.normal(-2, 1, (500, 4)))[0] < 0).mean() > 0.95


@pytest.mark.parametrize("shift", [0.0, -6.0])
def test_slopes_equal_finite_differences(shift):
    """Of the whole risk, or where the negatives' part is below zero of that part, turned round."""
    rng = np.random.default_rng(3)
    zp, zu, prior = rng.normal(0, 1, 7) - shift, rng.normal(0, 1, 9) + shift, 0.6
    positive, negative, on_p, on_u = op9_quality.risk(zp, zu, prior)
    assert (negative < 0) == (shift < 0)

    def aim(p, u):
        a, b = prior * np.log1p(np.exp(-p)).mean(), np.log1p(np.exp(u)).mean() - prior * np.log1p(np.exp(p)).mean()
        return -b if shift < 0 else a + b

    for slopes, which in ((on_p, zp), (on_u, zu)):
        for i in range(len(which)):
            step = np.zeros(len(which))
            step[i] = 1e-5
            up, down = (aim(zp + s * step, zu) if which is zp else aim(zp, zu + s * step) for s in (1, -1))
            assert slopes[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_a_doc_id_on_a_third_of_all_rows_is_learned_from_once(spark, docs_of):
    rows = [(i, f"a good text, number {i}. It has words.", "s") for i in range(60)] + [(1, f"### {i}", "s") for i in range(30)]
    rows += [(100 + i, "### $$$ " * 9, "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = op9_quality.quality(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


def test_pipeline_stages_keep_their_laws(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    folder = corpus_pipeline.shared_dir(spark) + "-test"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, SF).write.parquet(f"{folder}/{name}")
        before, seen = seen, spark.read.parquet(f"{folder}/{name}")
        if name == "packing":
            break
        assert seen.columns == docs.columns
        texts = [r["text"] for r in before.select("text").collect()]
        left = [(r["doc_id"], r["text"], None) for r in seen.select("doc_id", "text").collect()]
        if name == "toxicity":
            assert 0.8 * docs.count() < len(left) < docs.count()
        if name == "exact_dedup":
            assert sorted(t for _, t, _ in left) == sorted(set(texts))
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"], None) for r in before.select("doc_id", "text").collect()]
            assert {i for i, _, _ in left} == {c for _, _, c in components(rows)}
            assert len(left) < len(texts)
    packed = seen.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert packed[0] > 1024 * (packed[1] - 1)


def write_tables(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    toxic = F.coalesce(F.contains("text", F.lit("idiot")), F.lit(False)).cast("int")
    docs.select("doc_id", F.lit(0).alias("quality"), toxic.alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_odd_tables_and_twice(spark, docs_of, tmp_path):
    rng = random.Random(2)
    rows = [(300 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)) + (" idiot" if i % 9 == 0 else ""), f"s{i % 2}") for i in range(40)]
    rows += [*ODD, (None, None, None), (8, "  ", None), (12, rows[1][1] + " end", "s")]
    folder = write_tables(spark, docs_of(rows), tmp_path / "odd")
    first, second = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    a, b = (sorted(map(str, x.select("doc_id", "start", "length", "ids_crc32").collect())) for x in (first, second))
    assert a and a == b


def test_pipeline_of_nothing(spark, docs_of, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, docs_of([]), tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_registered_query(spark, sf_dir, name):
    frame = queries.queries()[name](spark, sf_dir).toPandas()
    assert len(frame)
    if sql := queries.oracle_sql().get(name):
        check(frame, sql, sf_dir)
