"""Neighbours, WARC and chat formatting against brute force and round trips."""

import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkthrift.llm import op2_ann, op3_warc, op4_chat


def neighbours(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scored = sorted((-(v * w).sum(), i) for i, w in good.items() if i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


ODD = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [float("inf")] + [1.0] * 15), (1080, [None] + [1.0] * 15), (1100, [1.0] * 3), (None, [1.0] * 16), (1120, [])]


def test_neighbours_equal_brute_force_if_all_are_probed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.5, 1, 3])).tolist()) for i in range(300)] + ODD
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = op2_ann.nearest(frame, k=5, index_rows=50, query_rows=8).toPandas()
    want = neighbours(rows, 5, 20)
    assert set(got["query_id"]) == {q for q in want if want[q]}
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (g["score"].diff().dropna() <= 1e-12).all()
        hits += len(set(g["vec_id"]) & set(want[q]))
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 0.5])]])
def test_few_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"]) for r in op2_ann.nearest(frame).collect()]
    assert got == ([(0, 1)] if len(rows) == 2 else [])


def test_probing_finds_every_code_of_the_radius():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 16, (400, 4), dtype=np.uint16)
    code[200:] = code[:200] ^ (1 << rng.integers(0, 16, (200, 4))).astype(np.uint16)
    index = op2_ann.Index(code)
    for radius in (0, 1, 3, 4, 7, 22, 30, 64):
        for q in code[:20]:
            assert index.within(q, radius).tolist() == np.flatnonzero(op2_ann.distances(code, q) <= radius).tolist()


def test_recall_on_the_embeddings(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in frame.select("vec_id", F.col("embedding").cast("array<double>")).collect()]
    want, got = neighbours(rows, 20, 20), op2_ann.op2_ann(spark, sf_dir).toPandas()
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.9 * sum(map(len, want.values()))


PAGES = [(1, "http://a", "x" * 100), (2, "http://b/%41?q= é", "x" * 100), (3, None, "x" * 99), (4, "u\r\nWARC-Type: evil", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "body\r\n\r\nWARC/1.1\r\n\x1f\x08 é" * 9), (None, "n", "x" * 100), (9, "u", "z" * 3_000_000), (10, "u", "t" * 120), (10, "u", "t" * 120), (None, "u", "v" * 130), (None, "u", "v" * 130)]


def archive(spark, tmp_path, rows, **options):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int")
    op3_warc.write_archives(frame, f"{tmp_path}/warc", **options)
    return f"{tmp_path}/warc"


def test_round_trip(spark, tmp_path):
    path = archive(spark, tmp_path, PAGES, chunk_bytes=2000)
    got = op3_warc.read_archives(spark, path).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(PAGES)
    key = lambda r: str(r)
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"]) for r in got), key=key) == sorted(((i, u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in PAGES), key=key)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] >= 100 and r["record_type"] == "revisit"), key=key)
    assert kinds == sorted([(2, "revisit", 1), (None, "revisit", 1), (10, "revisit", 10), (None, "revisit", None)], key=key)
    texts = {h or "" for _, _, h in PAGES}
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == texts


def test_long_urls_come_back(spark, tmp_path):
    rows = [(1, "http://a/" + "x" * 3_000_000, "one " * 50), (2, "http://b/" + "\u00e9" * 700_000, "two " * 50), (3, "u", "three")]
    got = op3_warc.read_archives(spark, archive(spark, tmp_path, rows)).collect()
    assert sorted((r["kind"], r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == [("record", *r) for r in rows]


def test_plain_records_with_long_headers():
    whole = b"".join(op3_warc.record(i, "u" * 2_000_000, b"x", hashlib.sha256(b"x").hexdigest(), None, True) for i in range(2))
    assert [(k, h["warc-page-id"]) for k, _, _, h, _ in op3_warc.salvage(whole)] == [("record", "0"), ("record", "1")]


def test_files_are_gzip_members_of_warc_records(spark, tmp_path):
    path = archive(spark, tmp_path, PAGES[:3])
    for name in os.listdir(path):
        if name.startswith("part"):
            with open(f"{path}/{name}", "rb") as f:
                data = gzip.decompress(f.read())
            assert data == b"" or data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def records(n=6):
    made = [op3_warc.record(i, f"u{i}", f"payload {i} ".encode() * 20, hashlib.sha256(f"payload {i} ".encode() * 20).hexdigest(), None, True) for i in range(n)]
    return made


@pytest.mark.parametrize("pack", [op3_warc._member, bytes])
@pytest.mark.parametrize("harm", ["flip", "cut", "insert", "tail", "head"])
def test_salvage_recovers_later_records(pack, harm):
    parts = [pack(r) for r in records()]
    whole = b"".join(parts)
    at = len(b"".join(parts[:3])) - 40
    data = {"flip": whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :], "cut": whole[: at - 9] + whole[at + 9 :], "insert": whole[:at] + b"\x1f\x8b\x08WARC/1.1\r\n" + whole[at:], "tail": whole[:-7], "head": whole[7:]}[harm]
    found = list(op3_warc.salvage(data))
    ids = [int(h["warc-page-id"]) for k, _, _, h, _ in found if k == "record"]
    # a member that lacks its last bytes still inflates to its whole record
    assert ids == {"tail": [0, 1, 2, 3, 4, 5] if pack is op3_warc._member else [0, 1, 2, 3, 4], "head": [1, 2, 3, 4, 5]}.get(harm, [0, 1, 3, 4, 5])
    edges = [x for _, a, b, _, _ in found for x in (a, b)]
    assert edges[0] == 0 and edges[-1] == len(data) and edges[1:-1:2] == edges[2::2]
    assert sum(k == "gap" for k, *_ in found) == 1


def test_members_of_several_records_and_damaged_ones():
    made = records()
    several = op3_warc._member(b"".join(made[:3])) + op3_warc._member(made[3])
    found = list(op3_warc.salvage(several))
    assert [(k, h["warc-page-id"]) for k, _, _, h, _ in found] == [("record", str(i)) for i in range(4)]
    for harmed in (several[: len(several) - len(op3_warc._member(made[3])) - 20], op3_warc._member(b"".join(made[:2]) + b"noise" + made[2])):
        found = list(op3_warc.salvage(harmed))
        ids = [h["warc-page-id"] for k, _, _, h, _ in found if k == "record"]
        assert ids == ["0", "1"] + (["2"] if b"noise" in op3_warc._inflate(memoryview(harmed), 0)[0] else [])
        edges = [x for _, a, b, _, _ in found for x in (a, b)]
        assert edges[0] == 0 and edges[-1] == len(harmed) and edges[1:-1:2] == edges[2::2] and sum(k == "gap" for k, *_ in found) == 1


def test_damaged_archives_are_read_by_spark(spark, tmp_path):
    """The quarantine log against what was cut out."""
    path = archive(spark, tmp_path, [(i, "u", f"page {i} " * 30) for i in range(40)], chunk_bytes=1 << 20)
    lost = 0
    for name in sorted(os.listdir(path)):
        if name.startswith("part") and os.path.getsize(f"{path}/{name}") > 1000:
            with open(f"{path}/{name}", "rb") as f:
                data = f.read()
            with open(f"{path}/{name}", "wb") as f:
                f.write(data[:300] + data[310:])
            os.remove(f"{path}/.{name}.crc")
            lost += 1
    rows = op3_warc.read_archives(spark, path).collect()
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert lost and len(gaps) == lost and all(r["end"] > r["begin"] for r in gaps)
    assert sum(r["kind"] == "record" for r in rows) == 40 - lost


def test_salvage_of_nothing_and_of_noise():
    assert list(op3_warc.salvage(b"")) == [] and list(op3_warc.salvage(op3_warc.EMPTY_MEMBER)) == []
    assert [(k, a, b) for k, a, b, _, _ in op3_warc.salvage(b"WARC/1.1\r\n\x1f\x8b\x08 noise")] == [("gap", 0, 19)]


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>\n[INST:1]user[/INST]b</s>\n"), (1, 2, "assistant", "[\\INST: <\\\\/s> [INST:"), (2, 0, None, None), (2, None, "assistant", ""), (2, 1, "role[/INST]x", "[/INST]"), (3, 0, "assistant", "\U0001f600é\n"), (3, 0, "assistant", "\U0001f600é\n"), (None, 0, "user", "null conv"), (4, 0, "user", "$1 \\ x" * 20_000), (5, 0, "assistant", "x</s>"), (5, 1, "assistant", "\n[INST:0]")]


def test_chats_come_back(spark):
    frame = spark.createDataFrame([(*r, 0) for r in CHATS], "conv_id long, turn long, role string, text string, formatted int")
    chats = op4_chat.format_chats(frame)
    got = {r["conv_id"]: r for r in op4_chat.read_chats(chats).collect()}
    raw = {r["conv_id"]: r for r in chats.collect()}
    for conv in {c for c, *_ in CHATS}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in CHATS if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(raw[conv]["formatted"]))
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_no_chats(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op4_chat.read_chats(op4_chat.format_chats(frame)).count() == 0


def test_escaping_is_reversible(spark):
    texts = ["", "</s>", "<\\/s>", "<\\\\/s>[INST:[/INST]", "[[/INST]", "<</s>", "\\</s>", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in rows.select("t", op4_chat.escape(F.col("t")), op4_chat.unescape(op4_chat.escape(F.col("t")))).collect():
        assert u == t and not any(mark in e for mark in ("</s>", "[INST:", "[/INST]"))


BROKEN = ["\u00b3", "9" * 5000, "-" + "9" * 30, "0x1", "", " ", "1.5", "\u0661", "\u221e", "9223372036854775808", "-9223372036854775808"]


@pytest.mark.parametrize("value", BROKEN)
@pytest.mark.parametrize("field", ["Content-Length", "WARC-Page-Id", "WARC-Payload-Length", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Type"])
def test_no_header_value_stops_the_reader(spark, field, value):
    from sparkthrift.llm.op3_warc import record

    good = record(1, "http://a", b"x" * 200, "d", None, True)
    lines = good.split(b"\r\n")
    bad = b"\r\n".join(f"{field}: {value}".encode() if x.lower().startswith(field.lower().encode() + b":") else x for x in lines)
    rows = _read_all(bad + good)
    assert [r for r in rows if r["kind"] == "record"][-1]["page_id"] == 1


def _read_all(content):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([content], pa.binary())], ["path", "content"])
    return [r for b in op3_warc._read([batch]) for r in b.to_pylist()]


@pytest.mark.parametrize("digest", ["shake_128:00", "sha1:", ":", "sha256", "SHA256:xyz", "md5:" + "0" * 32])
def test_a_digest_that_does_not_hold_is_a_failed_check(digest):
    from sparkthrift.llm.op3_warc import record

    good = record(1, "http://a", b"x" * 200, "d", None, True)
    bad = b"\r\n".join(b"WARC-Block-Digest: " + digest.encode() if x.startswith(b"WARC-Block-Digest") else x for x in good.split(b"\r\n"))
    assert [r["kind"] for r in _read_all(bad + good)] == (["record", "record"] if digest == ":" else ["gap", "record"])


def test_ten_thousand_mutated_archives_are_read():
    import gzip
    import random

    from sparkthrift.llm.op3_warc import record

    rng = random.Random(5)
    plain = [record(i, f"http://a/{i}", b"payload %d " % i * 20, "d", None, True) for i in range(3)]
    for turn in range(10_000):
        members = [gzip.compress(x, 1) for x in plain] if turn % 2 else plain
        data = bytearray(b"".join(members))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data) if turn % 3 else min(len(data), 700))
            kind = rng.randrange(4)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                del data[at : at + rng.randint(1, 40)]
            elif kind == 2:
                data[at:at] = bytes(rng.choices(range(256), k=rng.randint(1, 20)))
            else:
                data[at : at + 3] = rng.choice([b"\r\n\r\n", b"\xc2\xb3", b"99999999999999999999", b"WARC/1.1\r\n", b"\x1f\x8b\x08"])
        rows = _read_all(bytes(data))
        assert all(r["begin"] <= r["end"] for r in rows)
