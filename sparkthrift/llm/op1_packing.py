"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of the tokens of its documents.  A scheduler serves the
queues in quanta; a source of weight w is owed its next quantum j at virtual
time (2j + 1) / w, so serving the earliest owed quantum next is deficit
round-robin whose deficits carry over from window to window.  The number of
quanta any source has had before quantum j of source s is a closed form of
(s, j), so each partition finds the windows of its own tokens from the queues'
totals and its documents' places in the queues: deficits carry over from
partition to partition without a task that sees them all.

The quanta follow one another without gaps, and windows of ``window`` tokens
are cut from that one stream: only the last sequence has padding.  By default
a source's weight is its share of all tokens, so that all queues run dry
together; with other ``weights`` a dry queue's share goes to the others.

Defined cases: null or empty text is one token, the end id; a null source is a
queue of its own; repeated rows and ids are documents of their own; a null
doc_id stays null; texts are read whole, whatever their length; a text that
holds an added token's characters gets that token's id, as the tokenizer by
default does; extra columns are ignored; no rows give no rows.  Totals of the sources (one number each) are
held on the driver, and each quantum's position takes time in proportion to them:
sources are the mixture's queues, not its documents.  Calling ``pack`` runs the
jobs that tokenise; cutting into pieces is left to the caller.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, stage, table, text_or_empty

#: Pieces between blanks whose ids a worker remembers.
REMEMBERED = 300_000
#: Characters of a piece, at most, for the faster encoder, whose pattern matcher fails on very long white space.
FAST_CHARS = 2_000

_encoders: dict[str, Encoder] = {}


class Encoder(dict):
    """Ids of a ``tokenizers`` file as little-endian bytes; remembers pieces between blanks.

    A blank that no white space follows starts a new token whatever comes before,
    so texts are encoded piece by piece with the same ids.  Short pieces without
    added tokens go through the same vocabulary's faster encoder.
    """

    cuts = re.compile(r" (?=\S)")
    spaced = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = Tokenizer.from_file(path)
        self.added = [x.content for x in self.own.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def bytes_of(self, text: str) -> bytes:
        if len(text) > FAST_CHARS or any(x in text for x in self.added):
            return np.array(self.own.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return np.array(self.fast(text), self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.bytes_of(" " + piece)
        if len(piece) < 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        first, *pieces = self.cuts.split(text) if self.spaced.search(text) else text.split(" ")
        return self.bytes_of(first) + b"".join(map(self.__getitem__, pieces))


def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks, pattern)
    return _encoders[path]


def _tokenize(path: str, ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, ranks, pattern)
        block, places, end = TaskContext.get().partitionId(), {}, np.zeros(1, code.kind).tobytes()
        for batch in batches:
            for part in range(0, len(batch), 512):
                rows = batch.slice(part, 512)
                ids = [code.encode(x.as_py()) + end for x in rows.column(2)]
                tokens = [len(x) // len(end) for x in ids]
                places_of = []
                for source, n in zip(rows.column(1).to_pylist(), tokens, strict=True):
                    at = places.get(source, 0)
                    places_of.append(at)
                    places[source] = at + n
                columns = [rows.column(0), rows.column(1), pa.array([block] * len(rows), pa.int64()), pa.array(places_of, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "block", "place", "tokens", "ids"])

    return run


class Schedule:
    """Positions of the queues' tokens in the one packed stream."""

    def __init__(self, totals: list[int], weights: list[float] | None, quantum: int):
        self.totals = np.array(totals, np.int64)
        self.quantum = quantum
        self.quanta = -(-self.totals // quantum)
        most = int(self.quanta.max(initial=1))
        exact = self.quanta.tolist() if weights is None else [max(1, round(w / max(weights) * (1 << 20))) for w in weights]
        while max(exact, default=1) * 2 * (most + 1) >= 1 << 62:
            exact = [max(1, x >> 1) for x in exact]
        self.weights = np.maximum(np.array(exact, np.int64), 1)

    def position(self, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Tokens before quantum ``turn`` of queue ``source``."""
        own = self.weights[source]
        before = np.zeros(len(turn), np.int64)
        for s in range(len(self.totals)):
            owed = (2 * turn + 1) * self.weights[s]
            odd = np.where(source > s, owed, owed - 1) // own  # ties go to the earlier queue
            count = np.where(source == s, turn, np.minimum((odd + 1) // 2, self.quanta[s]))
            before += np.minimum(count * self.quantum, self.totals[s])
        return before


def _pieces(schedule: Schedule, names: dict, window: int, kind: str, keep_ids: bool):
    q = schedule.quantum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, len(whole), 1024):
                batch = whole.slice(part, 1024)
                source = np.array([names[x] for x in batch.column(1).to_pylist()], np.int64)
                begin = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                end = begin + tokens
                first = begin // q
                turns = (end - 1) // q - first + 1
                doc = np.repeat(np.arange(len(begin)), turns)
                turn = np.arange(len(doc)) - np.repeat(np.cumsum(turns) - turns, turns) + first[doc]
                lo, hi = np.maximum(begin[doc], turn * q), np.minimum(end[doc], (turn + 1) * q)
                at = schedule.position(source[doc], turn) + lo - turn * q
                cuts = (at + hi - lo - 1) // window - at // window + 1  # a quantum may cross windows
                row = np.repeat(np.arange(len(doc)), cuts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                left = np.maximum(at[row], (at[row] // window + nth) * window)
                right = np.minimum(at[row] + (hi - lo)[row], (at[row] // window + nth + 1) * window)
                start = lo[row] - begin[doc[row]] + left - at[row]
                doc = doc[row]
                new = np.ones(len(doc), bool)  # neighbours in the stream and in one window are one piece
                new[1:] = (doc[1:] != doc[:-1]) | (left[1:] != right[:-1]) | (left[1:] % window == 0)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(doc)) - 1
                doc, start, left, length = doc[head], start[head], left[head], right[tail] - left[head]
                ids = [np.frombuffer(x.as_py(), kind).astype("<u4").tobytes() for x in batch.column(4)]
                cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(tokens[doc]), pa.array(left // window), pa.array(left % window), batch.column(1).take(pa.array(doc))]
                labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
                if keep_ids:
                    columns.append(pa.array(cut, pa.binary()))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def pack(docs: DataFrame, *, tokenizer_path: str, ranks_path: str, pattern: str, window: int = 1024, quantum: int = 128, weights: dict[str | None, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights`` are target proportions by source (all sources present must have
    one; default: each source's share of all tokens).  ``keep_ids`` adds the
    piece's ids as little-endian unsigned 32-bit integers.
    """
    if not 1 <= quantum <= window:
        raise ValueError("quantum must be between 1 and window")
    coded = docs.select("doc_id", "source", text_or_empty().alias("text")).mapInArrow(_tokenize(tokenizer_path, ranks_path, pattern), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, block long, place long, tokens long, ids binary")
    coded = stage(coded, "coded")
    parts = stage(coded.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "parts")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = stage(parts.select(F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "places")
    totals = sorted(parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect(), key=lambda r: (r["source"] is None, r["source"]))
    names = {r["source"]: i for i, r in enumerate(totals)}
    chosen = None if weights is None else [float(weights[r["source"]]) for r in totals]
    schedule = Schedule([r["tokens"] for r in totals], chosen, quantum)
    kind = encoder(tokenizer_path, ranks_path, pattern).kind
    placed = coded.join(bounded(places), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    placed = placed.select("doc_id", "source", (F.col("base") + F.col("place")).alias("begin"), "tokens", "ids")
    columns = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return placed.mapInArrow(_pieces(schedule, names, window, kind, keep_ids), columns + (", ids binary" if keep_ids else ""))


def public_tokenizer() -> dict[str, str]:
    """The 50k byte-level BPE vocabulary, the same as ranks, and its pattern."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), **public_tokenizer())
