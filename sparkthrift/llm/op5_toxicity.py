"""Toxicity of texts behind a noisy channel.

Obfuscated words (leetspeak, stretched letters, letters set apart, words in
pieces or run together) are read through a channel model: every character opens
arcs to the letters it may stand for, to itself or to nothing; blanks may go,
and may be missing.  Viterbi decoding finds the likeliest reading under a
character 4-gram model, which counts the letters of every document of the input.

Where the lattice is decoded:

* runs of single characters, and tokens with a mark that may be a letter or
  nothing (``!|+(*``), always;
* elsewhere where a telling word may stand.  Characters that may be one another
  are folded, white space, other marks and repetitions dropped, and the telling
  words, folded alike, are searched for in what is left of the whole text; and
  without one or two letters or up to four vowels, where a star stands among their
  letters.  No reading can hold a telling word anywhere else, but for a word with
  more stars than that, so nothing else needs decoding.  The tokens around a hit (24 characters of them
  on each side) are decoded with their gaps.

Telling words and their beginnings (from four letters on) are weighed by logistic
regression.
Labelled rows: at most ``max_labelled`` (those with the least hash of their id),
never rows that ``lost`` names, and of near copies (equal least shingle hash)
one, so that copies are no evidence.  Words are chosen forward: in each round
those join whose texts have more label 1 than the words chosen before explain,
by a log likelihood ratio above ``evidence`` plus the log of the number of words
tried.  Only what makes label 1 likelier is chosen, so no length of clean text
outweighs abuse.  The number of words has no cap.

Defined cases: null text is empty; an empty text has the score of no evidence;
a null doc_id is never labelled; a doc_id that occurs several times is scored
row by row, and learned from by one of its texts; contradictory labels of one id
count by their maximum; rows of labels without a label are ignored; without both
labels to learn from every score is 1 or 0 (0 without any); extra columns are
carried by ``nontoxic``, whatever their names, and ignored by ``toxicity``; no
rows give no rows.  Texts and tokens are read whole, whatever their length.
Calling ``toxicity`` runs the jobs that learn; scoring is left to the caller.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, combinations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lost, stage, table, text_or_empty
from .shingles import shingle_sets

#: Labelled rows that the classifier learns from, at most.
MAX_LABELLED = 20_000
#: Log likelihood ratio that a feature needs besides the log of the number of features tried.
EVIDENCE = 3.0
#: Rounds of choosing features, at most; those join that reach this share of the round's best.
ROUNDS, SHARE = 6, 1 / 3
#: Readings that a worker remembers, and the longest token or run that it does.
REMEMBERED, SHORT = 400_000, 64
#: Characters of a token that are decoded on each side of a hit.
AROUND = 24
#: Characters that are folded at once.
PART = 1 << 20

# The letters that other characters are used for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "*": "aeiou",
    "(": "c",
    "€": "e",
    "£": "l",
}
#: Marks that may be a letter or nothing.
EITHER = "!|+("

_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_N = 28  # 0: outside a word, 1 to 26: letters, 27: any other byte of a word
_SYMBOL = np.full(256, 27, np.int32)
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = 0
for _i, _c in enumerate(_ALPHABET):
    _SYMBOL[ord(_c)] = _SYMBOL[ord(_c.upper())] = _i + 1
_EDGE = ".,;:?\"'`#%&=~<>[]{}\\/^"
_APART = re.compile(r"(?<!\S)\S[.\-_*,]?(?:\s+\S[.\-_*,]?){2,}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")
_PIECES = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_LONG_RUN = re.compile(r"([^\w])\1\1+")
_TAIL_MARKS = re.compile(r"[!|*+(\-_.]+$")
_OPEN = re.compile(r"[!|+(*]")
_STAR = re.compile(r"(?<!\*)\*{1,2}(?!\*)")
#: Vowels of a word that stars may stand for, at most.
STARS = 4
#: Log probabilities of a gap that stays and one that goes: between single characters, and between other tokens.
_LOOSE, _TIGHT = (-1.5, -0.3), (-0.2, -2.0)
#: Log probability that a star stands for one given consonant.
_ANY = -5.0
#: Log probability of a blank left out between two letters.
_UNSAID = -2.0


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_N**4, np.int64)

    def add(texts: list[bytes]) -> None:
        data = np.frombuffer(b"   ".join([b"", *texts]), np.uint8)  # no window spans two texts' letters
        for lo in range(3, len(data), 1 << 20):  # each window counts once: a part starts 3 bytes back
            s = _SYMBOL[data[lo - 3 : lo + (1 << 20)]]
            total[:] += np.bincount(((s[:-3] * _N + s[1:-2]) * _N + s[2:-1]) * _N + s[3:], minlength=_N**4)

    held, size = [], 0
    for batch in batches:
        for x in batch.column(0):
            held.append(x.as_py())
            size += len(held[-1]) + 3
            if size >= 1 << 20:
                add(held)
                held, size = [], 0
    add(held)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after three others, from all texts (28^4 cells at most)."""
    grams = docs.select(text_or_empty().cast("binary").alias("bytes")).mapInArrow(_count_letters, "gram long, n long")
    rows = grams.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(_N**4)
    count[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    count = count.reshape(-1, _N)
    lower = count.reshape(_N, _N * _N, _N).sum(axis=0)
    lower = (lower + 0.5) / (lower.sum(axis=1, keepdims=True) + 0.5 * _N)
    prior = np.tile(lower, (_N, 1)) * 5
    return np.log((count + prior) / (count.sum(axis=1, keepdims=True) + 5)).astype(np.float32)


class Channel:
    """Reads text: Viterbi over its character lattice."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    @staticmethod
    def lattice(text: str, gap: tuple[float, float] = _LOOSE, cut: bool = False) -> Iterator[list[tuple[str, float]]]:
        """Arcs of each character: (what it stands for, log probability); ``cut`` adds blanks inside tokens."""
        i = 0
        while i < len(text):
            c, run = text[i], 1
            while i + run < len(text) and (text[i + run] == c or c.isspace() and text[i + run].isspace()):
                run += 1
            if c.isspace():
                yield [(" ", gap[0]), ("", gap[1])]
            elif c in LEET and (run <= 2 or c.isdigit()):
                each = [(x, -1.0 - math.log(len(LEET[c]))) for x in LEET[c]]
                each += [(x, _ANY) for x in _ALPHABET if x not in LEET["*"]] if c == "*" else []
                each += [("", -1.5)] if c in EITHER or c == "*" else [(c, -0.5)]
                if cut:
                    each += [(" " + x, cost + _UNSAID) for x, cost in each if x]
                    each += [(" ", -1.5)] if c in EITHER or c == "*" else []
                for _ in range(run):
                    yield each
            elif not c.isalnum():
                yield [("", -1.5), (" ", -1.5)] if cut else [("", -1.5)]
            elif run >= 3 and c.isalpha():
                each = [(c, -0.7), (c * 2, -0.9)]
                yield each + [(" " + x, cost + _UNSAID) for x, cost in each] if cut else each
            else:
                for _ in range(run):
                    yield [(c, 0.0), (" " + c, _UNSAID)] if cut else [(c, 0.0)]
            i += run

    def restore(self, text: str, gap: tuple[float, float] = _LOOSE, cut: bool = False) -> str:
        done: list[str] = []
        best: dict[int, tuple[float, str]] = {0: (0.0, "")}  # last three symbols: best path into them
        for at, choice in enumerate(chain(self.lattice(text, gap, cut), ([(" ", 0.0)],))):
            after: dict[int, tuple[float, str]] = {}
            for history, (score, made) in best.items():
                for letters, cost in choice:
                    h, total = history, score + cost
                    for x in letters:
                        s = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else 27
                        total += self.model[h][s]
                        h = (h * _N + s) % _N**3
                    if h not in after or after[h][0] < total:
                        after[h] = (total, made + letters)
            best = after
            if at % 64 == 63:
                likeliest = max(best.values())[1]
                if len(likeliest) > 256:  # paths have met long before: what they share is settled
                    head = likeliest[:-128]
                    done.append(head)
                    best = {h: (x, made[len(head) :]) for h, (x, made) in best.items() if made.startswith(head)}
        return ("".join(done) + max(best.values())[1]).strip()


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """What stands for one another is one number; 0 is dropped.  In the second table EITHER is dropped too."""
    same = {"l": "i", "g": "b"} | {c: x[0].replace("l", "i").replace("g", "b") for c, x in LEET.items()}
    first = np.array([ord(same.get(chr(i), chr(i))) if chr(i).isalnum() or chr(i) in same and chr(i) != "*" else 0 for i in range(0x3001)], np.uint32)
    second = first.copy()
    second[[ord(c) for c in EITHER]] = 0
    return first, second


_FOLDS = _fold_table()


def _folded(text: str, fold: np.ndarray) -> tuple[str, np.ndarray]:
    """The folded text without repetitions, and where its characters stand."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.where(points < len(fold), fold[np.minimum(points, len(fold) - 1)], points)
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    new = np.ones(len(at), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    return kinds[new].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at[new]


def _starred(word: str) -> set[str]:
    """The folded word without one or two of its letters, or one to ``STARS`` of its vowels, as it stands where stars are dropped."""
    vowels = [i for i, c in enumerate(word) if c in LEET["*"]]
    gone_sets = chain(*(combinations(range(len(word)), n) for n in (1, 2)), *(combinations(vowels, n) for n in range(3, STARS + 1)))
    cut = ("".join(c for i, c in enumerate(word) if i not in gone) for gone in map(set, gone_sets))
    return {x for x in (_folded(w, _FOLDS[0])[0] for w in cut) if len(x) > 1}


class Telling:
    """Finds where the telling words of an index may stand, however they are written."""

    def __init__(self, index: dict[str, int]):
        self.longest = 0
        self.search = self.starred = None
        words = [f[:-1] for f in index if f.endswith("$") and len(f) > 3]
        folded = {_folded(w, _FOLDS[0])[0] for w in words} - {""}
        if folded:
            self.longest = max(map(len, folded))
            self.search = self._automaton(folded)
        if starred := {x for w in words for x in _starred(w)}:
            self.starred = self._automaton(starred)

    @staticmethod
    def _automaton(folded: set[str]) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for x in sorted(folded):
            made.add_word(x, len(x))
        made.make_automaton()
        return made

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(begin, end) of each place where a folded telling word stands, or stands but for letters where a star is."""
        if not self.search:
            return
        stars = [x.start() for x in _STAR.finditer(text)] if self.starred else []
        for fold in _FOLDS if any(c in text for c in EITHER) else _FOLDS[:1]:
            lo = 0
            while lo < len(text):
                folded, at = _folded(text[lo : lo + PART], fold)
                for last, n in self.search.iter(folded):
                    yield lo + int(at[last - n + 1]), lo + int(at[last]) + 1
                for last, n in self.starred.iter(folded) if stars else ():
                    # a star that is the first or the last letter stands beside what is left
                    begin, end = lo + (int(at[last - n]) + 1 if last >= n else 0), lo + (int(at[last + 1]) if last + 1 < len(at) else len(text) - lo)
                    first = bisect_left(stars, begin)
                    if first < len(stars) and stars[first] < end:
                        inner = stars[first : bisect_left(stars, end, first)]
                        yield min(inner[-1], lo + int(at[last - n + 1])), max(inner[0], lo + int(at[last])) + 1
                if lo + PART >= len(text):
                    break
                # the next part begins where a word that the cut may have split can begin
                lo = max(lo + 1, lo + int(at[-self.longest])) if len(at) > self.longest else lo + PART - 1

    def places(self, text: str) -> set[str]:
        """The pieces of text around the hits, without those that are such a word as it is."""
        found = set()
        for begin, end in self.hits(text):
            low, high = max(0, begin - AROUND), end + AROUND
            left = max((x.end() for x in _BLANK.finditer(text, low, begin)), default=low)
            right = _BLANK.search(text, end, high)
            right = right.start() if right else min(len(text), high)
            piece = text[left:right]
            if right - left != end - begin or not piece.isalpha() or _STRETCHED.search(piece):
                found.add(piece)
        return found


def _remember(known: dict, key: tuple, make: Callable[[], str]) -> str:
    if key not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        made = make()
        if len(key[1]) > 4 * SHORT:
            return made
        known[key] = made
    return known[key]


def apart(text: str, channel: Channel, known: dict) -> set[str]:
    """Words of runs of single characters."""
    runs = {x.group() for x in _APART.finditer(text)}
    return {w for run in runs if _LETTER.search(run) for w in _remember(known, ("apart", run), lambda run=run: channel.restore(run)).split()}


def found_at(places: set[str], channel: Channel, known: dict) -> set[str]:
    """Words of the likeliest reading of each place, with its gaps and without the blanks it may lack."""
    words = set()
    for place in places:
        single = max(len(x.strip(_EDGE + "-_*")) for x in place.split()) <= 1
        words.update(_remember(known, ("place", place), lambda place=place, gap=_LOOSE if single else _TIGHT: channel.restore(place, gap, cut=True)).split())
    return words


def _bare(word: str) -> str:
    return _TAIL_MARKS.sub("", _LONG_RUN.sub("", word)).strip(_EDGE)


def words(token: str, channel: Channel, known: dict) -> set[str]:
    """The words of a token by itself: its letters between other characters, and its reading if a mark in it is open."""
    word = token.strip(_EDGE)
    if word.isalpha():
        return {word}
    word = _bare(word)
    if word.isalpha():
        return {word}
    found = {*_PIECES.findall(word)}
    if _OPEN.search(word):
        found.update(_remember(known, ("cut", word), lambda: channel.restore(word, cut=True)).split())
    return found


def decoded(token: str, channel: Channel, known: dict) -> set[str]:
    """The words of a token read as a whole: what learning tries as features."""
    found = words(token, channel, known)
    word = _bare(token.strip(_EDGE))
    if len(word) <= SHORT and (not word.isalpha() or _STRETCHED.search(word)):
        found |= {_remember(known, ("whole", word), lambda: channel.restore(word))}
    return found


def restore_text(text: str, channel: Channel, known: dict, telling: Telling) -> set[str]:
    """The distinct restored words of a text."""
    text = text.lower()
    found = {w for t in {*text.split()} for w in words(t, channel, known)}
    return found | found_at(telling.places(text), channel, known) | apart(text, channel, known)


def features(word: str) -> list[str]:
    if not word:
        return []
    return [word + "$", *(word[:n] for n in range(4, min(len(word), 8) + 1))]


def _candidates(model: np.ndarray):
    def run(batches):
        channel, known = Channel(model), {}

        class Tried(dict):
            def __missing__(self, token: str) -> set[str]:
                if len(self) >= REMEMBERED:
                    self.clear()
                found = decoded(token, channel, known)
                if len(token) <= SHORT:
                    self[token] = found
                return found

        tried = Tried()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py().lower()
                found = {w for t in {*text.split()} for w in tried[t]} | apart(text, channel, known)
                found.discard("")
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(found), doc.type), pa.array([*found], pa.string())], ["doc", "word"])

    return run


def _reader(model: np.ndarray, index: dict[str, int]) -> Callable[[str], dict[int, int]]:
    """Counts, for a text, the restored words that have each feature of the index."""
    channel, known, telling = Channel(model), {}, Telling(index)
    heads = {f[:4] for f in index}
    remembered: dict[str, list[tuple[str, list[int]]]] = {}  # tokens with such words
    without: set[str] = set()

    def weighed(found: set[str]) -> list[tuple[str, list[int]]]:
        return [(w, hits) for w in found if (w + "$")[:4] in heads and (hits := [index[f] for f in features(w) if f in index])]

    def read(text: str) -> dict[int, int]:
        text = text.lower()
        hit: dict[str, list[int]] = {}
        for token in {*text.split()} - without:
            found = remembered.get(token)
            if found is None:
                found = weighed(words(token, channel, known))
                if len(token) <= SHORT and found:
                    remembered[token] = found
                elif len(token) <= SHORT:
                    without.add(token)
            hit.update(found)
        if len(without) + len(remembered) > REMEMBERED:
            without.clear()
            remembered.clear()
        hit.update(weighed(apart(text, channel, known) | found_at(telling.places(text), channel, known)))
        counts: dict[int, int] = {}
        for hits in hit.values():
            for f in hits:
                counts[f] = counts.get(f, 0) + 1
        return counts

    return read


def _present(model: np.ndarray, index: dict[str, int]):
    def run(batches):
        read = _reader(model, index)
        for batch in batches:
            rows = [read(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[*r] for r in rows], pa.list_(pa.int32())), pa.array([[*r.values()] for r in rows], pa.list_(pa.int32()))], ["doc", "at", "n"])

    return run


def logistic(at: list, n: list, y: np.ndarray, width: int, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse counts, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(y)), [len(x) for x in at])
    col = np.concatenate([np.asarray(x, np.int64) for x in at]) if len(row) else np.empty(0, np.int64)
    val = np.log1p(np.concatenate([np.asarray(x, float) for x in n])) if len(row) else np.empty(0)
    weight, bias = np.zeros(width), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(row, val * weight[col], minlength=len(y)) + bias
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, val * gap[row], minlength=width) / len(y) + penalty * weight
        gb = gap.mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - step / (steps + 1))
        weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return weight, bias


def _score(model: np.ndarray, index: dict[str, int], weight: list[float], bias: float):
    def run(batches):
        read = _reader(model, index)
        for batch in batches:
            scores = []
            for x in batch.column(1):
                z = bias + sum(weight[f] * math.log1p(c) for f, c in sorted(read(x.as_py()).items()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, name: str, max_labelled: int) -> DataFrame:
    """(doc, label, text) of the bounded sample of labelled rows: one row an id and one of near copies; staged."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~lost()).groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    sample = stage(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "sample")
    mine = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = mine.select("doc_id", "label", "text").mapInArrow(_sketched, f"doc {kind}, label int, text string, sketch long")
    one = stage(told.groupBy("doc").agg(F.min(F.struct("sketch", "text", "label")).alias("x")).select("doc", "x.*"), "told")
    copies = one.groupBy("sketch").agg(F.min("doc").alias("doc"))  # by id, so that the layout of the input changes nothing
    return stage(one.join(F.broadcast(copies), ["sketch", "doc"]).select("doc", "label", "text"), "labelled")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = []
        for x in batch.column("text"):
            found = shingle_sets([x.as_py().encode()])[0]
            least.append(int(found.min().view(np.int64)) if len(found) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["doc", "label", "text", "sketch"])


def _logs(a: str, e: str) -> Column:
    return F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / F.col(e))).otherwise(0.0)


def choose(pairs: DataFrame, known: pd.DataFrame, evidence: float) -> list[str]:
    """Words that tell label 1, by forward choice over staged ``pairs`` (doc, word); ``known`` has doc and label."""
    spark, y = pairs.sparkSession, known["label"].to_numpy(float)
    chosen: list[str] = []
    chance = np.full(len(y), y.mean())
    for _ in range(ROUNDS):
        told = known.assign(y=y, p=np.clip(chance, 1e-3, 1 - 1e-3))[["doc", "y", "p"]]
        told = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(told, preserve_index=False)))
        # a: rows of label 1 with the word, e: how many of them are explained; the exponent of Chernoff's bound
        sums = pairs.join(told, "doc").groupBy("word").agg(F.sum("y").alias("a"), F.sum("p").alias("e"), F.count(F.lit(1)).alias("n")).where("n >= 2")
        sums = sums.withColumns({"b": F.col("n") - F.col("a"), "rest": F.col("n") - F.col("e")})
        sums = stage(sums.select("word", F.when((F.col("a") >= 2) & (F.col("a") > F.col("e")), _logs("a", "e") + _logs("b", "rest")).alias("gain")), "sums")
        count, top = sums.agg(F.count(F.lit(1)), F.max("gain")).first()
        least = evidence + math.log(max(1, count))
        new = [] if top is None or top <= least else [r["word"] for r in sums.where(F.col("gain") >= max(least, SHARE * top)).select("word").orderBy("word").collect()]
        new = [x for x in new if x not in set(chosen)]
        if not new:
            break
        chosen += new
        index = spark.createDataFrame([(x, i) for i, x in enumerate(chosen)], "word string, i int")
        hits = pairs.join(F.broadcast(index), "word").select("doc", "i").toPandas().groupby("doc")["i"].apply(sorted)
        at = [hits.get(d, []) for d in known["doc"]]
        weight, bias = logistic(at, [[1] * len(x) for x in at], y, len(chosen), 1e-4, 150)
        chance = np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, bias + math.log(2) * sum(weight[i] for i in x))))) for x in at])
    return sorted(chosen)


def scored(docs: DataFrame, labels: DataFrame, carry: str = "*", max_labelled: int = MAX_LABELLED, evidence: float = EVIDENCE) -> DataFrame:
    """(row, score): each row of ``docs`` (what of it is carried) as a struct, with its score; learns from ``labels`` (doc_id, toxic)."""
    model = letter_model(docs)
    learn = labelled(docs, labels, "toxic", max_labelled)
    known = learn.select("doc", "label").toPandas().sort_values(["doc"], kind="stable").reset_index(drop=True)
    pos = int(known["label"].sum())
    index, weight, bias = {}, [], 30.0 if pos else -30.0
    if 0 < pos < len(known):
        spread = learn.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
        kind = learn.schema["doc"].dataType.simpleString()
        pairs = stage(spread.select("doc", "text").mapInArrow(_candidates(model), f"doc {kind}, word string"), "pairs")
        index = {f: i for i, f in enumerate(sorted({f for w in choose(pairs, known, evidence) for f in features(w)}))}
        rows = spread.select("doc", "text").mapInArrow(_present(model, index), f"doc {kind}, at array<int>, n array<int>").toPandas()
        rows = known.merge(rows, "left", on="doc")
        fitted, bias = logistic(list(rows["at"]), list(rows["n"]), rows["label"].to_numpy(float), len(index), 1e-5, 800)
        weight = fitted.tolist()
    carried = docs.select(F.struct(carry).alias("row"), text_or_empty().alias("text"))
    return carried.mapInArrow(_score(model, index, weight, bias), f"row {carried.schema['row'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``."""
    rows = scored(docs, labels, "doc_id", **limits)
    return rows.select("row.doc_id", lost("row.doc_id").alias("held_out"), "score")


def nontoxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **limits: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return scored(docs, labels, **limits).where(F.col("score") < threshold).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
