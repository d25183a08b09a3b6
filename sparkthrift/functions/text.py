"""Column builders for request text: white space, tokens, spans, tiers, checks.

All are Catalyst expressions over string columns; null stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text libraries of scripting languages see it, wider than Java's \s.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
_BLANK_NO_LF = r"[\t\x0b-\r\x1c-\x20\x85\xa0  -     　]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FENCE = "```"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Words that the filler tiers may remove.
DEFAULT_FILLERS = ("actually", "basically", "essentially", "honestly", "just", "kindly", "literally", "please", "quite", "really", "simply", "very")
MORE_FILLERS = (
    "absolutely",
    "arguably",
    "certainly",
    "clearly",
    "completely",
    "definitely",
    "fairly",
    "generally",
    "indeed",
    "maybe",
    "obviously",
    "particularly",
    "perhaps",
    "presumably",
    "pretty",
    "rather",
    "somewhat",
    "specifically",
    "surely",
    "totally",
    "truly",
    "typically",
)
AGGRESSIVE_FILLERS = (*DEFAULT_FILLERS, *MORE_FILLERS)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, though a lambda in ``use`` may read it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The blanks of ASCII; a class of one or two ranges is far cheaper to match than BLANK.
_ASCII, _ASCII_NO_LF = r"[\t-\r\x1c-\x20]", r"[\t\x0b-\r\x1c-\x20]"
_OTHER_BLANKS = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _by_blanks(text: Column, make: Callable[[str, str], Column]) -> Column:
    """``make(blank, blank but line feed)`` with the cheap classes for texts without other blanks."""
    ascii_only = F.octet_length(text) == F.length(text)
    none = reduce(and_, (~F.contains(text, F.lit(x)) for x in _OTHER_BLANKS))
    return F.when(ascii_only | none, make(_ASCII, _ASCII_NO_LF)).otherwise(make(BLANK, _BLANK_NO_LF))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def words(text: Column, blank: str = BLANK) -> Column:
    """Tokens between runs of white space; no empty ones."""
    return F.filter(F.split(text, f"{blank}+", -1), lambda w: w != "")


def heuristic_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def spans(text: Column) -> Column:
    """array<struct<text, mutable>>: prose and fenced code, in order; joined they are the text.

    A matched pair of fences and what it holds is one immutable span; an
    unmatched fence is prose; an empty text is one empty prose span.
    """

    def cut(parts: Column) -> Column:
        fences = F.size(parts) - 1
        last = F.floor(fences / 2).cast("int") * 2

        def one(k: Column) -> Column:
            prose = F.when((k == last) & (fences % 2 == 1), F.concat(F.get(parts, k), F.lit(FENCE), F.get(parts, k + 1))).otherwise(F.get(parts, k))
            return F.struct(F.when(k % 2 == 1, F.concat(F.lit(FENCE), F.get(parts, k), F.lit(FENCE))).otherwise(prose).alias("text"), (k % 2 == 0).alias("mutable"))

        return F.filter(F.transform(F.sequence(F.lit(0), last), one), lambda s: ~s["mutable"] | (s["text"] != ""))

    empty = F.array(F.struct(text.alias("text"), F.lit(True).alias("mutable")))
    return F.when(text.isNotNull(), F.when(text == "", empty).otherwise(bind(F.split(text, FENCE, -1), cut)))


def join_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: s["text"]), "")


def on_prose(text: Column, change: Callable[[Column], Column]) -> Column:
    """Applies ``change`` to prose spans; texts without fences take a plain path."""

    def walk(t: Column) -> Column:
        parts = F.transform(spans(t), lambda s: F.when(s["mutable"], change(s["text"])).otherwise(s["text"]))
        return F.when(F.contains(t, F.lit(FENCE)), F.array_join(parts, "")).otherwise(change(t))

    return bind(text, walk)


def lossless_prose(text: Column) -> Column:
    """Without blanks at line ends; three or more line ends become two."""
    return F.regexp_replace(_by_blanks(text, lambda _, b: F.regexp_replace(text, rf"{b}+(?=\n|\z)", "")), r"\n{3,}", "\n\n")


def lossless(text: Column) -> Column:
    return on_prose(text, lossless_prose)


def bare(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(PUNCTUATION)))


def filler_prose(text: Column, fillers: Iterable[str]) -> Column:
    """Line by line: words joined by one blank, without those whose bare form is a filler.

    Only lines that hold a filler's letters are taken apart into words.
    """
    names = list(fillers)

    def may_hold(line: Column) -> Column:
        return bind(F.lower(line), lambda low: reduce(or_, (F.contains(low, F.lit(n)) for n in names), F.lit(False)))

    def lines(blank: str, _: str) -> Column:
        def kept(line: Column) -> Column:
            apart = F.array_join(F.filter(words(line, blank), lambda w: ~bare(w).isin(names)), " ")
            plain = F.regexp_replace(F.regexp_replace(line, f"{blank}+", " "), r"^ | $", "")
            return F.when(may_hold(line), apart).otherwise(plain)

        return F.array_join(F.transform(F.split(text, "\n", -1), kept), "\n")

    return _by_blanks(text, lines)


def filler(text: Column, fillers: Iterable[str] = DEFAULT_FILLERS) -> Column:
    return on_prose(text, lambda t: filler_prose(t, fillers))


def same_words(a: Column, b: Column) -> Column:
    return words(a) == words(b)


def removed_only(original: Column, compressed: Column, allowed: Iterable[str]) -> Column:
    """Is ``compressed`` what is left of ``original`` after removing allowed words?"""
    names = list(allowed)

    def walk(out: Column) -> Column:
        def step(state: Column, word: Column) -> Column:
            match = F.coalesce(F.get(out, state["at"]) == word, F.lit(False))
            return F.struct((state["at"] + match.cast("int")).alias("at"), (state["ok"] & (match | bare(word).isin(names))).alias("ok"))

        end = F.aggregate(words(original), F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), step)
        return bind(end, lambda e: e["ok"] & (e["at"] == F.size(out)))

    return bind(words(compressed), walk)


def alignment(original: Column, compressed: Column) -> Column:
    """For each word of ``compressed`` the position (from 0) of the word of ``original`` that it is: the first equal one after its predecessor's.

    Null for words that ``original`` doesn't hold there; the words between two
    positions are those removed.  One walk over the original's words.
    """

    def walk(out: Column) -> Column:
        def step(state: Column, word: Column) -> Column:
            match = F.coalesce(F.get(out, F.size(state["found"])) == word, F.lit(False))
            return F.struct((state["at"] + 1).alias("at"), F.when(match, F.concat(state["found"], F.array(state["at"]))).otherwise(state["found"]).alias("found"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        found = F.aggregate(words(original), start, step, lambda s: s["found"])
        return bind(found, lambda f: F.transform(out, lambda _, i: F.get(f, i)))

    return bind(words(compressed), walk)


def lead(text: Column, limit: int = 200) -> Column:
    """First sentence of the first line, at most ``limit`` characters; '' if blank.

    Ends are tried in the order full stop, question mark, exclamation mark.
    """
    line = strip(F.get(F.split(strip(text), _LINE_END, 2), F.lit(0)))
    cut = line
    for mark in ("! ", "? ", ". "):
        at = F.instr(line, mark)
        cut = F.when(at > 0, F.substring(line, F.lit(1), at)).otherwise(cut)
    return strip(F.substring(cut, 1, limit))


def not_longer(original: Column, compressed: Column) -> Column:
    """The compressed text unless it costs more tokens than the original."""
    return F.when(heuristic_tokens(compressed) > heuristic_tokens(original), original).otherwise(compressed)


def should_verify(call: Column, rate: float) -> Column:
    """Is call ``call`` (from 1) one of those verified at this rate?"""
    return F.ceil(call * F.lit(rate)) > F.ceil((call - 1) * F.lit(rate))
