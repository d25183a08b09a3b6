"""What compression must keep of a whole request, as a list of violations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _code(spans: Column) -> Column:
    return F.transform(F.filter(spans, lambda s: ~s["mutable"]), lambda s: s["text"])


def request_violations(before: Column, after: Column, same: Callable[[Column, Column], Column] = T.same_words) -> Column:
    """array<string>: empty if ``after`` says what ``before`` says.

    Both are struct<system, messages: array<struct<role, text>>>.  Checked are
    the system text's presence and words, the number of messages, and of each
    message its role, the number and kind of its spans, its code to the byte and
    its words by ``same``.  A message without text (a structured one) has no spans.
    """
    a, b = before["system"], after["system"]
    system = F.when(a.isNull() != b.isNull(), "system").when(a.isNotNull() & ~same(a, b), "system")
    count = F.when(F.size(before["messages"]) != F.size(after["messages"]), "message count")

    def message(pair: Column, i: Column) -> Column:
        one, two = pair["x"], pair["y"]
        x, y = T.spans(F.coalesce(one["text"], F.lit(""))), T.spans(F.coalesce(two["text"], F.lit("")))
        kinds = F.transform(x, lambda s: s["mutable"]) != F.transform(y, lambda s: s["mutable"])
        found = F.when(one["role"] != two["role"], "role").when(kinds, "spans").when(_code(x) != _code(y), "code").when(~same(F.coalesce(one["text"], F.lit("")), F.coalesce(two["text"], F.lit(""))), "words")
        return F.when(found.isNotNull(), F.concat(found, F.lit(" "), i.cast("string")))

    least = F.least(F.size(before["messages"]), F.size(after["messages"]))
    pairs = F.zip_with(F.slice(before["messages"], F.lit(1), least), F.slice(after["messages"], F.lit(1), least), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.array_compact(F.concat(F.array(system, count), F.transform(pairs, message)))


def filler_violations(before: Column, after: Column, allowed: Iterable[str] = T.DEFAULT_FILLERS) -> Column:
    """The same where allowed words may go."""
    names = tuple(allowed)
    return request_violations(before, after, lambda a, b: T.removed_only(a, b, names))
