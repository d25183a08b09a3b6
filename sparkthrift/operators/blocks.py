"""Messages kept as raw JSON: changes of text blocks, elision, breakpoints.

Unknown fields and untouched blocks stay as they are; a message in which
nothing changes is returned as the same text.  JSON trees are walked in Arrow
batches, prose is changed by the functions given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from sparkthrift.functions import text as T

from . import ports

_FENCED = re.compile(r"(```.*?```)", re.DOTALL)


def _prose(text: str, change: Callable[[str], str]) -> str:
    parts = _FENCED.split(text)
    return "".join(p if i % 2 else change(p) for i, p in enumerate(parts))


def lossless_prose(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+(?=\n|\Z)", "", text))


def filler_prose(fillers: Iterable[str]) -> Callable[[str], str]:
    names = frozenset(fillers)
    return lambda text: "\n".join(" ".join(w for w in line.split() if w.strip(T.PUNCTUATION).lower() not in names) for line in text.split("\n"))


def _blocks(raw: str | None) -> tuple[dict, list] | None:
    try:
        whole = json.loads(raw)
    except (TypeError, ValueError):
        return None
    listed = whole.get("content") if isinstance(whole, dict) else None
    return (whole, listed) if isinstance(listed, list) else None


def _dump(whole: dict) -> str:
    return json.dumps(whole, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _with_text(raw: str | None, change: Callable[[str], str]) -> tuple[str | None, int]:
    """The message with its text blocks' prose changed, and how many changed."""
    touched, found = 0, _blocks(raw)
    if not found:
        return raw, 0
    made = []
    for b in found[1]:
        is_text = isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)
        new = _prose(b["text"], change) if is_text else None
        touched += is_text and new != b["text"]
        made.append({**b, "text": new} if is_text else b)
    return (_dump({**found[0], "content": made}) if touched else raw), touched


def _elided(raw: str | None, stub: str) -> tuple[str | None, int]:
    """The message with tool results that are longer than ``stub`` replaced by it, and how many were."""
    touched, found = 0, _blocks(raw)
    if not found:
        return raw, 0
    made = []
    for b in found[1]:
        payload = b.get("content") if isinstance(b, dict) and b.get("type") == "tool_result" else None
        size = 0 if payload is None or payload == stub else len(payload) if isinstance(payload, str) else len(json.dumps(payload, ensure_ascii=False))
        made.append({**b, "content": stub} if size > len(stub) else b)
        touched += size > len(stub)
    return (_dump({**found[0], "content": made}) if touched else raw), touched


def _marked(raw: str | None) -> bool:
    return any(isinstance(b, dict) and "cache_control" in b for b in (_blocks(raw) or ({}, []))[1])


def change_text_blocks(raw: Column, change: Callable[[str], str]) -> Column:
    """struct<raw, touched>: text blocks with their prose changed, and how many changed."""
    return F.pandas_udf(lambda rows: pd.DataFrame([_with_text(x, change) for x in rows], columns=["raw", "touched"]), "raw string, touched int")(raw)


def elide_results(raw: Column, stub: str) -> Column:
    """struct<raw, touched>: tool results that are longer than ``stub`` become it; ids and flags stay."""
    return F.pandas_udf(lambda rows: pd.DataFrame([_elided(x, stub) for x in rows], columns=["raw", "touched"]), "raw string, touched int")(raw)


#: What ``raw_tiers`` adds.
RAW_TIERS = StructType([StructField("after", ArrayType(ArrayType(StringType()))), StructField("touched", ArrayType(LongType())), StructField("marked", BooleanType())])


def raw_tiers(rows: DataFrame, raws: str, steps: Sequence[tuple[str, Callable[[str], str] | tuple[int, str]]], out: str) -> DataFrame:
    """Adds struct<after, touched, marked>: a request's raw messages (null where a message is text) through a chain of tiers.

    A step is a change of prose, or (keep, stub) for the results of all but the
    last ``keep`` messages.  ``after`` and ``touched`` have an element a step:
    the messages then, and what the step changed; ``marked`` tells if any block
    has a breakpoint.
    """

    def through(listed: list[str | None]) -> dict:
        after, touched, now = [], [], list(listed)
        for _, step in steps:
            old = len(now) - step[0] if isinstance(step, tuple) else 0
            done = [(x, 0) if x is None else _with_text(x, step) if callable(step) else _elided(x, step[1]) if i < old else (x, 0) for i, x in enumerate(now)]
            now = [x for x, _ in done]
            after.append(now)
            touched.append(sum(n for _, n in done))
        return {"after": after, "touched": touched, "marked": any(_marked(x) for x in listed if x is not None)}

    return ports.apply(rows, raws, out, RAW_TIERS, lambda batch: [through(x) for x in batch])


def has_cache_control(raw: Column) -> Column:
    """Has any block a breakpoint?  False for text messages."""

    return F.pandas_udf(lambda rows: pd.Series([_marked(x) for x in rows], dtype=bool), "boolean")(raw)


def reduce_prose(rows: DataFrame, texts: str, reducer: Callable[[list[str], float], list[str]], keep: float, out: str) -> DataFrame:
    """Adds lists of texts with their prose spans reduced by a learned reducer (a function of texts and a ratio).

    It is called once a batch with all its prose spans, or span by span if that
    fails; a span for which it fails, or that would grow, stays as it is.
    """

    def safe(parts: list[str]) -> list[str]:
        try:
            made = list(reducer(parts, keep))
            if len(made) == len(parts):
                return [y if isinstance(y, str) and len(y) <= len(x) else x for x, y in zip(parts, made, strict=True)]
        except Exception:  # noqa: BLE001  a reducer's failure must not fail a request
            pass
        return [safe([x])[0] for x in parts] if len(parts) > 1 else parts

    def run(batch: list[list[str | None]]) -> list[list[str | None]]:
        cut = [[None if t is None else _FENCED.split(t) for t in x] for x in batch]
        places = [(t, i) for x in cut for t in x if t for i in range(0, len(t), 2) if t[i].strip()]
        if places:
            for (t, i), new in zip(places, safe([t[i] for t, i in places]), strict=True):
                t[i] = new
        return [[None if t is None else "".join(t) for t in x] for x in cut]

    return ports.apply(rows, texts, out, ArrayType(StringType()), run)
