"""Tiers over requests in long form (request_id, msg_idx, span_idx, role, text, mutable)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkthrift.functions import text as T

DEDUP_MARKER = "[identical block above]"
ELISION_STUB = "[tool result elided]"

Tier = Callable[[Column], Column]


def explode_spans(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row per span of each message."""
    rows = messages.select("*", F.posexplode(T.spans(F.col(text))).alias("span_idx", "_span"))
    return rows.select(*(c for c in messages.columns if c != text), "span_idx", F.col("_span.text").alias(text), F.col("_span.mutable").alias("mutable"))


def tiers(aggressive: bool = False) -> list[tuple[str, Tier]]:
    """The named row-wise tiers, in the order in which they are chained."""
    names = T.AGGRESSIVE_FILLERS if aggressive else T.DEFAULT_FILLERS
    return [("lossless", T.lossless), ("filler", lambda t: T.filler(t, names))]


def chain(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Applies DataFrame passes in order; none is the identity."""
    return reduce(DataFrame.transform, steps, df)


def stage_rows(df: DataFrame, key: str, text: str, steps: list[tuple[str, Tier]], checks: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(key, stage, tokens_before, tokens_after, ok): a row for each step of the chain.

    ``ok`` is null for a step without a check.
    """
    made, now = [], F.col(text)
    for name, step in steps:
        after = step(now)
        ok = checks[name](now, after) if name in checks else F.lit(None).cast("boolean")
        made.append(F.struct(F.lit(name).alias("stage"), T.heuristic_tokens(now).alias("tokens_before"), T.heuristic_tokens(after).alias("tokens_after"), ok.alias("ok")))
        now = after
    return df.select(key, F.inline(F.array(*made)))


def dedup(spans: DataFrame, min_chars: int = 200, marker: str = DEDUP_MARKER) -> DataFrame:
    """Later spans equal to an earlier one of the request become ``marker``; adds ``deduplicated``.

    Only spans of at least ``min_chars`` characters, and longer than the marker.
    The text itself is not a window key: its hash and length are, and a hot
    request is split by them.
    """
    least = max(min_chars, len(marker) + 1)
    big = F.length("text") >= least
    key = F.when(big, F.sha2("text", 256)).otherwise(F.concat_ws("/", "msg_idx", "span_idx"))
    first = F.row_number().over(Window.partitionBy("request_id", "_key").orderBy("msg_idx", "span_idx"))
    rows = spans.withColumn("_key", key).withColumn("deduplicated", big & (first > 1)).drop("_key")
    return rows.withColumn("text", F.when(F.col("deduplicated"), marker).otherwise(F.col("text"))).withColumn("mutable", F.col("mutable") & ~F.col("deduplicated"))


def repeated_spans(messages: Column, min_chars: int = 200, marker: str = DEDUP_MARKER) -> Column:
    """array<struct<i, j>>: spans j of messages i (head, text, raw) that equal an earlier one of the request, in one row.

    Heads are spans of their own; raw messages have none.  Long spans are hashed
    and sorted with their places, so equal ones stand side by side.
    """
    least = max(min_chars, len(marker) + 1)
    placed = F.flatten(F.transform(messages, lambda m, i: F.filter(F.transform(_message_spans(m), lambda s, j: F.when(F.length(s["text"]) >= least, F.struct(F.sha2(s["text"], 256).alias("h"), i.alias("i"), j.alias("j")))), lambda x: x.isNotNull())))

    def later(found: Column) -> Column:
        return F.transform(F.filter(found, lambda x, k: F.coalesce(x["h"] == F.get(found, k - 1)["h"], F.lit(False))), lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))

    return T.bind(F.sort_array(placed), later)


def _message_spans(m: Column) -> Column:
    head = F.filter(F.array(F.struct(m["head"].alias("text"), F.lit(False).alias("mutable"))), lambda s: s["text"] != "")
    spans = F.transform(T.spans(m["text"]), lambda s: F.struct(s["text"].alias("text"), s["mutable"].alias("mutable")))
    return F.when(m["raw"].isNull(), F.concat(head, spans)).otherwise(F.array().cast("array<struct<text string, mutable boolean>>"))


def without_repeats(messages: Column, repeats: Column, marker: str = DEDUP_MARKER) -> Column:
    """Messages with the spans named in ``repeats`` replaced by the marker; what stood in a head is text then."""

    def change(m: Column, i: Column) -> Column:
        text = F.array_join(F.transform(_message_spans(m), lambda s, j: F.when(F.array_contains(repeats, F.struct(i.alias("i"), j.alias("j"))), marker).otherwise(s["text"])), "")
        hit = F.exists(repeats, lambda x: x["i"] == i)
        return F.struct(m["role"].alias("role"), F.when(hit, "").otherwise(m["head"]).alias("head"), F.when(hit, text).otherwise(m["text"]).alias("text"), m["raw"].alias("raw"))

    return F.when(F.size(repeats) == 0, messages).otherwise(F.transform(messages, change))


def elide(messages: DataFrame, is_result: Column, keep_recent: int = 4, stub: str = ELISION_STUB) -> DataFrame:
    """Tool results before the last ``keep_recent`` messages become ``stub`` where that is shorter; adds ``elided``."""
    total = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    old = F.col("msg_idx") < total - max(0, keep_recent)
    hit = old & is_result & F.col("text").isNotNull() & (F.col("text") != stub) & (F.length("text") > len(stub))
    return messages.withColumn("elided", F.coalesce(hit, F.lit(False))).withColumn("text", F.when(F.col("elided"), stub).otherwise(F.col("text")))


def boundary(dialect: Column, n_messages: Column, has_prefix: Column) -> Column:
    """Messages of the cacheable prefix: all but the last, 0 if only system or tools, else null."""
    counted = F.when(n_messages >= 1, n_messages - 1).when(has_prefix, F.lit(0).cast("long"))
    return F.when(dialect.isin("anthropic", "gemini"), counted)


# How the providers cache prefixes (model, least prefix tokens, most breakpoints).
CAPABILITIES = (("anthropic", "explicit_breakpoint", 4096, 4), ("gemini", "explicit_context_api", 4096, 0))


def capability(dialect: Column) -> Column:
    out = F.struct(F.lit("none").alias("model"), F.lit(0).alias("min_prefix_tokens"), F.lit(0).alias("max_breakpoints"))
    for name, model, least, most in CAPABILITIES:
        out = F.when(dialect == name, F.struct(F.lit(model).alias("model"), F.lit(least).alias("min_prefix_tokens"), F.lit(most).alias("max_breakpoints"))).otherwise(out)
    return out
