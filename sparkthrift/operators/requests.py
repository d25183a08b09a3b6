"""Request bodies of three provider dialects to canonical messages, and back.

Bodies stay JSON text; fields are read as VARIANT, so unknown fields survive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path endings of each dialect.
ENDINGS = (("anthropic", ("/v1/messages",)), ("openai", ("/v1/chat/completions",)), ("gemini", (":generateContent", ":streamGenerateContent")))
# Headers that are not passed on.
DROPPED_FROM_REQUESTS = ("accept-encoding", "connection", "content-length", "host")
DROPPED_FROM_RESPONSES = ("connection", "content-encoding", "content-length", "transfer-encoding")


def detect(path: Column) -> Column:
    out = F.lit("unknown")
    for name, ends in ENDINGS:
        for end in ends:
            out = F.when(F.endswith(path, F.lit(end)), name).otherwise(out)
    return out


def dialect_of(dialect: Column, path: Column) -> Column:
    """The stated dialect, else the one of the path; a stated one that does not exist raises."""
    wrong = F.raise_error(F.concat(F.lit("unknown dialect "), dialect)).cast("string")
    stated = F.when(dialect.isin("anthropic", "openai", "gemini", "unknown"), dialect).otherwise(wrong)
    return F.when(dialect.isNotNull(), stated).otherwise(F.when(path.isNotNull(), detect(path)).otherwise("unknown"))


def gemini_model(path: Column) -> Column:
    last = F.element_at(F.split(path, "/", -1), -1)
    name, action = F.regexp_extract(last, "^([^:]+):(.+)$", 1), F.regexp_extract(last, "^([^:]+):(.+)$", 2)
    return F.when((name != "") & (action != ""), name)


def route(dialect: Column, headers: Column) -> Column:
    """Dialect, else the provider whose credential header is there; null: nowhere to send it."""
    has = lambda *names: F.exists(headers, lambda h: F.lower(h["k"]).isin(*names))
    sniffed = F.when(has("x-api-key", "anthropic-version"), "anthropic").when(has("x-goog-api-key"), "gemini").when(has("authorization"), "openai")
    return F.when(dialect != "unknown", dialect).otherwise(sniffed)


def upstream_url(base: Column, path: Column, query: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), path, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))


def kept_headers(headers: Column, dropped: tuple[str, ...] = DROPPED_FROM_REQUESTS) -> Column:
    return F.filter(headers, lambda h: ~F.lower(h["k"]).isin(*dropped))


def header(headers: Column, name: str) -> Column:
    """The last value of a header, whatever its case; null without it."""
    return F.get(F.reverse(F.filter(headers, lambda h: F.lower(h["k"]) == name)), F.lit(0))["v"]


def correlation_id(headers: Column, fallback: Column) -> Column:
    """The id that the caller gave, else ``fallback`` (which a batch must make reproducible)."""
    given = [F.when(header(headers, x) != "", header(headers, x)) for x in ("x-request-id", "x-correlation-id")]
    return F.coalesce(*given, fallback)


def content_type(headers: Column, default: str = "application/json") -> Column:
    """The first content type of a response, else the default that a replay answers with."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["k"]) == "content-type"), F.lit(0))["v"], F.lit(default))


def is_stream(path: Column, body: Column) -> Column:
    """By the path, or by any value of ``stream`` that is not empty, zero, false or null."""
    flag = F.to_json(F.try_variant_get(F.try_parse_json(body), "$.stream", "variant"))
    truthy = ~flag.isin("false", "null", '""', "[]", "{}") & F.coalesce(flag.try_cast("double") != 0, F.lit(True))
    return F.endswith(path, F.lit(":streamGenerateContent")) | F.coalesce(truthy, F.lit(False))


def _messages(dialect: str, body: dict) -> tuple[list[tuple[str, str | None, str | None]], str | None] | None:
    """(role, text, raw) of each message and the system text; null if any part has another shape."""
    listed = body.get("contents" if dialect == "gemini" else "messages")
    if not isinstance(listed, list):
        return None
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    part = lambda x: x["parts"][0]["text"] if isinstance(x, dict) and isinstance(x.get("parts"), list) and len(x["parts"]) == 1 and isinstance(x["parts"][0], dict) and set(x["parts"][0]) == {"text"} and isinstance(x["parts"][0]["text"], str) else None
    out: list[tuple[str, str | None, str | None]] = []
    for m in listed:
        if not isinstance(m, dict):
            return None
        role = m.get("role")
        if dialect == "gemini":
            name, text = {"model": "assistant", "user": "user"}.get(role), part(m)
            plain = name is not None and text is not None and set(m) == {"role", "parts"}
            out.append((name or "user", text if plain else None, None if plain else dump(m)))
            continue
        roles = ("user", "assistant") if dialect == "anthropic" else ("system", "user", "assistant")
        if set(m) == {"role", "content"} and isinstance(m["content"], str) and role in roles:
            out.append((role, m["content"], None))
        elif role in (*roles, "tool") and (dialect == "openai" or role != "tool"):
            out.append((role, None, dump(m)))
        else:
            return None
    system = None
    if dialect == "anthropic" and body.get("system") is not None:
        system = body["system"]
        if not isinstance(system, str):
            return None
    if dialect == "gemini" and body.get("systemInstruction") is not None:
        system = part(body["systemInstruction"])
        if system is None:
            return None
    return out, system


_PARSED = "struct<model string, system string, stream boolean, tools string, messages array<struct<role string, text string, raw string>>>"


def _parse(dialects: pd.Series, bodies: pd.Series, paths: pd.Series, structured: bool) -> pd.DataFrame:
    rows = []
    for dialect, text, model in zip(dialects, bodies, paths, strict=True):
        row = None
        try:
            body = json.loads(text) if dialect in ("anthropic", "openai", "gemini") else None
        except (ValueError, TypeError):
            body = None
        if isinstance(body, dict) and (found := _messages(dialect, body)) is not None and (structured or all(raw is None for _, _, raw in found[0])):
            tools = body.get("tools")
            row = {
                "model": model if dialect == "gemini" else body.get("model") if isinstance(body.get("model"), str) else None,
                "system": found[1],
                "stream": dialect != "gemini" and bool(body.get("stream", False)),
                "tools": None if tools is None else json.dumps(tools, sort_keys=True, ensure_ascii=False, separators=(",", ":")),
                "messages": [{"role": r, "text": t, "raw": w} for r, t, w in found[0]],
            }
        rows.append(row or dict.fromkeys(("model", "system", "stream", "tools", "messages")))
    return pd.DataFrame(rows, columns=["model", "system", "stream", "tools", "messages"])


def parse_requests(requests: DataFrame, structured: bool = True) -> DataFrame:
    """Adds dialect and ``parsed`` to (path, body) rows; null fields mean: pass it on untouched.

    One message of another shape nulls the whole request.  Rewriting must keep
    unknown fields and number lexemes, so bodies are parsed as JSON trees in
    Arrow batches rather than into a fixed schema.
    """
    parse = F.pandas_udf(lambda d, b, p: _parse(d, b, p, structured), _PARSED)
    rows = requests.withColumn("dialect", detect(F.col("path")))
    return rows.withColumn("parsed", parse("dialect", "body", gemini_model(F.col("path"))))


def _serialize(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for dialects, bodies, systems, messages, marks in batches:
        out = []
        for dialect, text, system, listed, mark in zip(dialects, bodies, systems, messages, marks, strict=True):
            body = json.loads(text)
            made = []
            for i, m in enumerate(listed):
                marked = dialect == "anthropic" and mark == i
                if m["raw"] is not None:
                    whole = json.loads(m["raw"])
                    content = whole.get("content")
                    if marked and isinstance(content, list) and content and isinstance(content[-1], dict):
                        whole["content"] = [*content[:-1], {**content[-1], "cache_control": {"type": "ephemeral"}}]
                    made.append(whole)
                elif dialect == "gemini":
                    made.append({"role": "model" if m["role"] == "assistant" else m["role"], "parts": [{"text": m["text"]}]})
                elif marked:
                    made.append({"role": m["role"], "content": [{"type": "text", "text": m["text"], "cache_control": {"type": "ephemeral"}}]})
                else:
                    made.append({"role": m["role"], "content": m["text"]})
            body["contents" if dialect == "gemini" else "messages"] = made
            if system is not None and dialect == "anthropic":
                body["system"] = system
            if system is not None and dialect == "gemini":
                body["systemInstruction"] = {**body.get("systemInstruction", {}), "parts": [{"text": system}]}
            out.append(json.dumps(body, ensure_ascii=False, separators=(",", ":")))
        yield pd.Series(out)


def serialize_requests(parsed: DataFrame) -> DataFrame:
    """Adds ``sent``: the original body with its messages and system replaced by ``parsed``'s.

    ``breakpoint`` (int, may be null) marks the message that ends the cacheable prefix.
    """
    write = F.pandas_udf(_serialize, "string")
    known = parsed.where("parsed.messages is not null")
    return known.withColumn("sent", write("dialect", "body", "parsed.system", "parsed.messages", "breakpoint"))


def _count(usage: Column, path: str) -> Column:
    """A number that is not negative, cut to an integer; 0 for anything else."""
    value = F.try_variant_get(usage, path, "variant")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(usage, path, "double")
    return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.greatest(F.lit(0).cast("long"), number.cast("long"))).otherwise(F.lit(0).cast("long"))


def parse_usage(dialect: Column, body: Column) -> Column:
    """struct<input, output, cache_read, cache_write>; null without a usage object."""
    whole = F.try_parse_json(body)
    fields = {
        "anthropic": ("$.usage", ("$.input_tokens", "$.output_tokens", "$.cache_read_input_tokens", "$.cache_creation_input_tokens")),
        "openai": ("$.usage", ("$.prompt_tokens", "$.completion_tokens", "$.prompt_tokens_details.cached_tokens", None)),
        "gemini": ("$.usageMetadata", ("$.promptTokenCount", "$.candidatesTokenCount", "$.cachedContentTokenCount", None)),
    }
    out = None
    for name, (at, paths) in fields.items():
        usage = F.try_variant_get(whole, at, "variant")
        counts = [F.lit(0).cast("long") if p is None else _count(usage, p) for p in paths]
        made = F.struct(*(c.alias(n) for c, n in zip(counts, ("input", "output", "cache_read", "cache_write"), strict=True)))
        here = (dialect == name) & F.coalesce(F.schema_of_variant(usage).startswith("OBJECT"), F.lit(False))
        out = F.when(here, made) if out is None else out.when(here, made)
    return out


def outcome(dialect: Column, authorized: Column, within_rate: Column) -> Column:
    """Status of an early exit, in order: no route, not authorised, rate limit; else null."""
    return F.when(dialect.isNull() | (dialect == "unknown"), 502).when(~authorized, 401).when(~within_rate, 429)
