"""The lifecycle of requests as one dataflow.

requests (request_id, ts, path, headers, body)
-> route, tenant, authorisation, rate limit -> parse -> memory: old turns become a
summary or what is retrieved -> tiers over the message tree -> never cost more
-> breakpoint on a prefix seen before -> exact and similarity cache over time
-> outcome rows, and the bodies that are sent on.

A request is one row and its messages are an array in it, so memory by summary, all
tiers and the prefix are computed without a shuffle.  Folds over time (limits, caches,
sightings) see narrow rows, told apart by request_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkthrift.functions import keys as K
from sparkthrift.functions import redaction as R
from sparkthrift.functions import terms as V
from sparkthrift.functions import text as T
from sparkthrift.operators import blocks, caching, memory, metrics, ports, requests, tiers

from .config import Config

Tier = Callable[[Column], Column]
Check = Callable[[Column, Column], Column]
_STAGE = "struct<stage string, tokens_before bigint, tokens_after bigint, ok boolean>"
#: A message on its way: ``head`` is what memory put before it (never changed), ``text`` or ``raw`` what it says.
_MESSAGE = "struct<role string, head string, text string, raw string>"


def _text(role_text: Column, system: Column) -> Column:
    return F.concat(F.coalesce(system, F.lit("")), F.array_join(role_text, ""))


def _said(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.concat(m["head"], F.coalesce(m["text"], m["raw"])))


def _summarised(rows: DataFrame, config: Config) -> DataFrame:
    """Adds ``start`` and ``header`` where the old turns of a request become a summary."""
    m = F.col("parsed.messages")
    target = F.greatest(F.lit(0), F.size(m) - config.memory_keep_recent)
    start = F.array_max(F.transform(m, lambda x, i: F.when((x["role"] == "user") & (i <= target), i)))
    apt = (F.size(m) > config.memory_min_messages) & ~F.exists(m, lambda x: x["raw"].isNotNull())
    rows = rows.withColumn("start", F.when(apt & (start > 0), start))
    leads = F.filter(F.transform(F.slice(m, 1, F.coalesce("start", F.lit(0))), lambda x: T.lead(x["text"])), lambda x: x != "")

    def bullets(lines: Column) -> Column:
        first = lambda lower: F.filter(lines, lambda x, i: F.array_position(lower, F.get(lower, i)) == i + 1)  # noqa: E731  in the order they come
        return F.array_join(F.transform(F.slice(T.bind(F.transform(lines, F.lower), first), 1, config.memory_summary_items), lambda x: F.concat(F.lit("- "), x)), "\n")

    summary = F.when(F.col("start").isNotNull(), T.bind(leads, bullets))
    return rows.withColumn("header", F.when(summary != "", F.concat(F.lit(memory.SUMMARY_HEADER), summary, F.lit("\n\n"))))


def _retrieved(rows: DataFrame, config: Config) -> DataFrame:
    """Adds ``start`` and ``header`` where old turns become what the tenant's memory holds that is nearest to the latest user text.

    The memory is what the tenant's requests have said up to and with this one;
    only the plans, narrow rows, are joined back.
    """
    known = rows.where(F.col("early").isNull() & F.col("parsed.messages").isNotNull())
    plans = memory.recalled(known.select("request_id", "tenant", "ts", F.col("parsed.system").alias("system"), F.col("parsed.messages").alias("messages")), keep_recent=config.memory_keep_recent, retrieve=config.memory_retrieve, min_messages=config.memory_min_messages)
    return rows.join(plans, "request_id", "left")


def _remembered(rows: DataFrame, config: Config) -> DataFrame:
    """Adds ``memory`` (off, ingest, summary or compact), ``compacted``, and ``working``: the messages after it."""
    if config.memory == "summary":
        rows = _summarised(rows, config)
    elif config.memory == "retrieval":
        rows = _retrieved(rows, config)
    else:
        rows = rows.withColumns({"start": F.lit(None).cast("int"), "header": F.lit(None).cast("string")})
    m = F.col("parsed.messages")
    done = F.col("header").isNotNull()
    whole = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.lit("").alias("head"), x["text"].alias("text"), x["raw"].alias("raw")))
    kept = F.transform(F.slice(m, F.coalesce("start", F.lit(0)) + 1, F.size(m)), lambda x, i: F.struct(x["role"].alias("role"), F.when(i == 0, F.col("header")).otherwise("").alias("head"), x["text"].alias("text"), x["raw"].alias("raw")))
    act = memory.action(ingest=config.memory != "off", structured=~done, summarise=config.memory == "summary", inject=config.memory == "retrieval")
    rows = rows.withColumns({"compacted": done, "memory": F.when(m.isNull(), "off").otherwise(act), "working": F.when(done, kept).otherwise(whole).cast(f"array<{_MESSAGE}>")})
    return rows.drop("start", "header")


def _tiers(config: Config) -> list[tuple[str, Tier, Check, Callable[[str], str]]]:
    """(stage, tier, what it must keep, the same change of a raw message's prose) in the order in which they are chained."""
    names = T.AGGRESSIVE_FILLERS if config.aggressive else T.DEFAULT_FILLERS
    steps: list[tuple[str, Tier, Check, Callable[[str], str]]] = [("lossless", T.lossless, T.same_words, blocks.lossless_prose)] if config.lossless else []
    if config.filler or config.aggressive:
        steps.append(("filler", lambda t: T.filler(t, names), lambda a, b: T.removed_only(a, b, names), blocks.filler_prose(names)))
    return steps


def _compressed(rows: DataFrame, config: Config, reducer: Callable[[list[str], float], list[str]] | None) -> DataFrame:
    """Adds ``chosen`` (messages), ``chosen_system``, ``stages``, ``marked``, ``_before`` and ``_after`` (the request's whole text).

    Every tier takes the messages as the one before left them.  Raw messages go
    through the tiers that know their blocks, in one pass of JSON trees.
    """
    p = F.col("parsed")
    steps = _tiers(config)
    raw_steps: list = [(name, change) for name, _, _, change in steps] if config.structured else []
    if config.structured and config.elide:
        raw_steps.append(("elision", (config.elide_keep_recent, tiers.ELISION_STUB)))
    raws = F.transform("working", lambda m: m["raw"])
    rows = blocks.raw_tiers(rows.withColumn("_raws", raws), "_raws", raw_steps, "_raw").drop("_raws") if config.structured else rows.withColumn("_raw", F.lit(None).cast(blocks.RAW_TIERS))
    rows = rows.withColumns({"_m0": F.col("working"), "_s0": p["system"]})
    at = {name: i for i, (name, _) in enumerate(raw_steps)}

    def with_raw(messages: Column, name: str) -> Column:
        """The messages, raw ones as the step of that name leaves them."""
        if name not in at:
            return messages
        after = F.get(F.col("_raw.after"), F.lit(at[name]))
        return F.zip_with(messages, after, lambda m, raw: F.struct(m["role"].alias("role"), m["head"].alias("head"), m["text"].alias("text"), raw.alias("raw")))

    def with_text(messages: Column, change: Callable[[Column], Column]) -> Column:
        return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["head"].alias("head"), change(m["text"]).alias("text"), m["raw"].alias("raw")))

    stages, n = [], 0
    size = lambda i: T.heuristic_tokens(_text(_said(F.col(f"_m{i}")), F.col(f"_s{i}")))

    def add(name: str, messages: Column, system: Column, ok: Column, touched: Column | None = None) -> None:
        nonlocal rows, n
        rows = rows.withColumns({f"_m{n + 1}": messages, f"_s{n + 1}": system})
        told = F.struct(F.lit(name).alias("stage"), size(n).alias("tokens_before"), size(n + 1).alias("tokens_after"), ok.alias("ok"))
        stages.append(told if touched is None else F.when(touched, told))
        n += 1

    unknown = F.lit(None).cast("boolean")
    for name, change, check, _ in steps:
        m, system = F.col(f"_m{n}"), F.col(f"_s{n}")
        texts = lambda c: F.transform(c, lambda x: x["text"])
        after = with_text(with_raw(m, name), change)
        kept = F.forall(F.zip_with(texts(m), texts(F.col(f"_m{n + 1}")), check), lambda x: F.coalesce(x, F.lit(True))) & F.coalesce(check(system, F.col(f"_s{n + 1}")), F.lit(True))
        add(name, after, change(system), kept if config.verify_sample > 0 else unknown)
    if reducer:
        m = F.col(f"_m{n}")
        rows = blocks.reduce_prose(rows.withColumn("_texts", F.transform(m, lambda x: x["text"])), "_texts", reducer, config.learned_ratio, "_reduced")
        after = F.zip_with(m, F.col("_reduced"), lambda x, t: F.struct(x["role"].alias("role"), x["head"].alias("head"), t.alias("text"), x["raw"].alias("raw")))
        add("learned", after, F.col(f"_s{n}"), unknown, F.exists(F.zip_with(m, F.col(f"_m{n + 1}"), lambda a, b: ~a["text"].eqNullSafe(b["text"])), lambda x: x))
    if "elision" in at:
        add("elision", with_raw(F.col(f"_m{n}"), "elision"), F.col(f"_s{n}"), unknown, F.get(F.col("_raw.touched"), F.lit(at["elision"])) > 0)
    if config.dedup:
        m = F.col(f"_m{n}")
        rows = rows.withColumn("_dup", tiers.repeated_spans(m, config.dedup_min_chars))
        add("dedup", tiers.without_repeats(m, F.col("_dup")), F.col(f"_s{n}"), unknown, F.size("_dup") > 0)

    original, working = _text(F.transform(p["messages"], lambda m: F.coalesce(m["text"], m["raw"])), p["system"]), _text(_said(F.col("working")), p["system"])
    after = _text(_said(F.col(f"_m{n}")), F.col(f"_s{n}"))
    rows = rows.withColumns({"_before": original, "_working": working, "_done": after})
    dearer = F.coalesce(T.heuristic_tokens(F.col("_done")) > T.heuristic_tokens(F.col("_working")), F.lit(False))
    none = F.array().cast(f"array<{_STAGE}>")
    of_memory = F.struct(F.lit("memory").alias("stage"), T.heuristic_tokens(F.col("_before")).alias("tokens_before"), T.heuristic_tokens(F.col("_working")).alias("tokens_after"), memory.sound(F.col("working")).alias("ok"))
    listed = F.concat(F.when(F.col("compacted"), F.array(of_memory)).otherwise(none), F.when(dearer, none).otherwise(F.array_compact(F.array(*stages)) if stages else none))
    rows = rows.withColumns(
        {
            "_dearer": dearer,
            "stages": F.when(p["messages"].isNotNull(), listed.cast(f"array<{_STAGE}>")),
            "marked": F.coalesce("_raw.marked", F.lit(False)),
            "_after": F.when(dearer, F.col("_working")).otherwise(F.col("_done")),
        }
    )
    rows = rows.withColumns({"chosen": F.when(F.col("_dearer"), F.col("working")).otherwise(F.col(f"_m{n}")), "chosen_system": F.when(F.col("_dearer"), p["system"]).otherwise(F.col(f"_s{n}"))})
    return rows.drop("_raw", "_texts", "_reduced", "_working", "_done", "_dearer", "_dup", *(f"_{x}{i}" for x in "ms" for i in range(n + 1)))


def _alone(key: Column) -> Column:
    """``key``, or for rows without one a key that no other row has: folds leave them alone and none of them is hot."""
    return F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("r"), F.col("request_id").cast("string")))


def _limits(rows: DataFrame, config: Config) -> DataFrame:
    """Adds within_rate: requests that are routed and authorised drain their tenant's bucket, in order of (ts, request_id)."""
    if not config.rate:
        return rows.withColumn("within_rate", F.lit(True))
    asks = F.col("authorized") & F.col("provider").isNotNull()
    asked = rows.withColumn("asks", asks).withColumn("key", _alone(F.when(asks, F.col("tenant"))))
    told = caching.token_bucket(asked, config.burst or max(1.0, config.rate), config.rate / 60, ("request_id",))
    return told.withColumn("within_rate", ~F.col("asks") | F.col("allowed")).drop("key", "asks", "allowed", "retry_after")


def trees(rows: DataFrame, config: Config, reducer: Callable[[list[str], float], list[str]] | None = None) -> DataFrame:
    """Parsed requests with provider, tenant, authorized, and their message trees after memory and all tiers."""
    rows = requests.parse_requests(rows, config.structured)
    tenant = K.tenant_id(K.credential(F.col("headers")), config.salt) if config.multi_tenant or config.allowed else F.lit("")
    rows = rows.withColumn("provider", requests.route(F.col("dialect"), F.col("headers"))).withColumn("tenant", tenant)
    rows = rows.withColumn("authorized", K.is_authorized(F.col("tenant"), config.allowed))
    early = F.when(F.col("provider").isNull(), 502).when(~F.col("authorized"), 401)
    if config.memory == "retrieval" and config.rate:  # what the limit turns away is not remembered
        limited = _limits(rows.select("request_id", "ts", "tenant", "provider", "authorized"), config).select("request_id", "within_rate")
        rows = rows.join(limited, "request_id")
        early = early.when(~F.col("within_rate"), 429)
    return _compressed(_remembered(rows.withColumn("early", early), config).drop("within_rate"), config, reducer)


def _wants_breakpoint(config: Config) -> tuple[Column, Column]:
    """Whether a prefix qualifies for a breakpoint, and its digest."""
    fact = tiers.capability(F.col("dialect"))
    ends = tiers.boundary(F.col("dialect"), F.size("chosen").cast("long"), F.lit(False))
    prefix = F.concat(F.coalesce("chosen_system", F.lit("")), F.coalesce("parsed.tools", F.lit("")), F.array_join(_said(F.slice("chosen", 1, F.greatest(F.size("chosen") - 1, F.lit(0)))), ""))
    least = F.lit(config.inject_least_tokens) if config.inject_least_tokens else fact["min_prefix_tokens"]
    wanted = (fact["model"] == "explicit_breakpoint") & ~F.col("marked") & (ends >= 1) & (T.heuristic_tokens(prefix) >= least)
    return F.coalesce(wanted, F.lit(False)), K.prefix_digest(prefix, config.salt)


def narrowed(rows: DataFrame, config: Config, *, reducer: Callable[[list[str], float], list[str]] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """What each request needs further on, without its texts; row by row but for memory by retrieval, so for streams too."""
    rows, p = trees(rows, config, reducer), F.col("parsed")
    messages = F.transform(p["messages"], lambda m: F.array(m["role"], F.coalesce(m["text"], m["raw"])))
    key = K.cache_key(F.col("dialect"), p["model"], p["system"], messages, p["tools"], config.salt)
    key = F.when(F.col("tenant") != "", F.concat(key, F.lit("|"), F.col("tenant"))).otherwise(key)
    streamed = requests.is_stream(F.col("path"), F.col("body"))
    may = F.lit(config.cache) & p["messages"].isNotNull() & ~F.col("compacted") & ~F.coalesce(p["stream"], F.lit(False)) & ~streamed & ~((F.col("dialect") == "gemini") & p["model"].isNull()) & R.should_cache(F.col("_before"), nocache=config.nocache, bypass_on_secret=config.bypass_on_secret)
    tokens = lambda c: F.coalesce(T.heuristic_tokens(F.col(c)), F.lit(0).cast("long"))
    wanted, digest = _wants_breakpoint(config) if config.inject else (F.lit(False), F.lit(None).cast("string"))
    names = ("request_id", "ts", "dialect", "tenant", "provider", "authorized")
    # from here on rows are narrow, and each is told apart by its request_id: no join parses them again
    narrow = {
        "canonicalized": p["messages"].isNotNull(),
        "tokens_before": tokens("_before"),
        "tokens_after": tokens("_after"),
        "cache_key": F.when(may, key),
        "streamed": streamed,
        "stages": F.col("stages"),
        "memory": F.col("memory"),
        "breakpoint": F.when(wanted, F.size("chosen") - 2),
        "digest": F.when(wanted, digest),
    }
    if config.similarity:
        local = F.col("_before") if embed else V.hashing_embedding(F.col("_before"))
        narrow |= {"scope": F.concat_ws("/", "tenant", F.coalesce(F.concat(F.lit("m"), p["model"]), F.lit(""))), "vector": F.when(may, local)}
    rows = rows.select(*names, *(v.alias(k) for k, v in narrow.items()))
    if config.similarity and embed:
        rows = ports.embedded(rows.withColumnRenamed("vector", "_said"), "_said", embed, "vector").drop("_said")
    return rows


def handled(rows: DataFrame, config: Config = Config(), *, reducer: Callable[[list[str], float], list[str]] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None, responses: DataFrame | None = None) -> DataFrame:  # noqa: B008  it is frozen
    """One row per request: what was done with it.

    request_id, dialect, tenant, status, cache (none, bypass, stream-bypass, miss,
    hit, similar), answered_by, canonicalized, tokens_before, tokens_after, key,
    memory, inject, breakpoint, stages (a row a tier), forwarded, usage,
    duration_ms.  ``responses`` (request_id, status, body, duration_ms) holds what
    providers answer to requests that are forwarded; without it they succeed.
    ``reducer`` and ``embed`` are the models of the learned tier and of the
    similarity cache.  A row without ts is forwarded and neither limited nor cached.
    """
    rows = narrowed(rows, config, reducer=reducer, embed=embed)
    rows = _limits(rows, config)
    status = F.when(F.col("provider").isNull(), 502).when(~F.col("authorized"), 401).when(~F.col("within_rate"), 429)
    rows = rows.withColumn("status", status)
    live = F.col("status").isNull()
    rows = rows.withColumns({c: F.when(live, F.col(c)) for c in ("cache_key", "breakpoint", "digest")})
    if config.inject and config.inject_repeat_aware:
        sightings = rows.withColumn("sighted", _alone(F.col("digest")))
        rows = caching.seen_within(sightings, config.inject_window, ("tenant", "sighted"), order=("request_id",)).withColumn("breakpoint", F.when(F.col("seen"), F.col("breakpoint"))).drop("sighted", "seen")
    if responses is None:
        rows = rows.withColumns({"answered": F.lit(200), "answer_body": F.lit(None).cast("string"), "duration_ms": F.lit(None).cast("double")})
    else:
        told = responses.select("request_id", F.col("status").alias("answered"), F.col("body").alias("answer_body"), F.col("duration_ms").cast("double").alias("duration_ms"))
        rows = rows.join(told, "request_id", "left")
    # a shredded tenant's entries can't be opened, so they are as if never stored
    rows = rows.withColumn("stores", caching.storable(F.col("answered"), F.lit(False)) & ~F.col("tenant").isin(list(config.shredded)))
    if config.similarity:
        rows = caching.answers(rows.withColumns({"key": _alone(F.when(F.col("cache_key").isNotNull(), F.col("scope"))), "entry": F.col("cache_key")}), config.ttl, config.similarity_threshold, config.similarity_entries, ("request_id",))
    else:
        rows = caching.replay(rows.withColumn("key", _alone(F.col("cache_key"))), config.ttl, ("request_id",))
        rows = rows.withColumns({"answer": F.when(F.col("hit"), "hit").otherwise("miss"), "answered_by": F.when(F.col("hit"), F.col("cache_key"))})
    cache = F.when(~live, "none").when(F.col("cache_key").isNull(), F.when(F.col("streamed"), "stream-bypass").otherwise("bypass")).otherwise(F.col("answer"))
    rows = rows.withColumn("cache", cache).withColumn("forwarded", live & ~F.col("cache").isin("hit", "similar"))
    succeeded = F.col("forwarded") & (F.col("answered") >= 200) & (F.col("answered") < 300)
    return rows.select(
        "request_id",
        F.when(F.col("provider").isNull(), "unknown").otherwise(F.col("dialect")).alias("dialect"),
        "tenant",
        F.coalesce("status", F.when(F.col("forwarded"), F.col("answered")).otherwise(200)).alias("status"),
        "cache",
        F.when(F.col("cache").isin("hit", "similar"), F.col("answered_by")).alias("answered_by"),
        "canonicalized",
        "tokens_before",
        "tokens_after",
        F.col("cache_key").alias("key"),
        "memory",
        F.when(F.col("breakpoint").isNotNull(), "on").otherwise("off").alias("inject"),
        "breakpoint",
        "stages",
        "forwarded",
        F.when(succeeded, requests.parse_usage(F.col("dialect"), F.col("answer_body"))).alias("usage"),
        "duration_ms",
    )


def outcomes(rows: DataFrame, config: Config = Config(), **ports_and_responses) -> DataFrame:  # noqa: B008
    """One row per request: dialect, tenant, status, cache, tokens_before, tokens_after, key, stages (a row a tier)."""
    return handled(rows, config, **ports_and_responses).select("request_id", "dialect", "tenant", "status", "cache", "tokens_before", "tokens_after", "key", "stages")


def sent(rows: DataFrame, told: DataFrame, config: Config = Config(), reducer: Callable[[list[str], float], list[str]] | None = None) -> DataFrame:  # noqa: B008
    """(request_id, sent): the bodies that are forwarded, by the outcomes ``told`` of ``handled``.

    Bodies that do not parse go as they came.  This is a second pass over the
    requests; only the narrow decisions are joined to them.
    """
    decided = told.where("forwarded").select("request_id", "breakpoint")
    known = trees(rows, config, reducer).join(decided, "request_id")
    messages = F.transform("chosen", lambda m: F.struct(m["role"].alias("role"), F.when(m["raw"].isNull(), F.concat(m["head"], m["text"])).alias("text"), m["raw"].alias("raw")))
    tree = F.struct(F.col("chosen_system").alias("system"), messages.alias("messages"))
    passed = known.where(F.col("parsed.messages").isNull()).select("request_id", F.col("body").alias("sent"))
    ready = known.where(F.col("parsed.messages").isNotNull()).select("request_id", "dialect", "body", tree.alias("parsed"), "breakpoint")
    return requests.serialize_requests(ready).select("request_id", "sent").unionByName(passed)


def metric_events(told: DataFrame) -> DataFrame:
    """The outcomes of ``handled`` as savings events, which ``sources.files.append_events`` keeps and ``metrics`` reads."""
    return metrics.event_rows(told.select("request_id", "dialect", "cache", "canonicalized", "tokens_before", "tokens_after", F.col("status").alias("status_code"), "duration_ms", "tenant", "stages", F.col("usage").alias("upstream_usage")))


def meta_headers(events: DataFrame) -> DataFrame:
    """(request_id, headers): what a caller is told, as a map; savings are not below 0 here."""
    saved = F.greatest(F.lit(0).cast("long"), F.col("tokens_before") - F.col("tokens_after"))
    pairs = {"cache": "cache", "dialect": "dialect", "tokens-before": "tokens_before", "tokens-after": "tokens_after"}
    flat = [x for name, c in pairs.items() for x in (F.lit(f"x-sparkthrift-{name}"), F.col(c).cast("string"))]
    told = F.create_map(*flat, F.lit("x-sparkthrift-tokens-saved"), saved.cast("string"))
    return events.select("request_id", F.map_filter(told, lambda _, v: v.isNotNull()).alias("headers"))
