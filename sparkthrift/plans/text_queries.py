"""Queries over spans, tiers and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkthrift.functions import invariants as I
from sparkthrift.functions import text as T
from sparkthrift.operators import evaluation as E
from sparkthrift.operators import tiers

from .common import DECORATED, EVENTS_SQL, SPANS_SQL, conversations, decorated, filler_sql, lossless_sql, per_span, table, timed_events, tokens_sql, words_sql, PUNCT_SQL

_SHA = lambda c: F.sha2(c, 256)


def spans_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiers.explode_spans(decorated(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.col("span_idx").cast("long").alias("span_idx"), "mutable", _SHA(F.col("text")).alias("span_sha"))


def span_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = T.join_spans(T.spans(F.col("text"))) == F.col("text")
    return decorated(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(ok).alias("same"))


def _hashed(text):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decorated(spark, sf_dir).select("doc_id", _SHA(text(F.col("text"))).alias("sha"))

    return query


def tier_savings_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input tokens before and after each tier, per language (the flagship)."""
    text, n = F.col("text"), T.heuristic_tokens
    after = T.bind(T.lossless(text), lambda t: F.struct(n(t).alias("t0"), n(T.filler(t)).alias("t1"), n(T.filler(t, T.AGGRESSIVE_FILLERS)).alias("t2")))
    made = decorated(spark, sf_dir).select("lang", n(text).alias("b"), after.alias("x")).select("lang", "b", "x.*")
    sums = made.groupBy("lang").agg(F.count(F.lit(1)).alias("requests"), *(F.sum(x).alias(x) for x in ("b", "t0", "t1", "t2")))
    each = F.array(*(F.struct(F.lit(n).alias("tier"), F.col(c).alias("tokens_after")) for n, c in (("lossless", "t0"), ("filler", "t1"), ("aggressive", "t2"))))
    out = sums.select("lang", "requests", F.col("b").alias("tokens_before"), F.inline(each))
    saved = F.col("tokens_before") - F.col("tokens_after")
    return out.withColumn("tokens_saved", saved).withColumn("ratio", F.round(saved / F.col("tokens_before"), 6))


def ladder_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reduction of each tier, and its gain over the tier before, by size of the input."""
    text, n = F.col("text"), T.heuristic_tokens
    after = T.bind(T.lossless(text), lambda t: F.struct(n(t).alias("t0"), n(T.filler(t)).alias("t1"), n(T.filler(t, T.AGGRESSIVE_FILLERS)).alias("t2")))
    bucket = F.when(n(text) < 200, "small").when(n(text) < 800, "medium").otherwise("large")
    made = decorated(spark, sf_dir).select(bucket.alias("bucket"), n(text).alias("tokens_before"), after.alias("x")).select("bucket", "tokens_before", "x.*")
    each = F.array(*(F.struct(F.lit(tier).alias("tier"), F.lit(level).alias("level"), F.col(f"t{level}").alias("tokens_after")) for level, tier in enumerate(("lossless", "filler", "aggressive"))))
    found = E.ladder(made.select("bucket", "tokens_before", F.inline(each)))
    return found.select("bucket", "tier", "cases", F.round("mean_reduction", 6).alias("mean_reduction"), F.round("gain", 6).alias("gain"))


def never_cost_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    worse = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" padding padding"))).otherwise(T.filler(F.col("text")))
    kept = T.not_longer(F.col("text"), worse)
    return decorated(spark, sf_dir).select("doc_id", T.heuristic_tokens(kept).alias("tokens"), _SHA(kept).alias("sha"))


def invariant_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decorated(spark, sf_dir).withColumn("out", F.when(F.col("doc_id") % 5 == 0, F.concat(T.lossless(F.col("text")), F.lit(" extra"))).otherwise(T.lossless_prose(F.col("text"))))
    return rows.select("doc_id", T.same_words(F.col("text"), F.col("out")).alias("ok"))


def request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against copies whose last message lost its role, gained a word or went missing."""
    rows = conversations(spark, sf_dir).withColumn("last", F.max("msg_idx").over(Window.partitionBy("request_id")) == F.col("msg_idx"))
    harm = lambda k: F.col("last") & (F.col("request_id") % 4 == k)
    after = F.struct("msg_idx", F.when(harm(1), "tool").otherwise(F.col("role")).alias("role"), F.when(harm(2), F.concat("text", F.lit(" extra"))).otherwise(F.col("text")).alias("text"))
    made = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "text"))).alias("x"), F.array_sort(F.collect_list(F.when(~harm(3), after))).alias("y"))
    request = lambda c: F.struct(F.lit(None).cast("string").alias("system"), F.col(c).alias("messages"))
    found = I.request_violations(request("x"), request("y"))
    return made.select("request_id", F.array_join(found, ",").alias("violations"))


def invariant_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.filler_prose(F.col("text"), T.DEFAULT_FILLERS)
    rows = decorated(spark, sf_dir).withColumn("out", F.when(F.col("doc_id") % 5 == 0, F.concat(out, F.lit(" extra"))).when(F.col("doc_id") % 5 == 1, F.regexp_replace(out, r"\S+\s*\z", "")).otherwise(out))
    return rows.select("doc_id", T.removed_only(F.col("text"), F.col("out"), T.DEFAULT_FILLERS).alias("ok"))


def verify_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = timed_events(spark, sf_dir).withColumn("k", nth)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(T.should_verify(F.col("k"), 0.3)).alias("verified"))


def dedup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").alias("msg_idx"), F.lit(0).alias("span_idx"), "text", F.lit(True).alias("mutable"))
    out = tiers.dedup(rows)
    return out.select("request_id", "msg_idx", "deduplicated", T.heuristic_tokens(F.col("text")).alias("tokens"))


def elision_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiers.elide(conversations(spark, sf_dir), F.col("role") == "assistant", keep_recent=2)
    return out.select("request_id", "msg_idx", "elided", T.heuristic_tokens(F.col("text")).alias("tokens"))


def chain_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"lossless": T.same_words}
    return tiers.stage_rows(decorated(spark, sf_dir), "doc_id", "text", [("lossless", T.lossless_prose), ("filler", lambda t: T.filler_prose(t, T.DEFAULT_FILLERS))], checks)


def _filler_query(names: tuple[str, ...]) -> str:
    return f"WITH {SPANS_SQL} SELECT doc_id, sha256(text) AS sha FROM ({per_span(filler_sql('text', names))})"


def _savings_sql(last: str = "") -> str:
    spans_of = "SELECT doc_id, lang, i, mutable, CASE WHEN mutable THEN {} ELSE text END AS text FROM spans"
    parts = [f"WITH {SPANS_SQL}, l AS ({spans_of.format(lossless_sql('text'))})"]
    tier = lambda name, change: f"SELECT lang, '{name}' AS tier, doc_id, {tokens_sql('text')} AS n FROM (SELECT doc_id, any_value(lang) AS lang, string_agg(CASE WHEN mutable THEN {change} ELSE text END, '' ORDER BY i) AS text FROM l GROUP BY doc_id)"
    parts.append(", a AS (" + " UNION ALL ".join((tier("lossless", "text"), tier("filler", filler_sql("text", T.DEFAULT_FILLERS)), tier("aggressive", filler_sql("text", T.AGGRESSIVE_FILLERS)))) + ")")
    parts.append(f", b AS (SELECT doc_id, {tokens_sql('t')} AS n FROM d)")
    if last:
        return " ".join([*parts, last])
    parts.append("SELECT a.lang, count(*) AS requests, sum(b.n)::BIGINT AS tokens_before, a.tier, sum(a.n)::BIGINT AS tokens_after, (sum(b.n) - sum(a.n))::BIGINT AS tokens_saved, round((sum(b.n) - sum(a.n)) / sum(b.n), 6) AS ratio FROM a JOIN b USING (doc_id) GROUP BY a.lang, a.tier")
    return " ".join(parts)


_LADDER = """, c AS (SELECT CASE WHEN b.n < 200 THEN 'small' WHEN b.n < 800 THEN 'medium' ELSE 'large' END AS bucket, a.tier, list_position(['lossless', 'filler', 'aggressive'], a.tier) AS level, CASE WHEN b.n > 0 THEN 1 - a.n / b.n ELSE 0 END AS ratio FROM a JOIN b USING (doc_id)),
m AS (SELECT bucket, tier, level, count(*) AS cases, avg(ratio) AS mean FROM c GROUP BY ALL)
SELECT bucket, tier, cases, round(mean, 6) AS mean_reduction, round(mean - coalesce(lag(mean) OVER (PARTITION BY bucket ORDER BY level), 0), 6) AS gain FROM m"""
_OUT = f"CASE WHEN d.doc_id % 5 = 0 THEN o.text || ' extra' ELSE {lossless_sql('d.t')} END"

def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message beside what the filler tier leaves of it: words before and after, and where those left stood."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SPOKEN).alias("text"))
    rows = rows.withColumn("at", T.alignment(F.col("text"), T.filler(F.col("text"))))
    return rows.select("conv_id", "turn", F.size(T.words(F.col("text"))).cast("long").alias("before"), F.size("at").cast("long").alias("after"), F.sha2(F.array_join(F.col("at").cast("array<string>"), ","), 256).alias("positions"))


#: Turns with fillers, bare and beside marks, at both ends and in the middle.
_SPOKEN = "CASE turn % 3 WHEN 0 THEN concat('Please just ', text, ' really, Just thanks') WHEN 1 THEN concat(text, ' simply (very), simply same') ELSE text END"
_ALIGNED = f"""WITH w AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM (SELECT conv_id, turn, {_SPOKEN} AS text FROM conversations)),
p AS (SELECT conv_id, turn, w, list_filter(range(0, len(w)), lambda i: NOT list_contains([{', '.join(f"'{x}'" for x in T.DEFAULT_FILLERS)}], lower(trim(w[i + 1], {PUNCT_SQL})))) AS held FROM w)
SELECT conv_id, turn, len(w) AS before, len(held) AS after, sha256(array_to_string(held, ',')) AS positions FROM p"""

QUERIES = {
    "word_alignment": (word_alignment, _ALIGNED),
    "request_violations": (
        request_violations,
        f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
h AS (SELECT conv_id, i, role, text, last AND conv_id % 4 = 3 AS gone, CASE WHEN last AND conv_id % 4 = 1 THEN 'tool' ELSE role END AS role2, CASE WHEN last AND conv_id % 4 = 2 THEN text || ' extra' ELSE text END AS text2 FROM c),
v AS (SELECT conv_id, i, gone, CASE WHEN gone THEN NULL WHEN role <> role2 THEN 'role ' || i WHEN {words_sql('text')} <> {words_sql('text2')} THEN 'words ' || i END AS said FROM h)
SELECT conv_id AS request_id, concat_ws(',', CASE WHEN bool_or(gone) THEN 'message count' END, string_agg(said, ',' ORDER BY i)) AS violations FROM v GROUP BY conv_id""",
    ),
    "ladder_means": (ladder_means, _savings_sql(_LADDER)),
    "spans_classify": (spans_classify, f"WITH {SPANS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS span_idx, mutable, sha256(text) AS span_sha FROM spans"),
    "span_roundtrip": (span_roundtrip, f"WITH {SPANS_SQL}, o AS ({per_span('text')}) SELECT d.lang, count(*) AS docs, count(*) FILTER (WHERE o.text = d.t) AS same FROM d LEFT JOIN o USING (doc_id) GROUP BY d.lang"),
    "lossless_text": (_hashed(T.lossless), f"WITH {SPANS_SQL} SELECT doc_id, sha256(text) AS sha FROM ({per_span(lossless_sql('text'))})"),
    "filler_default": (_hashed(T.filler), _filler_query(T.DEFAULT_FILLERS)),
    "filler_aggressive": (_hashed(lambda t: T.filler(t, T.AGGRESSIVE_FILLERS)), _filler_query(T.AGGRESSIVE_FILLERS)),
    "tier_savings_by_lang": (tier_savings_by_lang, _savings_sql()),
    "never_cost_more": (
        never_cost_more,
        f"WITH {SPANS_SQL}, f AS ({per_span(filler_sql('text', T.DEFAULT_FILLERS))}), o AS (SELECT d.doc_id, t, CASE WHEN d.doc_id % 3 = 0 THEN t || ' padding padding' ELSE f.text END AS c FROM d JOIN f USING (doc_id)), k AS (SELECT doc_id, CASE WHEN {tokens_sql('c')} > {tokens_sql('t')} THEN t ELSE c END AS x FROM o) SELECT doc_id, {tokens_sql('x')} AS tokens, sha256(x) AS sha FROM k",
    ),
    "invariant_lossless": (invariant_lossless, f"WITH {SPANS_SQL}, o AS ({per_span(lossless_sql('text'))}) SELECT d.doc_id, {words_sql('d.t')} = {words_sql(_OUT)} AS ok FROM d JOIN o USING (doc_id)"),
    "invariant_filler": (invariant_filler, f"WITH d AS (SELECT doc_id, {DECORATED} AS t FROM documents), w AS (SELECT doc_id, list_filter({words_sql('t')}, lambda v: NOT list_contains([{', '.join(repr(x) for x in T.DEFAULT_FILLERS)}], lower(trim(v, '.,!')))) AS k FROM d) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN len(k) = 0 ELSE true END AS ok FROM w"),
    "verify_sampler": (verify_sampler, f"WITH {EVENTS_SQL}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ev) SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE ceil(k * 0.3::DOUBLE) > ceil((k - 1) * 0.3::DOUBLE)) AS verified FROM k GROUP BY user_id"),
    "dedup_blocks": (dedup_blocks, f"WITH r AS (SELECT source AS request_id, doc_id AS msg_idx, text, length(text) >= 200 AND row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 AS deduplicated FROM documents) SELECT request_id, msg_idx, deduplicated, CASE WHEN deduplicated THEN {(len(tiers.DEDUP_MARKER) + 3) // 4} ELSE {tokens_sql('text')} END AS tokens FROM r"),
    "elision_window": (elision_window, f"WITH r AS (SELECT conv_id AS request_id, turn AS msg_idx, text, role = 'assistant' AND turn < count(*) OVER (PARTITION BY conv_id) - 2 AND length(text) > {len(tiers.ELISION_STUB)} AS elided FROM conversations) SELECT request_id, msg_idx, elided, CASE WHEN elided THEN {(len(tiers.ELISION_STUB) + 3) // 4} ELSE {tokens_sql('text')} END AS tokens FROM r"),
    "chain_stage_stats": (
        chain_stage_stats,
        f"WITH d AS (SELECT doc_id, {DECORATED} AS t FROM documents), l AS (SELECT doc_id, t, {lossless_sql('t')} AS l FROM d), f AS (SELECT *, {filler_sql('l', T.DEFAULT_FILLERS)} AS f FROM l) SELECT doc_id, 'lossless' AS stage, {tokens_sql('t')} AS tokens_before, {tokens_sql('l')} AS tokens_after, {words_sql('t')} = {words_sql('l')} AS ok FROM f UNION ALL SELECT doc_id, 'filler', {tokens_sql('l')}, {tokens_sql('f')}, NULL FROM f",
    ),
}
