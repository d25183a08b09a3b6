"""Queries over caches, limits, metrics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkthrift.functions import text as T
from sparkthrift.operators import caching as C
from sparkthrift.operators import evaluation as E
from sparkthrift.operators import crypto
from sparkthrift.operators import metrics as X
from sparkthrift.operators import registrar
from sparkthrift.operators import reports as P
from sparkthrift.operators import similarity_store as S

from .common import EVENTS_SQL, SPANS_SQL, conversations, decorated, filler_sql, per_span, table, timed_events, tokens_sql, words_sql

HOUR = 3600.0


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).select(F.concat_ws("/", "user_id", "event_type").alias("key"), "ts", "event_id")


def exact_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of odd id probe entries stored by the last even event of the same (type, props)."""
    rows = timed_events(spark, sf_dir).withColumn("key", F.concat_ws("|", "event_type", "props"))
    stored = C.put(C.latest(rows.where("event_id % 2 = 0").select("key", "event_id", F.col("ts").alias("at"), F.lit(200).alias("status_code")), "key", "at"), "at", 30 * 24 * HOUR)
    found = C.probe(rows.where("event_id % 2 = 1").select("event_id", "key", "ts"), stored.drop("event_id"), F.col("ts"))
    return found.select("event_id", "hit", F.col("status_code").cast("long").alias("status_code"))


def cache_ttl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.replay(_keyed(spark, sf_dir), 24 * HOUR)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.count_if("hit").alias("hits"))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "ts")
    return C.token_bucket(rows, 2, 1 / (6 * HOUR))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("allowed")).alias("denied"))


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    denied = _limited(spark, sf_dir).where(~F.col("allowed"))
    return denied.select("key", F.round("ts", 3).alias("ts"), F.round("retry_after", 2).alias("retry_after"))


def prefix_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_events(spark, sf_dir)
    seen = C.seen_within(rows, 24 * HOUR, ("user_id", "event_type"), order=("event_id",))
    return seen.select("event_id", "seen")


def inject_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inject a breakpoint: boundary at least 1, prefix long enough, prefix seen before."""
    rows = timed_events(spark, sf_dir).withColumn("prefix_tokens", F.col("event_id") % 8192).withColumn("boundary", F.col("event_id") % 3)
    seen = C.seen_within(rows, 24 * HOUR, ("user_id", "event_type"), order=("event_id",))
    return seen.select("event_id", (F.col("seen") & (F.col("boundary") >= 1) & (F.col("prefix_tokens") >= 4096)).alias("inject"))


def epoch_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_events(spark, sf_dir).where("event_type = 'purchase' or event_id % 50 = 0").select(F.col("user_id").alias("tenant"))
    tenants = table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant")).distinct()
    return tenants.join(C.epochs(rows), "tenant", "left").select("tenant", F.coalesce("epoch", F.lit(0)).alias("epoch"))


def handle_registrar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed_events(spark, sf_dir).select("event_id", "ts", F.col("user_id").cast("string").alias("credential"), F.lit("m").alias("model"), F.col("event_type").alias("prefix"))
    return registrar.ensure(rows, ttl=HOUR, max_live=8)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.lit("m").alias("model"), (F.col("label") % 2).alias("tenant"))
    probes = rows.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "probe_id")
    index = rows.where("vec_id % 2 = 1").withColumn("seq", F.col("vec_id")).withColumnRenamed("vec_id", "key")
    return probes, index


def similarity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, index = _index(spark, sf_dir)
    return C.similar(probes, C.newest(index, 2048), 0.3).select("probe_id", "key", F.round("similarity", 6).alias("similarity"))


def similar_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest entry's response; every third entry has expired, and every fifth was never stored."""
    probes, index = _index(spark, sf_dir)
    cache = index.where("key % 5 <> 0").select("key", F.lit(0.0).alias("created_at"), F.when(F.col("key") % 3 == 0, 50.0).otherwise(500.0).alias("expires_at"), (F.lit(200) + F.col("key") % 7).alias("status_code"))
    found = C.similar_response(probes, C.newest(index, 2048), 0.3, cache, F.lit(100.0))
    return found.select("probe_id", "key", "hit", "status_code")


def similarity_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh vector does not decode."""
    entries = _index(spark, sf_dir)[1].withColumn("vector", F.when(F.col("key") % 11 != 0, F.col("vector")))
    return C.hydrate(entries, 50).select("key", F.col("place").cast("long").alias("place"))


def similarity_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed entries of five tenants, trimmed to 120; then the newest 60 are loaded, without a shredded tenant's and those that were changed."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.concat(F.lit("k"), "vec_id").alias("key"), F.lit("m").alias("model"), F.concat(F.lit("t"), F.col("vec_id") % 5).alias("tenant"), F.col("embedding").alias("vector"), F.col("vec_id").cast("double").alias("created_at"))
    master = bytes(range(32))
    stored = S.trim(S.append(rows, crypto.tenant_keys(rows, master)), 120)
    stored = stored.withColumn("blob", F.when(F.col("seq") % 13 == 0, F.concat(F.col("blob"), F.lit(b"!"))).otherwise(F.col("blob")))
    found = S.load(stored, 60, crypto.tenant_keys(rows, master, shredded=["t2"]))
    return found.select("place", "key", "tenant", F.size("vector").cast("long").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def store_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers are stored, by type of event; every seventh has no status."""
    status = F.when(F.col("event_id") % 7 != 0, F.lit(199) + F.col("event_id") % 5 * 50)
    rows = timed_events(spark, sf_dir).withColumn("stored", C.storable(status, F.col("event_id") % 3 == 0))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("answers"), F.count_if("stored").alias("stored"))


def similarity_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.newest(_index(spark, sf_dir)[1], 100).select("key", "seq", F.size("vector").cast("long").alias("dim"))


def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (2i, 2i + 1) with the same label should hit; a copy of each vector should, too."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    a = rows.where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("i"), F.col("v").alias("anchor"), F.col("label").alias("la"))
    b = rows.where("vec_id % 2 = 1").select(((F.col("vec_id") - 1) / 2).cast("long").alias("i"), F.col("v").alias("variant"), F.col("label").alias("lb"))
    pairs = a.join(b, "i").select("anchor", "variant", (F.col("la") == F.col("lb")).alias("should_hit"))
    copies = rows.select(F.col("v").alias("anchor"), F.transform("v", lambda x: x * 2).alias("variant"), F.lit(True).alias("should_hit"))
    report = E.similarity_report(pairs.unionByName(copies), 0.97)
    return report.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "false_hits", "passed")


def savings_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the proxy mapped from the events table."""
    cache = F.expr("CASE event_id % 5 WHEN 0 THEN 'hit' WHEN 1 THEN 'similar' ELSE 'miss' END")
    tenant = F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id") % 4))
    return timed_events(spark, sf_dir).select("event_id", cache.alias("cache"), tenant.alias("tenant"), (F.col("event_id") % 1000).alias("tokens_before"), (F.col("event_id") % 1000 - F.col("event_id") % 7).alias("tokens_after"), "event_type", "value")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.expr("CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE event_id % 2 = 0 END")
    rows = savings_events(spark, sf_dir).withColumn("stage", F.expr("CASE event_id % 4 WHEN 0 THEN 'lossless' WHEN 1 THEN 'filler' WHEN 2 THEN 'dedup' ELSE 'learned' END"))
    return rows.select("stage", "tokens_before", "tokens_after", F.when(F.col("stage") != "learned", ok).alias("ok"))


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), ((F.col("event_id") % 9) / 8).alias("score"), (F.col("event_id") % 2 == 0).alias("passed"))


def metrics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.totals(savings_events(spark, sf_dir))


def metrics_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.by_stage(stage_events(spark, sf_dir))


def metrics_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.by_tenant(savings_events(spark, sf_dir))


def latest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_evals(eval_runs(spark, sf_dir))


def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.prometheus(metrics_totals(spark, sf_dir), metrics_by_stage(spark, sf_dir), latest_eval(spark, sf_dir))
    return out


def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.stats_lines(metrics_totals(spark, sf_dir), metrics_by_stage(spark, sf_dir), latest_eval(spark, sf_dir), metrics_by_tenant(spark, sf_dir))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged; some cost more after than before."""
    rows = savings_events(spark, sf_dir).withColumn("tokens_after", F.col("tokens_after") + F.when(F.col("event_id") % 11 == 0, 9).otherwise(0))
    return X.event_rows(rows).select("event", "event_id", "cache", "tenant", "tokens_before", "tokens_after", "tokens_saved", "ratio")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filler tier held to the lossless gate; every seventh document could not be parsed."""
    rows = decorated(spark, sf_dir).withColumn("name", F.concat(F.lit("doc-"), "doc_id"))
    rows = rows.withColumn("short", F.when(F.col("doc_id") % 7 != 0, T.filler(F.col("text"))))
    return E.samples(rows, F.col("short"), T.heuristic_tokens(F.col("text")), T.heuristic_tokens(F.col("short")), T.same_words(F.col("text"), F.col("short")))


def eval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.totals(_results(spark, sf_dir)).withColumn("overall_ratio", F.round("overall_ratio", 6))


def eval_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.samples(_results(spark, sf_dir))


def similarity_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even vector with the next odd one; those of the same label should hit."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    a = rows.where("vec_id % 2 = 0").select("vec_id", F.col("v").alias("anchor"), F.col("label").alias("la"))
    b = rows.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("variant"), F.col("label").alias("lb"))
    pairs = a.join(b, "vec_id").select(F.concat(F.lit("pair-"), "vec_id").alias("name"), "anchor", "variant", (F.col("la") == F.col("lb")).alias("should_hit"))
    return P.similarity(pairs, 0.1)


def similarity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors asked in order of their ids, in two scopes, answered by what came before."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    events = rows.select((F.col("label") % 2).cast("string").alias("key"), F.col("vec_id").cast("double").alias("ts"), F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("vector"))
    return C.similar_replay(events, 0.3, 1e9, 2048, ("entry",)).select("entry", "key", "answered_by", F.round("similarity", 6).alias("similarity"))


def judged_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do filler-free texts keep their first word and a filler they had?"""
    must = F.array(F.get(F.split("text", " "), F.lit(0)), F.when(F.col("doc_id") % 4 == 2, "Obviously").otherwise(F.get(F.split("text", " "), F.lit(0))))
    rows = table(spark, sf_dir, "documents").withColumn("must", must).select("doc_id", "must").join(decorated(spark, sf_dir), "doc_id")
    score = E.recall(T.filler(F.col("text"), T.AGGRESSIVE_FILLERS), F.col("must"))
    cases = rows.select("doc_id", score.alias("score"), (score >= 1.0).alias("passed"))
    return E.report(cases)


def judge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decorated(spark, sf_dir)
    each = [rows.select(F.lit(name).alias("tier"), T.heuristic_tokens(F.col("text")).alias("tokens_before"), T.heuristic_tokens(T.filler(F.col("text"), words)).alias("tokens_after"), (F.col("doc_id") % 2 == 0).alias("kept")) for name, words in (("L1", T.DEFAULT_FILLERS), ("L2", T.AGGRESSIVE_FILLERS))]
    out = E.tier_scores(each[0].unionByName(each[1]))
    return out.withColumn("mean_reduction", F.round("mean_reduction", 4))


def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return E.best_ratio(rows.select((F.col("n") / 10).alias("ratio"), (F.col("n") >= 4).alias("passed"), F.col("c").alias("mean_score")))


def requests_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of conversations as requests: messages and tokens per role."""
    rows = conversations(spark, sf_dir)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(T.heuristic_tokens(F.col("text"))).alias("tokens"))


_SAV = f"WITH {EVENTS_SQL}, s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'hit' WHEN 1 THEN 'similar' ELSE 'miss' END AS cache, CASE WHEN user_id % 4 = 0 THEN '' ELSE 't' || (user_id % 4) END AS tenant, event_id % 1000 AS b, event_id % 1000 - event_id % 7 AS a, event_type FROM ev), st AS (SELECT CASE event_id % 4 WHEN 0 THEN 'lossless' WHEN 1 THEN 'filler' WHEN 2 THEN 'dedup' ELSE 'learned' END AS stage, b, a, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE event_id % 2 = 0 END END AS ok FROM s)"
_TOT = "SELECT count(*) AS requests, count(*) FILTER (WHERE cache = 'hit') AS hits, count(*) FILTER (WHERE cache = 'similar') AS similar_hits, printf('%.4f', (count(*) FILTER (WHERE cache = 'hit') / count(*))::DOUBLE)::DOUBLE AS cache_hit_rate, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, (sum(b) - sum(a))::BIGINT AS tokens_saved, printf('%.4f', ((sum(b) - sum(a)) / sum(b))::DOUBLE)::DOUBLE AS overall_ratio FROM s"
_STG = "SELECT stage, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, (sum(b) - sum(a))::BIGINT AS tokens_saved, printf('%.4f', ((sum(b) - sum(a)) / sum(b))::DOUBLE)::DOUBLE AS reduction, count(ok) AS checked, printf('%.4f', (count(*) FILTER (WHERE ok) / nullif(count(ok), 0))::DOUBLE)::DOUBLE AS accuracy FROM st GROUP BY stage"
_TEN = "SELECT tenant, count(*) AS requests, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, printf('%.4f', ((sum(b) - sum(a)) / sum(b))::DOUBLE)::DOUBLE AS reduction FROM s WHERE tenant <> '' GROUP BY tenant"
_EVL = "SELECT event_type AS kind, arg_max((event_id % 9) / 8, event_id) AS score, arg_max(event_id % 2 = 0, event_id) AS passed FROM s GROUP BY event_type"
_NUM = r"regexp_replace(printf('%.6f', ({0})::DOUBLE), '(\.\d+?)0+$', '\1')"
_SAMPLES = " UNION ALL ".join(
    [f"SELECT {i} AS family, 2 AS part, '' AS label, 'sparkthrift_{n} ' || {v} AS line FROM tot" for i, n, v in ((0, "requests_total", "requests"), (1, "cache_hit_rate", _NUM.format("cache_hit_rate")), (2, "tokens_saved_total", "tokens_saved"), (3, "overall_reduction_ratio", _NUM.format("overall_ratio")))]
    + [f"SELECT {i}, 2, stage, 'sparkthrift_stage_{n}{{stage=\"' || stage || '\"}} ' || {v} FROM stg WHERE {w}" for i, n, v, w in ((4, "reduction_ratio", _NUM.format("reduction"), "true"), (5, "tokens_saved_total", "tokens_saved", "true"), (6, "accuracy_ratio", _NUM.format("accuracy"), "accuracy IS NOT NULL"))]
    + [f"SELECT {i}, 2, kind, 'sparkthrift_eval_{n}{{kind=\"' || kind || '\"}} ' || {v} FROM evl" for i, n, v in ((7, "score", _NUM.format("score")), (8, "passed", "passed::INT"))]
)
# Name, type and help of each family.
_HELP = (
    ("requests_total", "counter", "Requests seen."),
    ("cache_hit_rate", "gauge", "Share of requests answered from the exact cache."),
    ("tokens_saved_total", "counter", "Input tokens saved."),
    ("overall_reduction_ratio", "gauge", "Share of input tokens saved."),
    ("stage_reduction_ratio", "gauge", "Share of tokens saved by a stage."),
    ("stage_tokens_saved_total", "counter", "Tokens saved by a stage."),
    ("stage_accuracy_ratio", "gauge", "Share of a stage's checked rows that held."),
    ("eval_score", "gauge", "Latest score of a gate."),
    ("eval_passed", "gauge", "Latest verdict of a gate (1: passed)."),
)
_HEADS = ", ".join("({}, 0, '# HELP sparkthrift_{} {}'), ({}, 1, '# TYPE sparkthrift_{} {}')".format(i, n, about.replace("'", "''"), i, n, kind) for i, (n, kind, about) in enumerate(_HELP))
_PROM = f"SELECT * FROM pages_of UNION ALL SELECT h.family, h.part, '', h.line FROM (VALUES {_HEADS}) AS h(family, part, line) WHERE h.family IN (SELECT family FROM pages_of)"
_PCT = "printf('%.1f%%', ({0}) * 100)"
_LINES = f"""SELECT 0 AS part, '' AS label, 'requests=' || requests || '  cache_hit_rate=' || {_PCT.format('cache_hit_rate')} || '  tokens ' || tokens_before || '->' || tokens_after || ' (saved ' || tokens_saved || ', ' || {_PCT.format('overall_ratio')} || ')' AS line FROM tot
UNION ALL SELECT 1, stage, rpad(stage, 14, ' ') || ' ' || printf('%8d %8d', tokens_before, tokens_after) || ' ' || lpad({_PCT.format('reduction')}, 10, ' ') || ' ' || lpad(CASE WHEN accuracy IS NULL THEN 'n/a' ELSE {_PCT.format('accuracy')} END, 9, ' ') FROM stg
UNION ALL SELECT 2, kind, '  ' || rpad(kind, 20, ' ') || ' score=' || {_PCT.format('score')} || '  ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END FROM evl
UNION ALL SELECT 3, tenant, repeat(' ', 25) || rpad(tenant, 18, ' ') || ' ' || printf('%6d', requests) || ' ' || lpad({_PCT.format('reduction')}, 10, ' ') FROM ten"""
_BUCKET = f"WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM ev), f AS (SELECT key, k, ts, 1.0::DOUBLE AS tokens, true AS allowed, 0.0::DOUBLE AS wait FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.ts, CASE WHEN least(2.0, f.tokens + greatest(0, o.ts - f.ts) * (1 / 21600.0::DOUBLE)) >= 1 THEN least(2.0, f.tokens + greatest(0, o.ts - f.ts) * (1 / 21600.0::DOUBLE)) - 1 ELSE least(2.0, f.tokens + greatest(0, o.ts - f.ts) * (1 / 21600.0::DOUBLE)) END, least(2.0, f.tokens + greatest(0, o.ts - f.ts) * (1 / 21600.0::DOUBLE)) >= 1, (1 - least(2.0, f.tokens + greatest(0, o.ts - f.ts) * (1 / 21600.0::DOUBLE))) * 21600 FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)"
_SEEN = f"{EVENTS_SQL}, l AS (SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 86400, false) AS seen FROM ev)"
_IDX = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 2 AS tenant, label FROM embeddings)"

_RES = f"""WITH {SPANS_SQL}, f AS ({per_span(filler_sql('text', T.DEFAULT_FILLERS))}),
res AS (SELECT 'doc-' || doc_id AS name, doc_id % 7 <> 0 AS known, CASE WHEN known THEN {tokens_sql('d.t')} ELSE 0 END AS b, CASE WHEN known THEN {tokens_sql('f.text')} ELSE 0 END AS a, NOT known OR {words_sql('d.t')} = {words_sql('f.text')} AS ok FROM d JOIN f USING (doc_id)),
tot AS (SELECT count(*) AS samples, count(*) FILTER (WHERE known) AS canonicalized, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, (sum(b) - sum(a))::BIGINT AS tokens_saved, (sum(b) - sum(a)) / sum(b) AS overall_ratio, count(*) FILTER (WHERE NOT ok) AS regressions, bool_and(ok) AS passed FROM res)"""
_RES_LINES = f"""{_RES} SELECT 2 AS part, name, printf('%-28s %5s %7d %7d %6.1f%% %3s', name, CASE WHEN known THEN 'yes' ELSE 'no' END, b, a, CASE WHEN b > 0 THEN 100 * ((b - a) / b) ELSE 0.0 END, CASE WHEN ok THEN 'ok' ELSE 'FAIL' END) AS line FROM res
UNION ALL SELECT 0, '', 'sample                       canon  before   after  saved%  ok' UNION ALL SELECT unnest([1, 3]), '', repeat('-', 60)
UNION ALL SELECT 4, '', printf('TOTAL  samples=%d canonicalised=%d  tokens %d->%d (saved %d, %.1f%%)  regressions=%d  %s', samples, canonicalized, tokens_before, tokens_after, tokens_saved, 100 * overall_ratio, regressions, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END) FROM tot"""
_SIM_LINES = f"""WITH {_IDX}, p AS (SELECT 'pair-' || a.vec_id AS name, list_cosine_similarity(a.v, b.v) AS s, a.label = b.label AS want FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0), h AS (SELECT *, s >= 0.1 AS hit FROM p)
SELECT 2 AS part, name, printf('%-28s %6.3f %5s %5s %4s', name, s, CASE WHEN hit THEN 'hit' ELSE 'miss' END, CASE WHEN want THEN 'hit' ELSE 'miss' END, CASE WHEN hit = want THEN 'ok' ELSE 'XX' END) AS line FROM h
UNION ALL SELECT 0, '', 'case                            sim  pred  want   ok' UNION ALL SELECT unnest([1, 3]), '', repeat('-', 52)
UNION ALL SELECT 4, '', printf('threshold=0.100  precision=%.1f%%  recall=%.1f%%  false_hits=%d  %s', 100 * coalesce(count(*) FILTER (WHERE hit AND want) / nullif(count(*) FILTER (WHERE hit), 0), 1), 100 * coalesce(count(*) FILTER (WHERE hit AND want) / nullif(count(*) FILTER (WHERE want), 0), 1), count(*) FILTER (WHERE hit AND NOT want), CASE WHEN count(*) FILTER (WHERE hit AND NOT want) = 0 THEN 'PASS' ELSE 'FAIL' END) FROM h"""

QUERIES = {
    "exact_cache_probe": (exact_cache_probe, f"WITH {EVENTS_SQL}, k AS (SELECT *, event_type || '|' || props AS key FROM ev), c AS (SELECT key, max(ts) AS put_at FROM k WHERE event_id % 2 = 0 GROUP BY key) SELECT event_id, coalesce(put_at + 2592000 > ts AND put_at <= ts, false) AS hit, CASE WHEN put_at + 2592000 > ts AND put_at <= ts THEN 200 END::BIGINT AS status_code FROM k LEFT JOIN c USING (key) WHERE event_id % 2 = 1"),
    "cache_ttl_replay": (cache_ttl_replay, f"WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id || '/' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM ev), f AS (SELECT key, k, ts AS stored, false AS hit FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, CASE WHEN o.ts < f.stored + 86400 THEN f.stored ELSE o.ts END, o.ts < f.stored + 86400 FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1) SELECT key, count(*) AS events, count(*) FILTER (WHERE hit) AS hits FROM f GROUP BY key"),
    "token_bucket": (token_bucket, f"{_BUCKET} SELECT key, count(*) AS events, count(*) FILTER (WHERE NOT allowed) AS denied FROM f GROUP BY key"),
    "retry_after": (retry_after, f"{_BUCKET} SELECT key, round(ts, 3) AS ts, round(wait, 2) AS retry_after FROM f WHERE NOT allowed"),
    "prefix_seen": (prefix_seen, f"WITH {_SEEN} SELECT event_id, seen FROM l"),
    "inject_decision": (inject_decision, f"WITH {_SEEN} SELECT event_id, seen AND event_id % 3 >= 1 AND event_id % 8192 >= 4096 AS inject FROM l"),
    "epoch_counter": (epoch_counter, "SELECT user_id AS tenant, count(*) FILTER (WHERE event_type = 'purchase' OR event_id % 50 = 0) AS epoch FROM events GROUP BY user_id"),
    "handle_registrar": (handle_registrar, None),
    "similarity_lookup": (similarity_lookup, f"WITH {_IDX}, p AS (SELECT a.vec_id AS probe_id, b.vec_id AS key, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN (SELECT * FROM v WHERE vec_id % 2 = 1 ORDER BY vec_id DESC LIMIT 2048) b ON a.tenant = b.tenant WHERE a.vec_id % 2 = 0) SELECT probe_id, arg_max(key, [s, key::DOUBLE]) AS key, round(max(s), 6) AS similarity FROM p WHERE s >= 0.3 GROUP BY probe_id"),
    "similar_response": (
        similar_response,
        f"WITH {_IDX}, p AS (SELECT a.vec_id AS probe_id, b.vec_id AS key, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN (SELECT * FROM v WHERE vec_id % 2 = 1 ORDER BY vec_id DESC LIMIT 2048) b ON a.tenant = b.tenant WHERE a.vec_id % 2 = 0), n AS (SELECT probe_id, arg_max(key, [s, key::DOUBLE]) AS key FROM p WHERE s >= 0.3 GROUP BY probe_id) SELECT v.vec_id AS probe_id, key, coalesce(key % 5 <> 0 AND key % 3 <> 0, false) AS hit, CASE WHEN key % 5 <> 0 AND key % 3 <> 0 THEN 200 + key % 7 END AS status_code FROM v LEFT JOIN n ON n.probe_id = v.vec_id WHERE v.vec_id % 2 = 0",
    ),
    "similarity_hydrate": (similarity_hydrate, "SELECT vec_id AS key, row_number() OVER (ORDER BY vec_id) AS place FROM (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 1 ORDER BY vec_id DESC LIMIT 50) WHERE vec_id % 11 <> 0"),
    "similarity_store": (similarity_store, "SELECT row_number() OVER (ORDER BY vec_id) AS place, 'k' || vec_id AS key, 't' || vec_id % 5 AS tenant, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 60) WHERE vec_id % 5 <> 2 AND vec_id % 13 <> 0"),
    "store_decision": (store_decision, "SELECT event_type, count(*) AS answers, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 AND event_id % 5 IN (1, 2)) AS stored FROM events GROUP BY event_type"),
    "similarity_fifo": (similarity_fifo, "SELECT vec_id AS key, vec_id AS seq, len(embedding) AS dim FROM embeddings WHERE vec_id % 2 = 1 ORDER BY vec_id DESC LIMIT 100"),
    "similarity_gate": (similarity_gate, f"WITH {_IDX}, p AS (SELECT list_cosine_similarity(a.v, b.v) >= 0.97 AS hit, a.label = b.label AS want FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0 UNION ALL SELECT true, true FROM v) SELECT round(count(*) FILTER (WHERE hit AND want) / nullif(count(*) FILTER (WHERE hit), 0), 6) AS precision, round(count(*) FILTER (WHERE hit AND want) / count(*) FILTER (WHERE want), 6) AS recall, count(*) FILTER (WHERE hit AND NOT want) AS false_hits, count(*) FILTER (WHERE hit AND NOT want) = 0 AS passed FROM p"),
    "metrics_totals": (metrics_totals, f"{_SAV} {_TOT}"),
    "metrics_by_stage": (metrics_by_stage, f"{_SAV} {_STG}"),
    "metrics_by_tenant": (metrics_by_tenant, f"{_SAV} {_TEN}"),
    "latest_eval": (latest_eval, f"{_SAV} {_EVL}"),
    "prometheus_lines": (prometheus_lines, f"{_SAV}, tot AS ({_TOT}), stg AS ({_STG}), evl AS ({_EVL}), pages_of AS ({_SAMPLES}) {_PROM}"),
    "stats_lines": (stats_lines, f"{_SAV}, tot AS ({_TOT}), stg AS ({_STG}), evl AS ({_EVL}), ten AS ({_TEN}) {_LINES}"),
    "event_rows": (event_rows, f"{_SAV}, e AS (SELECT event_id, cache, tenant, b, a + CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END AS a FROM s) SELECT 'savings' AS event, event_id, cache, tenant, b AS tokens_before, a AS tokens_after, greatest(0, b - a) AS tokens_saved, printf('%.4f', (CASE WHEN b > 0 THEN greatest(0, b - a) / b ELSE 0 END)::DOUBLE)::DOUBLE AS ratio FROM e"),
    "eval_totals": (eval_totals, f"{_RES} SELECT * REPLACE (round(overall_ratio, 6) AS overall_ratio) FROM tot"),
    "eval_report_lines": (eval_report_lines, _RES_LINES),
    "similarity_report_lines": (similarity_report_lines, _SIM_LINES),
    "similarity_replay": (similarity_replay, None),
    "judged_recall": (judged_recall, "SELECT count(*) AS cases, round(avg(CASE WHEN doc_id % 4 = 2 THEN 0.5 ELSE 1 END), 6) AS mean_score, count(*) FILTER (WHERE doc_id % 4 <> 2) AS num_passed, bool_and(doc_id % 4 <> 2) AS passed FROM documents"),
    "judge_tiers": (judge_tiers, f"WITH {SPANS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS tier, count(*) AS cases, count(*) FILTER (WHERE doc_id % 2 = 0) AS kept, round(avg(1 - {tokens_sql('f.text')} / {tokens_sql('d.t')}), 4) AS mean_reduction FROM ({per_span(filler_sql('text', w))}) f JOIN d USING (doc_id)" for n, w in (("L1", T.DEFAULT_FILLERS), ("L2", T.AGGRESSIVE_FILLERS)))),
    "sweep_best": (sweep_best, "SELECT min(l_linenumber / 10) AS best_ratio FROM lineitem WHERE l_linenumber >= 4"),
    "requests_by_role": (requests_by_role, f"SELECT role, count(*) AS messages, sum({tokens_sql('text')})::BIGINT AS tokens FROM conversations GROUP BY role"),
}
