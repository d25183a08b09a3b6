"""The lifecycle of requests with every stage on, and its SQL, which computes each stage by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkthrift.functions import text as T
from sparkthrift.operators import memory as M
from sparkthrift.operators import metrics, tiers

from . import lifecycle
from .common import NL, filler_sql, lossless_sql, table, tokens_sql, words_sql
from .config import Config
from .memory_queries import _bullets
from .request_queries import bare_sql

#: Every other turn begins and ends with prose that tiers shorten, around one block of code that repeats.
SAID = f"CASE WHEN turn % 2 = 0 AND role <> 'system' THEN concat('Please just ', text, '   ', {NL}, {NL}, {NL}, {NL}, '```', {NL}, repeat('x = 1  ', 40), {NL}, '```', {NL}, 'really thanks.  ') ELSE text END"
EVERYTHING = Config(filler=True, structured=True, elide=True, elide_keep_recent=3, dedup=True, memory="summary", memory_keep_recent=2, memory_summary_items=3, memory_min_messages=4, inject=True, inject_least_tokens=150, similarity=True, similarity_embedder="hashing", similarity_allow_lexical=True, similarity_threshold=1.0)


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation sent twice, a minute apart, and what providers answer.

    In every third the first turn that is not the system's is a tool's result;
    every tenth goes to no known path; to every seventh the provider answers 500.
    """
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.expr(SAID))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    rows = rows.withColumn("json", quoted)
    said = F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", "json"))))
    chats = rows.groupBy("conv_id").agg(said.alias("said"), F.max(F.when(F.col("role") == "system", F.col("json"))).alias("system"))
    tool = F.col("conv_id") % 3 == 0
    one = lambda m, i: F.when(tool & (i == 0), F.concat(F.lit('{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":'), m["json"], F.lit("}]}"))).otherwise(F.concat(F.lit('{"role":"'), m["role"], F.lit('","content":'), m["json"], F.lit("}")))
    body = F.concat(F.lit('{"model":"m-1"'), F.coalesce(F.concat(F.lit(',"system":'), "system"), F.lit("")), F.lit(',"max_tokens":64,"messages":['), F.array_join(F.transform("said", one), ","), F.lit("]}"))
    path = F.when(F.col("conv_id") % 10 == 9, "/nowhere").otherwise("/v1/messages")
    sent = chats.select("conv_id", path.alias("path"), body.alias("body"), F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    request = (F.col("conv_id") * 2 + F.col("again")).alias("request_id")
    headers = F.array(F.struct(F.lit("k").alias("k"), F.lit("v").alias("v"))).alias("headers")
    rows = sent.select(request, (F.col("conv_id") * 1000.0 + F.col("again") * 60).alias("ts"), "path", headers, "body")
    usage = F.concat(F.lit('{"usage":{"input_tokens":'), "request_id", F.lit(',"output_tokens":2}}'))
    answers = rows.select("request_id", F.when(F.floor(F.col("request_id") / 2) % 7 == 0, 500).otherwise(200).alias("status"), usage.alias("body"), F.lit(1.5).alias("duration_ms"))
    return rows, answers


def _handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, answers = _requests(spark, sf_dir)
    return lifecycle.handled(rows, EVERYTHING, responses=answers)


def lifecycle_every_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with all stages on; the stages as one text each."""
    told = F.transform("stages", lambda s: F.concat(s["stage"], F.lit(":"), s["tokens_before"], F.lit(">"), s["tokens_after"], F.lit(":"), F.coalesce(s["ok"].cast("string"), F.lit("-"))))
    return _handled(spark, sf_dir).select("request_id", "dialect", "status", "cache", "canonicalized", "tokens_before", "tokens_after", "memory", "inject", F.array_join(F.coalesce(told, F.array().cast("array<string>")), " ").alias("stages"), F.coalesce("usage.input", F.lit(0).cast("long")).alias("billed"))


def lifecycle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage table fed by all stages of the lifecycle."""
    return metrics.by_stage(_handled(spark, sf_dir).select(F.inline("stages")))


def lifecycle_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies that are forwarded, after every stage."""
    rows, answers = _requests(spark, sf_dir)
    return lifecycle.sent(rows, lifecycle.handled(rows, EVERYTHING, responses=answers), EVERYTHING).select("request_id", F.sha2("sent", 256).alias("sha"))


_RAW = """'{{"content":[{{"content":' || to_json({0})::VARCHAR || ',"tool_use_id":"t","type":"tool_result"}}],"role":"user"}}'"""


def _whole(text: str) -> str:
    return f"coalesce(any_value({text.replace('@', 's')}), '') || coalesce(string_agg({text.replace('@', 't')}, '' ORDER BY idx), '')"


_EACH = f"""WITH src AS (SELECT conv_id, turn, role, {SAID} AS text FROM conversations),
sys AS (SELECT conv_id, max(text) AS s0 FROM src WHERE role = 'system' GROUP BY 1),
m0 AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM src WHERE role <> 'system'),
m1 AS (SELECT conv_id, idx, n, idx = 0 AND conv_id % 3 = 0 AS is_raw, CASE WHEN idx = 0 AND conv_id % 3 = 0 THEN 'user' ELSE role END AS role, text, CASE WHEN idx = 0 AND conv_id % 3 = 0 THEN {_RAW.format('text')} ELSE text END AS said FROM m0),
y AS (SELECT conv_id, start FROM (SELECT conv_id, any_value(n) AS n, max(idx) FILTER (WHERE role = 'user' AND idx <= greatest(0, n - 2)) AS start FROM m1 WHERE conv_id % 3 <> 0 GROUP BY 1) WHERE n > 4 AND start > 0),
old AS (SELECT m1.conv_id, idx AS turn, text FROM m1 JOIN y USING (conv_id) WHERE idx < start),
{_bullets('old', 3)},
h AS (SELECT conv_id, start, '{M.SUMMARY_HEADER.strip()}' || {NL} || summary || {NL} || {NL} AS header FROM s JOIN y USING (conv_id)),
w0 AS (SELECT m1.conv_id, role, is_raw, text AS t0, said AS c0, CASE WHEN idx = h.start THEN header ELSE '' END AS head, header IS NOT NULL AS compacted, row_number() OVER (PARTITION BY m1.conv_id ORDER BY idx) - 1 AS idx, count(*) OVER (PARTITION BY m1.conv_id) AS n FROM m1 LEFT JOIN h USING (conv_id) WHERE header IS NULL OR idx >= h.start),
w1 AS MATERIALIZED (SELECT *, {lossless_sql('t0')} AS t1, {filler_sql(lossless_sql('t0'), T.DEFAULT_FILLERS)} AS t2 FROM (SELECT conv_id, role, is_raw, c0, head, compacted, idx, n, unnest(range(0, len(string_split(t0, '```')))) AS j, string_split(t0, '```') AS parts, t0 AS whole, string_split(t0, '```')[j + 1] AS t0 FROM w0)),
w2 AS (SELECT conv_id, idx, j, CASE WHEN j % 2 = 1 THEN '```' || t0 || '```' ELSE t0 END AS t0, CASE WHEN j % 2 = 1 THEN '```' || t0 || '```' ELSE t1 END AS t1, CASE WHEN j % 2 = 1 THEN '```' || t0 || '```' ELSE t2 END AS t2, j % 2 = 1 OR ({words_sql('t0')} = {words_sql('t1')}) AS ok1, j % 2 = 1 OR {bare_sql('t1')} = {bare_sql('t2')} AS ok2 FROM w1 WHERE NOT is_raw),
sp AS (SELECT conv_id, idx, j, t2 AS span FROM w2 WHERE t2 <> '' OR j = 0 UNION ALL SELECT conv_id, idx, -1, head FROM w0 WHERE head <> ''),
dd AS (SELECT conv_id, idx, j, CASE WHEN length(span) >= 200 AND row_number() OVER (PARTITION BY conv_id, span ORDER BY idx, j) > 1 THEN '{tiers.DEDUP_MARKER}' ELSE span END AS span, length(span) >= 200 AND row_number() OVER (PARTITION BY conv_id, span ORDER BY idx, j) > 1 AS dup FROM sp),
d AS (SELECT conv_id, idx, string_agg(span, '' ORDER BY j) AS t4, bool_or(dup) AS dup FROM dd GROUP BY 1, 2),
t AS (SELECT conv_id, idx, string_agg(t1, '' ORDER BY j) AS t1, string_agg(t2, '' ORDER BY j) AS t2, bool_and(ok1) AS ok1, bool_and(ok2) AS ok2 FROM w2 GROUP BY 1, 2),
e AS (SELECT w0.conv_id, w0.idx, w0.n, w0.role, w0.is_raw, w0.compacted, w0.t0 AS payload, is_raw AND w0.idx < w0.n - 3 AND length(w0.t0) > {len(tiers.ELISION_STUB)} AS elided, head || c0 AS t0, CASE WHEN is_raw THEN c0 ELSE head || t1 END AS t1, CASE WHEN is_raw THEN c0 ELSE head || t2 END AS t2, coalesce(ok1, true) AS ok1, coalesce(ok2, true) AS ok2, coalesce(d.dup, false) AS dup, t4 FROM w0 LEFT JOIN t USING (conv_id, idx) LEFT JOIN d USING (conv_id, idx)),
f AS (SELECT *, CASE WHEN elided THEN {_RAW.format(f"'{tiers.ELISION_STUB}'")} ELSE t2 END AS t3 FROM e),
g AS (SELECT * REPLACE (CASE WHEN is_raw THEN t3 ELSE t4 END AS t4) FROM f),
k AS (SELECT conv_id, coalesce(any_value(s0), '') AS sy, coalesce(any_value({lossless_sql('s0')}), '') AS sy1, coalesce(any_value({filler_sql(lossless_sql('s0'), T.DEFAULT_FILLERS)}), '') AS sy2, {', '.join(f"string_agg(t{i}, '' ORDER BY idx) AS w{i}" for i in range(5))}, string_agg(t4, '' ORDER BY idx) FILTER (WHERE idx < n - 1) AS prefix, any_value(compacted) AS compacted, bool_and(ok1) AND coalesce(bool_and({words_sql('s0')} = {words_sql(lossless_sql('s0'))}), true) AS ok1, bool_and(ok2) AND coalesce(bool_and({bare_sql(lossless_sql('s0'))} = {bare_sql(filler_sql(lossless_sql('s0'), T.DEFAULT_FILLERS))}), true) AS ok2, bool_or(elided) AS elided, bool_or(dup) AS dup, any_value(n) AS n FROM g LEFT JOIN sys USING (conv_id) GROUP BY 1),
o AS (SELECT conv_id, string_agg(said, '' ORDER BY idx) AS original FROM m1 GROUP BY 1),
q AS MATERIALIZED (SELECT k.*, {tokens_sql('sy || original')} AS before, {tokens_sql('sy || w0')} AS n0, {tokens_sql('sy1 || w1')} AS n1, {tokens_sql('sy2 || w2')} AS n2, {tokens_sql('sy2 || w3')} AS n3, {tokens_sql('sy2 || w4')} AS n4, sha256(sy || original) AS content, CASE WHEN n >= 2 AND {tokens_sql('sy2 || prefix')} >= 150 THEN sha256(sy2 || prefix) END AS digest FROM k JOIN o USING (conv_id)),
r AS (SELECT *, unnest([0, 1]) AS again FROM q),
x AS (SELECT *, conv_id * 2 + again AS request_id, conv_id * 1000 + again * 60 AS ts, conv_id % 10 = 9 AS lost, conv_id % 7 <> 0 AS fine FROM r),
z AS MATERIALIZED (SELECT *, CASE WHEN lost THEN 'none' WHEN compacted THEN 'bypass' WHEN count(*) FILTER (WHERE fine) OVER (PARTITION BY content ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'hit' ELSE 'miss' END AS cache, NOT lost AND digest IS NOT NULL AND coalesce(ts - lag(ts) OVER (PARTITION BY lost, digest ORDER BY ts) <= 300, false) AS inject FROM x)"""
_EVERY = f"""{_EACH}
SELECT request_id, CASE WHEN lost THEN 'unknown' ELSE 'anthropic' END AS dialect, CASE WHEN lost THEN 502 WHEN cache <> 'hit' AND NOT fine THEN 500 ELSE 200 END AS status, cache, NOT lost AS canonicalized, CASE WHEN lost THEN 0 ELSE before END AS tokens_before, CASE WHEN lost THEN 0 ELSE n4 END AS tokens_after,
CASE WHEN lost THEN 'off' WHEN compacted THEN 'summary' ELSE 'ingest' END AS memory, CASE WHEN inject THEN 'on' ELSE 'off' END AS inject,
CASE WHEN lost THEN '' ELSE concat_ws(' ', CASE WHEN compacted THEN 'memory:' || before || '>' || n0 || ':true' END, 'lossless:' || n0 || '>' || n1 || ':' || ok1, 'filler:' || n1 || '>' || n2 || ':' || ok2, CASE WHEN elided THEN 'elision:' || n2 || '>' || n3 || ':-' END, CASE WHEN dup THEN 'dedup:' || n3 || '>' || n4 || ':-' END) END AS stages,
CASE WHEN NOT lost AND cache <> 'hit' AND fine THEN request_id ELSE 0 END AS billed FROM z"""
_METRICS = f"""{_EACH}, st AS (SELECT 'memory' AS stage, before AS b, n0 AS a, true AS ok FROM z WHERE NOT lost AND compacted UNION ALL SELECT 'lossless', n0, n1, ok1 FROM z WHERE NOT lost UNION ALL SELECT 'filler', n1, n2, ok2 FROM z WHERE NOT lost UNION ALL SELECT 'elision', n2, n3, NULL FROM z WHERE NOT lost AND elided UNION ALL SELECT 'dedup', n3, n4, NULL FROM z WHERE NOT lost AND dup)
SELECT stage, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after, (sum(b) - sum(a))::BIGINT AS tokens_saved, printf('%.4f', (sum(b) - sum(a)) / sum(b)::DOUBLE)::DOUBLE AS reduction, count(ok) AS checked, CASE WHEN count(ok) > 0 THEN printf('%.4f', count(*) FILTER (WHERE ok) / count(ok)::DOUBLE)::DOUBLE END AS accuracy FROM st GROUP BY stage"""
_SENT = f"""{_EACH}, j AS (SELECT z.request_id, any_value(sys.s0) IS NOT NULL AS has, any_value(sy2) AS sy, string_agg(CASE WHEN is_raw THEN '{{"content":[{{"content":' || to_json(CASE WHEN g.elided THEN '{tiers.ELISION_STUB}' ELSE payload END)::VARCHAR || ',"tool_use_id":"t","type":"tool_result"' || CASE WHEN inject AND idx = g.n - 2 THEN ',"cache_control":{{"type":"ephemeral"}}' ELSE '' END || '}}],"role":"user"}}'
 ELSE '{{"role":' || to_json(role)::VARCHAR || ',"content":' || CASE WHEN inject AND idx = g.n - 2 THEN '[{{"type":"text","text":' || to_json(t4)::VARCHAR || ',"cache_control":{{"type":"ephemeral"}}}}]' ELSE to_json(t4)::VARCHAR END || '}}' END, ',' ORDER BY idx) AS messages
 FROM z JOIN g USING (conv_id) LEFT JOIN sys USING (conv_id) WHERE cache IN ('miss', 'bypass') GROUP BY 1)
SELECT request_id, sha256('{{"model":"m-1"' || CASE WHEN has THEN ',"system":' || to_json(sy)::VARCHAR ELSE '' END || ',"max_tokens":64,"messages":[' || messages || ']}}') AS sha FROM j"""

QUERIES = {
    "lifecycle_every_stage": (lifecycle_every_stage, _EVERY),
    "lifecycle_metrics": (lifecycle_metrics, _METRICS),
    "lifecycle_sent": (lifecycle_sent, _SENT),
}
