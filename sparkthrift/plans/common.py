"""Inputs that the registered queries share, in Spark and in the oracle's SQL.

The tables hold no fences, fillers or blank runs, so texts are decorated by one
expression that both engines evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
NL = "chr(10)"
DECORATED = f"""CASE doc_id % 4
 WHEN 0 THEN concat('Please just ', text, '   ', {NL}, {NL}, {NL}, {NL}, '```py', {NL}, 'x = 1   ', {NL}, '```', {NL}, {NL}, {NL}, {NL}, 'really thanks.  ')
 WHEN 1 THEN concat(text, {NL}, '```', {NL}, 'really = 1  ', {NL}, '``` tail, Very! ```unterminated  ')
 WHEN 2 THEN concat('Actually, ', text, ' obviously   clearly.  ', {NL}, {NL}, {NL}, {NL})
 ELSE text END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(DECORATED).alias("text"))


#: The decorated texts' spans: doc_id, lang, i, text, mutable.
SPANS_SQL = f"""d AS (SELECT doc_id, lang, {DECORATED} AS t FROM documents),
g AS (SELECT doc_id, lang, t, string_split(t, '```') AS p, (len(string_split(t, '```')) - 1) AS f FROM d),
e AS (SELECT *, unnest(range(0, f // 2 * 2 + 1)) AS i FROM g),
x AS (SELECT doc_id, lang, i, i % 2 = 0 AS mutable, CASE WHEN i % 2 = 1 THEN '```' || p[i + 1] || '```' WHEN i = f // 2 * 2 AND f % 2 = 1 THEN p[i + 1] || '```' || p[i + 2] ELSE p[i + 1] END AS text FROM e),
spans AS (SELECT * FROM x WHERE NOT mutable OR text <> '' OR (SELECT t = '' FROM d WHERE d.doc_id = x.doc_id))"""


def lossless_sql(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '\n\n\n+', {NL} || {NL}, 'g')"


PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def filler_sql(text: str, fillers: tuple[str, ...]) -> str:
    names = ", ".join(f"'{w}'" for w in fillers)
    return f"array_to_string(list_transform(string_split({text}, {NL}), lambda l: array_to_string(list_filter({words_sql('l')}, lambda v: NOT list_contains([{names}], lower(trim(v, {PUNCT_SQL})))), ' ')), {NL})"


def tokens_sql(text: str) -> str:
    return f"((length({text}) + 3) // 4)::BIGINT"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in long form: request_id, msg_idx, role, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("msg_idx"), "role", "text")


EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS ts FROM events)"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "event_type", "value", "props", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


def per_span(change: str) -> str:
    """Texts (doc_id, lang, text) joined from ``spans`` with prose changed."""
    return f"SELECT doc_id, any_value(lang) AS lang, string_agg(CASE WHEN mutable THEN {change} ELSE text END, '' ORDER BY i) AS text FROM spans GROUP BY doc_id"
