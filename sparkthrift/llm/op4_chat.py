"""Chat formatting with a grammar round trip.  DataFrame functions only.

A conversation is rendered turn by turn:

    [INST:s] role [INST:t] text </s> newline

with ``s`` ("0" or "1") telling whether role and text are escaped.  The parser
splits at the closing mark and reads each turn with one anchored pattern.  A
turn is first rendered as it is and reparsed; if what comes back is not the
one same turn, its control strings are escaped and it is reparsed again.
Escaping puts a backslash after the first character of a control string, or
adds one to those that stand there, so no control string is left in an escaped
text and one backslash less brings it back; every text is identical then, and
a turn that is not raises an error instead of passing silently.

Spans of the loss mask (assistant texts as they stand in the output, code
points) come from running sums of turn lengths.

Defined cases: null role or text is empty; rows are ordered by turn (null
first), then role, then text; repeated rows are turns of their own; a null
conv_id is a conversation of its own; extra columns are ignored; no rows give no
rows.  A conversation is one output string and so is built by one task; its
turns are rendered, checked and measured before that, over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: First characters and rests of the template's control strings.
OPEN, TEXT, CLOSE = "[INST:", "[/INST]", "</s>"
_ESCAPE = r"(\[|<)(\\*)(INST:|/INST\]|/s>)"
_UNESCAPE = r"(\[|<)\\(\\*)(INST:|/INST\]|/s>)"
_TURN = r"(?s)\A\[INST:([01])\](.*?)\[/INST\](.*)\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def render(role: Column, text: Column, escaped: bool) -> Column:
    head = F.lit(f"{OPEN}{int(escaped)}]")
    if escaped:
        role, text = escape(role), escape(text)
    return F.concat(head, role, F.lit(TEXT), text, F.lit(CLOSE), F.lit("\n"))


def _fields(body: Column) -> Column:
    """role, text and form of one turn without its closing mark; null if it is none."""
    flag = F.regexp_extract(body, _TURN, 1)
    role, text = F.regexp_extract(body, _TURN, 2), F.regexp_extract(body, _TURN, 3)
    form = F.length(body) - F.length(F.regexp_extract(body, _TURN, 3))
    back = lambda x: F.when(flag == "1", unescape(x)).otherwise(x)
    return F.when(flag != "", F.struct(back(role).alias("role"), back(text).alias("text"), text.alias("as_written"), form.cast("long").alias("head")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order: array of (role, text, as_written, head)."""
    bodies = F.split(formatted, r"</s>\n", -1)
    return F.transform(F.slice(bodies, 1, F.size(bodies) - 1), _fields)


def _same(rendered: Column, role: Column, text: Column) -> Column:
    """Does the rendered turn come back as just this turn, also between other turns?"""
    bodies = F.split(F.concat(rendered, F.lit(OPEN)), r"</s>\n", -1)
    one = _fields(bodies[0])
    return F.coalesce((F.size(bodies) == 2) & (bodies[1] == OPEN) & (one["role"] == role) & (one["text"] == text), F.lit(False))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask, formatted_chars.

    ``loss_mask`` has the (start, length) of each assistant text in ``formatted``.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    plain, safe = render(role, text, False), render(role, text, True)
    rows = rows.withColumn("plain", plain).withColumn("rendered", F.when(_same(F.col("plain"), role, text), F.col("plain")).otherwise(safe))
    broken = F.raise_error(F.lit("a turn does not survive its round trip")).cast("string")
    rows = rows.withColumn("rendered", F.when(_same(F.col("rendered"), role, text), F.col("rendered")).otherwise(broken))
    tail = len(CLOSE) + 1
    written = F.when(F.col("rendered").startswith(f"{OPEN}1]"), F.length(escape(text))).otherwise(F.length(text))
    rows = rows.select("conv_id", "turn", "role", "text", "rendered", F.length("rendered").cast("long").alias("chars"), written.cast("long").alias("written"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    place = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("chars").over(place)).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - tail - F.col("written")).alias("start"), F.col("written").alias("length")))
    rows = rows.select("conv_id", F.struct("nth", "rendered", span.alias("span")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: t["rendered"]), "")
    mask = F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"])
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), mask.alias("loss_mask")).withColumn("formatted_chars", F.length("formatted").cast("long"))


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads the turns and the masked text back from ``formatted`` alone."""
    turns = parse(F.col("formatted"))
    read = chats.select("conv_id", "formatted_chars", "formatted", "loss_mask", turns.alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # a masked text is escaped if its turn says so; the turns of the mask are the assistant's, in order
    spoken = F.filter("turns", lambda t: t["role"] == "assistant")
    cut = F.zip_with("loss_mask", spoken, lambda m, t: F.struct(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")).alias("cut"), t.alias("turn")))
    kept = F.transform(cut, lambda x: F.when(x["cut"] == x["turn"]["as_written"], F.when(x["cut"] == x["turn"]["text"], x["cut"]).otherwise(unescape(x["cut"]))).otherwise(F.raise_error(F.lit("the loss mask misses its text")).cast("string")))
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.array_join(kept, "").alias("loss"), "formatted_chars")
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return read_chats(format_chats(turns.unionByName(extra)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, CASE WHEN contains(role || text, '</s>' || chr(10)) OR contains(role, '[/INST]')
    THEN len(regexp_extract_all(role, '(\[|<)\\*(INST:|/INST\]|/s>)')) + len(regexp_extract_all(text, '(\[|<)\\*(INST:|/INST\]|/s>)')) ELSE 0 END AS extra
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 7 + length(text) + 5 + extra)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
