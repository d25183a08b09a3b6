"""Quality rules: words and repetition of a text, then the frequency of its lines across a host's documents.

DataFrame functions only.  Rules about the text alone come first: how many words,
symbols, repeated lines, and words inside five-word windows that occur more than
once.  Then lines are normalised (lower case, runs of digits as one 0, runs of blanks
as one, none at the ends) and hashed.  The distinct documents of a host
that hold a line are counted; equal texts of a host are one document.  A line found
in more than ``max(least_documents, share * the host's documents)`` of them is
boilerplate and removed; a document that keeps less than ``keep`` of its words, or
fewer than ``least_words``, is depleted and rejected.  The limit is a share, so it
means the same at every size; the floor keeps small hosts' chance repetitions.

Lines are counted by (host, line hash), one row for each text that holds it, so
partial sums combine before the shuffle and a line that all documents of a hot host
hold costs a row a task.  Only lines above the limit are joined back: there are
fewer than 1 / share times a host's lines per document of them, and ``bounded``
counts them before it broadcasts.

Repeated windows are found inside a row in n log n steps: hashes of the windows
are sorted with their places, neighbours compared, and the gaps between the
places summed.  Hashes have 64 bits; that two different windows of a text, or two
lines of a host, share one is left out of account.

Defined cases: null text has no words and fails the base rules; words are maximal
runs outside blanks (U+0020, U+0009 to U+000D); a null host is a host; a document
without lines keeps nothing; repeated rows are judged row by row; the empty line is
no line; extra columns are ignored by ``judge`` and carried by ``cleaned``; no rows
give no rows.  Calling either stages the numbers of each row; the join is left to
the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded, stage, table, text_or_empty

#: Words of a window.
WINDOW = 5
SYMBOL = r"[#*$%&|<>]"
_BLANKS = r"[\x20\x09-\x0D]+"
_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(line), _BLANKS, " ")), "[0-9]+", "0")


def _windows(words: Column) -> Column:
    """Hashes of all windows of five words, in order."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(F.size(words) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside the windows whose hash occurs more than once, from all windows' hashes in order."""

    def within(placed: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            return F.coalesce(x["h"] == F.get(placed, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(placed, i + 1)["h"], F.lit(False))

        again = F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(again, start, lambda s, at: F.struct(at.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), at - s["last"])).alias("sum")), lambda s: s["sum"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    # most texts repeat no window: their hashes are only counted
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_bind(placed, within))


def measured(docs: DataFrame, host: str, *carried: str) -> DataFrame:
    """For each row: what is carried, host, text, its numbers, and its lines that have a word."""
    rows = docs.select(*carried, F.col(host).alias("host"), text_or_empty().alias("text"))

    def of(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), _bind(_windows(words), _covered).alias("n_repeat_words"))

    # bound: read inside a lambda, the words would else be sought again for each of them
    rows = rows.withColumns({"x": _bind(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), of), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))})
    own = {"n_symbols": F.regexp_count("text", F.lit(SYMBOL)), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines"))}
    return rows.select(*carried, "host", "text", "lines", *((own[k] if k in own else F.col(f"x.{k}")).cast("long").alias(k) for k in _NUMBERS))


def _hashed(rows: DataFrame, *carried: str) -> DataFrame:
    """Staged: numbers, the text's hash, and the lines as hashes with their words."""
    lines = F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    return stage(rows.select(*carried, "host", *_NUMBERS, F.xxhash64("text", F.lit("text")).alias("same"), lines.alias("lines"), F.monotonically_increasing_id().alias("row")), "lines")


def frequent_lines(rows: DataFrame, *, least_documents: int, share: float) -> DataFrame:
    """(of, line, documents), staged: lines in more distinct documents of a host than its limit, from rows (host, same, lines)."""
    texts = rows.groupBy("host", "same").agg(F.first(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("lines"))
    texts = stage(texts.select("host", "lines"), "texts")
    limits = texts.groupBy(F.col("host").alias("of")).agg(F.greatest(F.lit(float(least_documents)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    held = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > least_documents)
    over = held.join(bounded(stage(limits, "limits")), F.col("host").eqNullSafe(F.col("of"))).where(F.col("documents") > F.col("limit"))
    return stage(over.select("of", "line", "documents"), "frequent")


def _base(least_words: int, most_repeated: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _enough(left: Column, least_words: int, keep: float) -> Column:
    return (left >= least_words) & (left >= F.col("n_words") * keep)


def judge(docs: DataFrame, *, host: str = "source", least_words: int = 10, most_repeated: int = 20, least_documents: int = 10, share: float = 0.01, keep: float = 0.3) -> DataFrame:
    """A row for every row of ``docs`` (doc_id, text, host): doc_id, its numbers, base_failed, kept, words_left."""
    rows = _hashed(measured(docs, host, "doc_id"), "doc_id")
    frequent = bounded(frequent_lines(rows, least_documents=least_documents, share=share))
    lines = rows.select("row", "host", F.explode("lines").alias("x"))
    gone = lines.join(frequent.select("of", F.col("line").alias("common")), F.col("host").eqNullSafe(F.col("of")) & (F.col("x.line") == F.col("common")), "left_semi")
    gone = gone.groupBy("row").agg(F.sum("x.words").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0).cast("long"))
    base = _base(least_words, most_repeated)
    return rows.join(gone, "row", "left").select("doc_id", *_NUMBERS, base.alias("base_failed"), (~base & _enough(left, least_words, keep)).alias("kept"), left.alias("words_left"))


def cleaned(docs: DataFrame, *, host: str = "source", least_words: int = 10, most_repeated: int = 20, least_documents: int = 10, share: float = 0.01, keep: float = 0.3) -> DataFrame:
    """The kept rows of ``docs``, with all their columns, their text without its host's boilerplate lines.

    A host's boilerplate is one array a host: at most its lines per document over ``share``.
    """
    rows = measured(docs.select(F.struct("*").alias("doc"), F.col(host).alias("of_host"), "text"), "of_host", "doc")
    frequent = frequent_lines(_hashed(rows), least_documents=least_documents, share=share)
    common = bounded(stage(frequent.groupBy("of").agg(F.collect_list("line").alias("common")), "common"))
    joined = rows.drop("lines").join(common, F.col("host").eqNullSafe(F.col("of")), "left")
    known = F.coalesce("common", F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(WORD) | ~F.array_contains(known, F.xxhash64(normalised(x))))
    rest = joined.where(~_base(least_words, most_repeated)).select("doc", "n_words", F.array_join(lines, "\n").alias("rest"))
    stays = rest.where(_enough(F.regexp_count("rest", F.lit(WORD)), least_words, keep))
    return stays.select(*(F.col("rest").alias(n) if n == "text" else F.col("doc").getField(n).alias(n) for n in docs.columns))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
t AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT id, count(DISTINCT place) AS n_repeat_words FROM (SELECT id, unnest(range(i, i + 5)) AS place FROM t) GROUP BY 1),
l AS MATERIALIZED (
  SELECT id, source, text, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT id, source, text, unnest(lines) AS line FROM w)),
h AS (SELECT source, greatest(10, count(DISTINCT text) * 0.01::DOUBLE) AS most FROM w GROUP BY 1),
f AS (SELECT source, line, count(DISTINCT text) AS docs FROM l GROUP BY 1, 2),
b AS (SELECT l.id, sum(n) AS gone FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line JOIN h ON l.source IS NOT DISTINCT FROM h.source WHERE docs > most GROUP BY 1),
n AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) - coalesce(gone, 0)::BIGINT AS words_left
  FROM w LEFT JOIN r USING (id) LEFT JOIN b USING (id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT base_failed AND words_left >= 10 AND words_left >= n_words * 0.3::DOUBLE AS kept FROM n
"""
