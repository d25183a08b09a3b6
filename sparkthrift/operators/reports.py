"""Reports of the gates as lines (part, name, line): sorted by part and name they are the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation, metrics

c = F.col

# The layouts of the four pages. Heads, widths of the rules, and the formats of case and total lines.
SAMPLES_HEAD = f"{'sample':<28} {'canon':>5} {'before':>7} {'after':>7} {'saved%':>7} {'ok':>3}"
SAMPLES_LINE = "%-28s %5s %7d %7d %6.1f%% %3s"
SAMPLES_TOTAL = "TOTAL  samples=%d canonicalised=%d  tokens %d->%d (saved %d, %.1f%%)  regressions=%d  %s"
JUDGED_HEAD = f"{'case':<28} {'recall':>7} {'ok':>5}"
JUDGED_LINE = "%-28s %5.0f%% %5s"
RETRIEVAL_LINE = "%-28s %6.1f%% %5s"
RETRIEVAL_TOTAL = "TOTAL cases=%d passed=%d mean_recall=%.1f%%  %s"
SIMILARITY_HEAD = f"{'case':<28} {'sim':>6} {'pred':>5} {'want':>5} {'ok':>4}"
SIMILARITY_LINE = "%-28s %6.3f %5s %5s %4s"
SIMILARITY_TOTAL = "threshold=%.3f  precision=%.1f%%  recall=%.1f%%  false_hits=%d  %s"
SAMPLES_RULE, JUDGED_RULE, SIMILARITY_RULE = 60, 44, 52


def _page(head: str, width: int, rows: DataFrame, line: Column, total: DataFrame, last: Column) -> DataFrame:
    """Head, rule, a line a case, rule, total."""
    rule = "-" * width
    fixed = F.inline(F.array(*(F.struct(F.lit(part).alias("part"), F.lit("").alias("name"), text.alias("line")) for part, text in ((0, F.lit(head)), (1, F.lit(rule)), (3, F.lit(rule)), (4, last)))))
    return total.select(fixed).unionByName(rows.select(F.lit(2).alias("part"), "name", line.alias("line")))


def _mark(ok: Column, yes: str = "ok", no: str = "FAIL") -> Column:
    return F.when(ok, yes).otherwise(no)


def _tenths(share: Column) -> Column:
    """Per cent to one place, halves of the exact binary value to even; ``format_string`` alone takes halves of the shown digits up."""
    return metrics.rounded(share * 100, 1)


def samples(results: DataFrame) -> DataFrame:
    """Of (name, canonicalized, tokens_before, tokens_after, passed)."""
    ratio = F.when(c("tokens_before") > 0, (c("tokens_before") - c("tokens_after")) / c("tokens_before")).otherwise(0.0)
    line = F.format_string(SAMPLES_LINE, F.substring("name", 1, 28), _mark(c("canonicalized"), "yes", "no"), c("tokens_before"), c("tokens_after"), _tenths(ratio), _mark(c("passed")))
    last = F.format_string(SAMPLES_TOTAL, c("samples"), c("canonicalized"), c("tokens_before"), c("tokens_after"), c("tokens_saved"), _tenths(c("overall_ratio")), c("regressions"), _mark(c("passed"), "PASS"))
    return _page(SAMPLES_HEAD, SAMPLES_RULE, results, line, evaluation.totals(results), last)


def judged(cases: DataFrame) -> DataFrame:
    """Of (name, score, passed): how much of what must stay was kept."""
    line = F.format_string(JUDGED_LINE, c("name"), c("score") * 100, _mark(c("passed")))
    last = F.format_string(JUDGED_LINE, F.lit("mean"), c("mean_score") * 100, _mark(c("passed"), "PASS"))
    return _page(JUDGED_HEAD, JUDGED_RULE, cases, line, evaluation.report(cases), last)


def retrieval(cases: DataFrame) -> DataFrame:
    """Of (name, score, passed)."""
    line = F.format_string(RETRIEVAL_LINE, F.substring("name", 1, 28), c("score") * 100, _mark(c("passed")))
    last = F.format_string(RETRIEVAL_TOTAL, c("cases"), c("num_passed"), c("mean_score") * 100, _mark(c("passed"), "PASS"))
    return _page(JUDGED_HEAD, JUDGED_RULE, cases, line, evaluation.report(cases), last)


def similarity(cases: DataFrame, threshold: float) -> DataFrame:
    """Of (name, anchor, variant, should_hit)."""
    rows = cases.withColumn("close", evaluation.V.cosine(c("anchor"), c("variant")))
    hit = c("close") >= threshold
    line = F.format_string(SIMILARITY_LINE, F.substring("name", 1, 28), c("close"), _mark(hit, "hit", "miss"), _mark(c("should_hit"), "hit", "miss"), _mark(hit == c("should_hit"), "ok", "XX"))
    last = F.format_string(SIMILARITY_TOTAL, F.lit(float(threshold)), c("precision") * 100, c("recall") * 100, c("false_hits"), _mark(c("passed"), "PASS"))
    return _page(SIMILARITY_HEAD, SIMILARITY_RULE, rows, line, evaluation.similarity_report(cases, threshold), last)
