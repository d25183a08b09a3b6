"""Savings events to totals, stages, tenants, gates; and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkthrift.functions import text as T

c = F.col


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many decimal places, halves of the exact binary value to even.

    The product with a power of ten is split into a double and its exact error
    (by halves of the digits), so a value that only seems to lie on a half goes
    to its own side.  For values below 2**52 / 10**places and up to 8 places.
    """
    scale = F.lit(float(10**places))

    def of(v: Column) -> Column:
        a = F.abs(v)
        product = a * scale
        big = a * F.lit(134217729.0)
        high = big - (big - a)
        error = (high * scale - product) + (a - high) * scale
        low = F.floor(product).cast("double")
        side = product - low - 0.5
        up = (side > 0) | ((side == 0) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
        return F.signum(v) * (low + F.when(up, 1.0).otherwise(0.0)) / scale

    return F.when(x == 0, x).otherwise(T.bind(x, of))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def totals(events: DataFrame) -> DataFrame:
    """One row; ``similar`` answers are no hits here, and savings are not clamped."""
    n, hits, near = F.count(F.lit(1)), F.count_if(F.col("cache") == "hit"), F.count_if(F.col("cache") == "similar")
    before, after = F.coalesce(F.sum("tokens_before"), F.lit(0)), F.coalesce(F.sum("tokens_after"), F.lit(0))
    return events.agg(n.alias("requests"), hits.alias("hits"), near.alias("similar_hits"), rounded(_share(hits, n), 4).alias("cache_hit_rate"), before.alias("tokens_before"), after.alias("tokens_after"), (before - after).alias("tokens_saved"), rounded(_share(before - after, before), 4).alias("overall_ratio"))


def by_stage(stages: DataFrame) -> DataFrame:
    """Accuracy counts checked rows only and is null where none was."""
    before, after, checked = F.sum("tokens_before"), F.sum("tokens_after"), F.count("ok")
    accuracy = F.when(checked > 0, F.count_if("ok") / checked)
    return stages.groupBy("stage").agg(before.alias("tokens_before"), after.alias("tokens_after"), (before - after).alias("tokens_saved"), rounded(_share(before - after, before), 4).alias("reduction"), checked.alias("checked"), rounded(accuracy, 4).alias("accuracy"))


def by_tenant(events: DataFrame) -> DataFrame:
    before, after = F.sum("tokens_before"), F.sum("tokens_after")
    rows = events.where(F.coalesce("tenant", F.lit("")) != "")
    return rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("requests"), before.alias("tokens_before"), after.alias("tokens_after"), rounded(_share(before - after, before), 4).alias("reduction"))


def from_sums(sums: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of ``totals``, ``by_stage`` and ``by_tenant`` from sums (part, name, requests, hits, similar, tokens_before, tokens_after, checked, held)."""
    whole = sums.where("part = 'all'").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("requests", "hits", "similar", "tokens_before", "tokens_after")))
    saved = c("tokens_before") - c("tokens_after")
    total = whole.select("requests", "hits", c("similar").alias("similar_hits"), rounded(_share(c("hits"), c("requests")), 4).alias("cache_hit_rate"), "tokens_before", "tokens_after", saved.alias("tokens_saved"), rounded(_share(saved, c("tokens_before")), 4).alias("overall_ratio"))
    stages = sums.where("part = 'stage'").select(c("name").alias("stage"), "tokens_before", "tokens_after", saved.alias("tokens_saved"), rounded(_share(saved, c("tokens_before")), 4).alias("reduction"), "checked", rounded(F.when(c("checked") > 0, c("held") / c("checked")), 4).alias("accuracy"))
    tenants = sums.where("part = 'tenant'").select(c("name").alias("tenant"), "requests", "tokens_before", "tokens_after", rounded(_share(saved, c("tokens_before")), 4).alias("reduction"))
    return total, stages, tenants


def latest_evals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("kind").agg(F.max_by("score", "id").alias("score"), F.max_by("passed", "id").alias("passed"))


def _family(order: int, name: str, kind: str, about: str, value: Column, label: str | None = None, known: Column | None = None) -> Column:
    """array<struct<family, part, label, line>>: the two head lines and the sample of one row; empty where the row has none."""
    named = F.lit("") if label is None else F.coalesce(c(label), F.lit(""))
    tag = F.lit("") if label is None else F.concat(F.lit(f'{{{label}="'), named, F.lit('"}'))
    lines = ((0, F.lit(""), F.lit(f"# HELP {name} {about}")), (1, F.lit(""), F.lit(f"# TYPE {name} {kind}")), (2, named, F.concat(F.lit(name), tag, F.lit(" "), value)))
    made = F.array(*(F.struct(F.lit(order).alias("family"), F.lit(part).alias("part"), own.alias("label"), line.alias("line")) for part, own, line in lines))
    return made if known is None else F.when(known, made).otherwise(F.slice(made, 1, 0))


def event_rows(events: DataFrame) -> DataFrame:
    """Events as they are logged: savings that are not below 0, their ratio to 4 and the duration to 2 places."""
    saved = F.greatest(F.lit(0).cast("long"), c("tokens_before") - c("tokens_after"))
    ratio = F.when(c("tokens_before") > 0, saved / c("tokens_before")).otherwise(0.0)
    timed = {"duration_ms": rounded(c("duration_ms"), 2)} if "duration_ms" in events.columns else {}
    return events.withColumns({"event": F.lit("savings"), "tokens_saved": saved, "ratio": rounded(ratio, 4), **timed})


def evals_recorded(kind: str, score: Column, passed: Column, report: DataFrame, at: Column) -> DataFrame:
    """(id, kind, score, passed): a gate's verdict as a row of the table that ``latest_evals`` reads; ``at`` orders the runs."""
    return report.select(at.alias("id"), F.lit(kind).alias("kind"), score.cast("double").alias("score"), passed.alias("passed"))


def number(x: Column, digits: int = 6) -> Column:
    """Without trailing zeros, but with one decimal at least."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"(\.\d+?)0+$", "$1")


def prometheus(total: DataFrame, stages: DataFrame, evals: DataFrame, prefix: str = "sparkthrift") -> DataFrame:
    """(family, part, label, line): exposition lines; sorted by these columns they are the page."""
    whole = F.concat(
        _family(0, f"{prefix}_requests_total", "counter", "Requests seen.", c("requests").cast("string")),
        _family(1, f"{prefix}_cache_hit_rate", "gauge", "Share of requests answered from the exact cache.", number(c("cache_hit_rate"))),
        _family(2, f"{prefix}_tokens_saved_total", "counter", "Input tokens saved.", c("tokens_saved").cast("string")),
        _family(3, f"{prefix}_overall_reduction_ratio", "gauge", "Share of input tokens saved.", number(c("overall_ratio"))),
    )
    staged = F.concat(
        _family(4, f"{prefix}_stage_reduction_ratio", "gauge", "Share of tokens saved by a stage.", number(c("reduction")), "stage"),
        _family(5, f"{prefix}_stage_tokens_saved_total", "counter", "Tokens saved by a stage.", c("tokens_saved").cast("string"), "stage"),
        _family(6, f"{prefix}_stage_accuracy_ratio", "gauge", "Share of a stage's checked rows that held.", number(c("accuracy")), "stage", c("accuracy").isNotNull()),
    )
    judged = F.concat(
        _family(7, f"{prefix}_eval_score", "gauge", "Latest score of a gate.", number(c("score")), "kind"),
        _family(8, f"{prefix}_eval_passed", "gauge", "Latest verdict of a gate (1: passed).", c("passed").cast("int").cast("string"), "kind"),
    )
    # head lines come once a row and are the same for all rows of a family
    return total.select(F.inline(whole)).unionByName(stages.select(F.inline(staged))).unionByName(evals.select(F.inline(judged))).distinct()


def _percent(x: Column, width: int = 0) -> Column:
    return F.lpad(F.format_string("%.1f%%", x * 100), max(width, 1), " ") if width else F.format_string("%.1f%%", x * 100)


def stats_lines(total: DataFrame, stages: DataFrame, evals: DataFrame, tenants: DataFrame) -> DataFrame:
    """(part, label, line): the report's lines; sorted by these columns they are the report."""
    t = total.select(F.lit(0).alias("part"), F.lit("").alias("label"), F.concat(F.lit("requests="), c("requests"), F.lit("  cache_hit_rate="), _percent(c("cache_hit_rate")), F.lit("  tokens "), c("tokens_before"), F.lit("->"), c("tokens_after"), F.lit(" (saved "), c("tokens_saved"), F.lit(", "), _percent(c("overall_ratio")), F.lit(")")).alias("line"))
    accuracy = F.when(c("accuracy").isNull(), F.lpad(F.lit("n/a"), 9, " ")).otherwise(_percent(c("accuracy"), 9))
    s = stages.select(F.lit(1).alias("part"), c("stage").alias("label"), F.concat(F.rpad("stage", 14, " "), F.lit(" "), F.format_string("%8d %8d", c("tokens_before"), c("tokens_after")), F.lit(" "), _percent(c("reduction"), 10), F.lit(" "), accuracy).alias("line"))
    e = evals.select(F.lit(2).alias("part"), c("kind").alias("label"), F.concat(F.lit("  "), F.rpad("kind", 20, " "), F.lit(" score="), _percent(c("score")), F.lit("  "), F.when(c("passed"), "PASS").otherwise("FAIL")).alias("line"))
    n = tenants.select(F.lit(3).alias("part"), c("tenant").alias("label"), F.concat(F.lit(" " * 25), F.rpad("tenant", 18, " "), F.lit(" "), F.format_string("%6d", c("requests")), F.lit(" "), _percent(c("reduction"), 10)).alias("line"))
    return t.unionByName(s).unionByName(e).unionByName(n)

