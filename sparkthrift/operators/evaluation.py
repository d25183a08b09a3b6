"""Offline gates: recall judges, retrieval, similarity, tier scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkthrift.functions import terms as V


def recall(candidate: Column, must_include: Column) -> Column:
    """Share of the phrases that the candidate holds, whatever their case; 1 without phrases."""
    found = F.size(F.filter(must_include, lambda p: F.contains(F.lower(candidate), F.lower(p))))
    return F.when(F.size(must_include) == 0, 1.0).otherwise(found / F.size(must_include))


def all_dropped(candidate: Column, must_drop: Column) -> Column:
    return F.size(F.filter(must_drop, lambda p: F.contains(candidate, p))) == 0


def says_yes(reply: Column) -> Column:
    """The verdict of a model's reply, which comes as a column."""
    return F.lower(F.ltrim(reply)).startswith("yes")


def report(cases: DataFrame) -> DataFrame:
    """Mean score (0 without cases), cases passed, verdict of the gate (true without cases)."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean_score"), F.count_if("passed").alias("num_passed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def similarity_report(cases: DataFrame, threshold: float) -> DataFrame:
    """Of (anchor, variant vectors, should_hit): precision, recall, false hits; passes without false hits."""
    hit = V.cosine(F.col("anchor"), F.col("variant")) >= threshold
    rows = cases.select(hit.alias("hit"), "should_hit")
    both, hits, wanted = F.count_if(F.col("hit") & F.col("should_hit")), F.count_if("hit"), F.count_if("should_hit")
    wrong = F.count_if(F.col("hit") & ~F.col("should_hit"))
    return rows.agg(F.when(hits == 0, 1.0).otherwise(both / hits).alias("precision"), F.when(wanted == 0, 1.0).otherwise(both / wanted).alias("recall"), wrong.alias("false_hits"), (wrong == 0).alias("passed"))


def tier_scores(cases: DataFrame) -> DataFrame:
    """Per tier of (tier, tokens_before, tokens_after, kept): kept count and mean of each case's reduction."""
    return cases.groupBy("tier").agg(F.count(F.lit(1)).alias("cases"), F.count_if("kept").alias("kept"), F.round(F.avg(1 - F.col("tokens_after") / F.col("tokens_before")), 6).alias("mean_reduction"))


def ladder(cases: DataFrame) -> DataFrame:
    """(bucket, tier, level, cases, mean_reduction, gain) from (bucket, tier, level, tokens_before, tokens_after).

    Means are of the cases' own ratios (0 for an empty case), not a ratio of
    sums; ``gain`` is the difference to the level before in the same bucket.
    """
    ratio = F.when(F.col("tokens_before") > 0, 1 - F.col("tokens_after") / F.col("tokens_before")).otherwise(0.0)
    means = cases.groupBy("bucket", "tier", "level").agg(F.count(F.lit(1)).alias("cases"), F.avg(ratio).alias("mean_reduction"))
    before = F.lag("mean_reduction").over(Window.partitionBy("bucket").orderBy("level"))  # a row a level: small
    return means.withColumn("gain", F.col("mean_reduction") - F.coalesce(before, F.lit(0.0)))


def best_ratio(sweep: DataFrame) -> DataFrame:
    """The lowest ratio that passes, else the one of the highest mean."""
    best = F.coalesce(F.min(F.when(F.col("passed"), F.col("ratio"))), F.max_by("ratio", "mean_score"))
    return sweep.agg(best.alias("best_ratio"))


def totals(results: DataFrame) -> DataFrame:
    """One row over (tokens_before, tokens_after, canonicalized, passed): sums, regressions, verdict of the gate."""
    before, after, wrong = (F.coalesce(x, F.lit(0).cast("long")) for x in (F.sum("tokens_before"), F.sum("tokens_after"), F.count_if(~F.col("passed"))))
    ratio = F.when(before > 0, (before - after) / before).otherwise(0.0)
    return results.agg(F.count(F.lit(1)).alias("samples"), F.count_if("canonicalized").alias("canonicalized"), before.alias("tokens_before"), after.alias("tokens_after"), (before - after).alias("tokens_saved"), ratio.alias("overall_ratio"), wrong.alias("regressions"), (wrong == 0).alias("passed"))


def samples(rows: DataFrame, compressed: Column, tokens: Column, after: Column, equal: Column) -> DataFrame:
    """Token counts and verdict per sample; a sample that could not be parsed passes with zeros."""
    known = compressed.isNotNull()
    return rows.select("name", known.alias("canonicalized"), F.when(known, tokens).otherwise(0).alias("tokens_before"), F.when(known, after).otherwise(0).alias("tokens_after"), F.when(known, equal).otherwise(True).alias("passed"))
