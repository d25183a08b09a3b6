"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only.  Each source's target is its weight's share of the
budget, at most ``epochs`` times the source, the excess reshared by weight.
A target is whole passes over the source plus a rest; the rest is taken from
the documents below a hash threshold, so budgets are nested: a larger target
takes all that a smaller one takes.  The threshold is found from sums of tokens
by source and hash bucket; only the bucket where a budget ends is refined, by
sums over its next bits.  Documents are then filtered by comparing hashes;
nothing is sorted by document.

The hash is that of doc_id and text, so a last cell of several rows holds repeated
rows (or, rarely, rows that share 48 bits).  Those rows are staged, and refined
in the same way by the hash of their place: of equal rows as many are taken as
the budget has room for.  The last cell goes whole to the nearer side.

Defined cases: null text is empty and has size 0; a null source is the last
source; repeated rows count row by row; a null doc_id hashes as null; a source
without words has target 0; extra columns are ignored by ``mix`` and carried by
``mixed``, whatever their names; no rows give no rows.  Calling either runs the
jobs that find the thresholds; the filter is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, stage, table, text_or_empty

#: Bits of a histogram level, and levels.
BITS, LEVELS = 12, 4


def targets(sums: DataFrame, weights: list[int], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target) by water filling; windows over one row a source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)).cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    # a source is full if the level at which it fills is not above the level that the others then reach
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / open_weight).withColumn("fills", F.col("cap") / F.col("w"))
    level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * level, "cap")).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1) if level else F.shiftrightunsigned("hash", 64 - BITS)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cell, inner, cut, several): take the rows whose leading hash bits are below ``cut``.

    ``budgets`` has source and rest (tokens to take).  The budget ends in
    ``cell``, ``inner`` tokens behind its begin; ``several`` tells if more than
    one row is there.
    """
    state = stage(budgets.select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("done")), "budgets")
    for level in range(LEVELS):
        # the boundary bucket of each source alone goes on to the next level
        cells = rows.join(bounded(state), F.col("source").eqNullSafe(F.col("of")))
        if level:
            cells = cells.where(F.shiftrightunsigned("hash", 64 - BITS * level) == F.col("prefix"))
        sums = cells.groupBy("of", "prefix", "rest", "done", _bucket(level).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows"))
        upto = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("end", F.col("done") + F.sum("tokens").over(upto)).withColumn("begin", F.col("end") - F.col("tokens"))
        # the bucket where the budget ends: the last that begins at or below it
        ends = sums.where("begin <= rest").groupBy("of").agg(F.max_by(F.struct("prefix", "bucket", "begin", "end", "rest", "rows"), "bucket").alias("x"))
        ends = stage(ends.select("of", F.col("x.rest").alias("rest"), (F.shiftleft("x.prefix", BITS) + F.col("x.bucket")).alias("prefix"), F.col("x.begin").alias("done"), F.col("x.end").alias("end"), F.col("x.rows").alias("rows")), "level")
        state = ends.select("of", "rest", "prefix", "done")
    cut = F.col("prefix") + F.when(F.col("end") - F.col("rest") < F.col("rest") - F.col("done"), 1).otherwise(0)
    return ends.select(F.col("of").alias("source"), F.col("prefix").alias("cell"), (F.col("rest") - F.col("done")).alias("inner"), cut.alias("cut"), (F.col("rows") > 1).alias("several"))


def plan(rows: DataFrame, weights: list[int], share: float, epochs: int) -> DataFrame:
    """(of, source_size, target, passes, cell, inner, cut, several) from staged rows (source, size, hash)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stage(targets(sums, weights, share, epochs), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    cuts = thresholds(rows, aims.where("rest > 0")).withColumnRenamed("source", "in")
    aims = aims.join(cuts, F.col("source").eqNullSafe(F.col("in")), "left")
    return stage(aims.select(F.col("source").alias("of"), "source_size", "target", "passes", "cell", "inner", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), F.coalesce("several", F.lit(False)).alias("several")), "plan")


def _hashed(docs: DataFrame, *carried: str) -> DataFrame:
    """source, size, hash, and what is carried of the caller's rows in one struct."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    row = [F.struct(*carried).alias("row")] if carried else []
    return docs.select(*row, "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit("mix")).alias("hash"))


def _with_copies(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """Adds ``copies``, how often each of ``rows`` (row, source, size, hash) is taken."""
    joined = rows.join(bounded(aims), F.col("source").eqNullSafe(F.col("of")))
    leading = F.shiftrightunsigned("hash", 64 - BITS * LEVELS)
    once = joined.withColumn("copies", F.col("passes") + F.when(leading < F.col("cut"), 1).otherwise(0))
    if aims.where("several").isEmpty():
        return once
    tied = F.col("several") & (leading == F.col("cell"))
    ties = stage(joined.where(tied).withColumn("place", F.xxhash64(F.monotonically_increasing_id(), F.lit("place"))), "ties")
    inside = aims.where("several").select(F.col("of").alias("source"), F.col("inner").alias("rest"))
    cuts = thresholds(ties.select("source", "size", F.col("place").alias("hash")), inside).select(F.col("source").alias("in"), F.col("cut").alias("below"))
    ties = ties.join(bounded(stage(cuts, "cuts")), F.col("source").eqNullSafe(F.col("in")), "left")
    below = F.shiftrightunsigned("place", 64 - BITS * LEVELS) < F.coalesce("below", F.lit(0).cast("long"))
    some = ties.withColumn("copies", F.col("passes") + F.when(below, 1).otherwise(0))
    return once.where(~F.coalesce(tied, F.lit(False))).unionByName(some.select(*once.columns))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of ``docs``."""
    rows = stage(_hashed(docs, "doc_id"), "sizes")
    out = _with_copies(rows, plan(rows, list(weights), share, epochs))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it is taken."""
    aims = plan(stage(_hashed(docs), "sizes"), list(weights), share, epochs)
    out = _with_copies(_hashed(docs, "*"), aims).where("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
