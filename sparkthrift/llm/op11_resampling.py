"""Importance resampling towards a target distribution, by a dictionary of distinct features.

1. Tasks count the features (runs of 1 to ``longest`` words) of each document, and
   write blocks of documents: the block's distinct strings with their sums, and for
   each document the strings' numbers in the block with their counts.
2. The dictionary: sums of each string over all blocks.  A word that every document
   holds costs one row a block.
3. Each distinct string is hashed once, to its bucket.  Bucket sums of the corpus
   and of the target texts give every bucket's gain, the scaled logarithm of how
   much likelier the target is to hold its features.
4. Gains join the dictionary, and the dictionary the blocks' strings; each block gets
   back one array of gains, from which its documents' weights are summed.
5. Weights with Gumbel noise that is fixed by the id are scores; the highest are
   drawn.  Ranks come from a sort by range: places in the ranges and the ranges' offsets.

No side is broadcast but the gains, which are at most ``buckets`` rows, and the
offsets, one a range.  A block holds ``PAIRS`` counts, or one document that alone has more.

Defined cases: null text has no features and weight 0; a null doc_id counts as '' in
the noise and comes last in ties; target texts that are null or empty hold nothing
(then gains come from the smoothing alone); repeated rows are rows of their own;
extra columns are ignored by ``scored`` and carried by ``resampled``, whatever their
names; no rows give no rows.  Calling ``scored`` runs the counts and the sort; the
result only reads what is staged.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, table

#: Bytes to what a word is made of: A-Z in lower case, all that separates as a blank.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Counts of a block.
PAIRS = 1 << 18


def features(text: bytes, longest: int) -> tuple[int, Counter]:
    """Words of a whole text, and how often it holds each run of 1 to ``longest`` of them."""
    words = text.translate(_BYTES).split()
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return len(words), found


def pack(values: list[int]) -> bytes:
    """Whole numbers as compressed planes of bytes: the upper planes are nearly empty."""
    planes = np.array(values, "<u4").view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True) if n else b"", np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(longest: int, kind: pa.DataType, pairs: int):
    """Arrow batches (row, text) to blocks of documents, a row a block."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        rows, words, totals, sizes, ids, counts, index, sums = [], [], [], [], [], [], {}, []

        def made() -> pa.RecordBatch:
            flat = [
                pa.array([block], pa.int64()),
                *(pa.array([x], pa.list_(t)) for x, t in ((rows, kind), (words, pa.int64()), (totals, pa.int64()))),
                *(pa.array([pack(x)], pa.binary()) for x in (sizes, ids, counts)),
                pa.array([list(index)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                pa.array([sums], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(flat, ["block", "rows", "n_words", "n_features", "sizes", "ids", "counts", "features", "sums"])

        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                n, found = features(text.as_py() or b"", longest)
                if rows and len(ids) + len(found) > pairs:
                    yield made()
                    block += 1
                    rows, words, totals, sizes, ids, counts, index, sums = [], [], [], [], [], [], {}, []
                for feature, count in found.items():
                    at = index.setdefault(feature, len(sums))
                    if at == len(sums):
                        sums.append(count)
                    else:
                        sums[at] += count
                    ids.append(at)
                rows.append(row.as_py())
                words.append(n)
                totals.append(found.total())
                sizes.append(len(found))
                counts.extend(found.values())
        if rows:
            yield made()

    return run


def blocks(texts: DataFrame, longest: int, pairs: int) -> DataFrame:
    """Staged blocks of ``texts`` (row, text)."""
    field = texts.schema["row"].dataType
    kinds = f"block long, rows array<{field.simpleString()}>, n_words array<long>, n_features array<long>, sizes binary, ids binary, counts binary, features array<string>, sums array<long>"
    return stage(texts.select("row", F.col("text").cast("binary")).mapInArrow(_blocks(longest, to_arrow_type(field), pairs), kinds), "blocks")


def strings(counted: DataFrame) -> DataFrame:
    """(block, place, feature, count): the distinct strings of each block."""
    each = counted.select("block", F.posexplode(F.arrays_zip("features", "sums")).alias("place", "x"))
    return each.select("block", "place", F.col("x.features").alias("feature"), F.col("x.sums").alias("count"))


def dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """(feature, count, bucket), staged: each distinct string once, hashed once."""
    sums = strings(counted).groupBy("feature").agg(F.sum("count").alias("count"))
    return stage(sums.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets), "dictionary")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket of either dictionary; at most ``buckets`` rows."""
    none = F.lit(0).cast("long")
    sums = source.select("bucket", F.col("count").alias("s"), none.alias("t")).unionByName(target.select("bucket", none.alias("s"), F.col("count").alias("t")))
    each = stage(sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    totals = each.agg(F.coalesce(F.sum("s"), none).alias("s"), F.coalesce(F.sum("t"), none).alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(float(totals["s"] + buckets))) / ((s + 1) * F.lit(float(totals["t"] + buckets)))
    return each.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _weights(batches):
    for batch in batches:
        for i in range(len(batch)):
            rows, words, totals, gain = (batch.column(c)[i].values for c in (0, 1, 2, 6))
            each, ids, counts = (unpack(batch.column(c)[i].as_py()) for c in (3, 4, 5))
            weight = np.zeros(len(each), np.int64)
            if gain is not None and len(ids):
                worth = counts * gain.to_numpy()[ids]
                filled = each > 0
                weight[filled] = np.add.reduceat(worth, (np.cumsum(each) - each)[filled])
            yield pa.RecordBatch.from_arrays([rows, words, totals, pa.array(weight)], ["row", "n_words", "n_features", "weight"])


def weighted(texts: DataFrame, targets: DataFrame, longest: int, buckets: int, pairs: int = PAIRS) -> DataFrame:
    """(row, n_words, n_features, weight) for every row of ``texts`` (row, text)."""
    counted, wanted = blocks(texts, longest, pairs), blocks(targets.select(F.lit(0).alias("row"), "text"), longest, pairs)
    known = dictionary(counted, buckets)
    worth = known.join(F.broadcast(stage(gains(known, dictionary(wanted, buckets), buckets), "gains")), "bucket").select("feature", "gain")
    told = strings(counted).join(worth, "feature").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "gain"))).alias("x"))
    back = counted.drop("features", "sums").join(told.select("block", F.col("x.gain").alias("gain")), "block", "left")
    kind = texts.schema["row"].dataType.simpleString()
    return back.select("rows", "n_words", "n_features", "sizes", "ids", "counts", "gain").mapInArrow(_weights, f"row {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` to staged ``rows`` (row, doc_id, n_words, n_features, weight, score): 1, 2, 3, ... for the drawn, else null."""
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    spread = rows.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(spread.withColumn("_range", F.shiftright("_place", 33)).withColumn("_at", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place"), "sorted")
    # one row a range, of which there are as many as shuffle partitions
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    total, before = 0, []
    for at, n in sizes:
        before.append((at, total))
        total += n
    bases = F.broadcast(rows.sparkSession.createDataFrame(before, "_range long, _base long"))
    rank = F.col("_base") + F.col("_at") + 1
    told = placed.join(bases, "_range").withColumn("rank", F.when(rank <= total * percent // 100, rank)).drop("_range", "_at", "_base")
    return told.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def _scored(texts: DataFrame, targets: DataFrame, longest: int, buckets: int, seed: int, percent: int, least_words: int, pairs: int) -> DataFrame:
    """``texts`` has row (a struct with doc_id) and text."""
    rows = weighted(texts, targets, longest, buckets, pairs).withColumn("doc_id", F.col("row.doc_id"))
    return ranked(stage(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores"), percent, least_words)


def scored(docs: DataFrame, targets: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text); ``targets`` has text."""
    out = _scored(docs.select(F.struct("doc_id").alias("row"), "text"), targets, longest, buckets, seed, percent, least_words, pairs)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, targets: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, pairs: int = PAIRS) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; their texts are staged once, as each has to be found again."""
    placed = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("place")), "documents")
    texts = placed.select(F.struct(F.col("doc.doc_id").alias("doc_id"), "place").alias("row"), F.col("doc.text").alias("text"))
    drawn = _scored(texts, targets, longest, buckets, seed, percent, least_words, pairs).where("rank is not null")
    return placed.join(drawn.select(F.col("row.place").alias("place")), "place", "left_semi").select("doc.*")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 by its table of 256 rests, over the bytes of each distinct word
OP11_SQL = r"""
WITH RECURSIVE k(n, i, c) AS (SELECT n, 0, n::BIGINT FROM range(256) t(n) UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM k WHERE i < 8),
rests AS MATERIALIZED (SELECT list(c ORDER BY n) AS r FROM k WHERE i = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
words AS MATERIALIZED (
  SELECT true AS corpus, id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM docs
  UNION ALL
  SELECT false, 0, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counts AS (SELECT word, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM words GROUP BY 1),
bytes AS (SELECT word, s, t, hex(encode(word)) AS h FROM counts),
hashed AS MATERIALIZED (
  SELECT word, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda j: ('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, rests),
sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY 1),
total AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(((sums.t::DOUBLE + 1) * (total.s + 10000)) / ((sums.s::DOUBLE + 1) * (total.t + 10000))))::BIGINT AS gain FROM sums, total),
weights AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE corpus GROUP BY 1),
scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""
