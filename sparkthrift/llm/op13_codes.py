"""Vector code compression: product codes, nearest entries found by annular norm pruning.

Vectors become integers and are cut into equal parts; each part is replaced by
the index of its codebook's nearest entry.  To find it, a codebook's entries are
sorted by norm.  By the triangle inequality an entry nearer than the best one known
has a norm within that distance of the part's own norm, so a binary search in the
sorted norms gives the interval still allowed, and only the entries in it are
evaluated: exactly, in integers, ends included (an entry at the very same distance
may win by its lower index).  Evaluation goes outward in rings that double, so the
interval shrinks with the best distance.

A round is one pass over the staged integers: tasks hold the codebooks (bounded
by ``parts`` times ``entries`` and the vectors' width) and send sums and counts of
each entry, which are combined before the shuffle.  Rows never leave their
partition before the last aggregate by label.

Defined cases: vectors that are null, empty, or hold null or non-finite components
are dropped; of mixed widths the commonest takes part (the smaller of equally
common ones), all others are dropped; a width that ``parts`` doesn't divide is
filled up with zeros, which change no distance; rows are ordered by vec_id (null
last), then by components, so a repeated row counts as often as it occurs; fewer
rows than ``entries`` make a smaller codebook; integers are held within the bound
at which a distance still fits a long (for 64 components +-2**27, that is
components of +-32,768), and sums over labels at the largest long; null labels
are one label; extra columns are ignored; no rows give no rows.  Calling
``compress`` runs the rounds; the last join is left to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are compared at once: bounds a task's memory.
CHUNK = 2048
_LONG = (1 << 63) - 1


@dataclass
class Codebook:
    """Entries of one part position, and their order by norm."""

    entries: np.ndarray

    def __post_init__(self):
        norms = np.sqrt((self.entries * self.entries).sum(1).astype(float))
        self.order = np.argsort(norms, kind="stable")
        self.sorted, self.norms = self.entries[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row (ties to the lower index), and how many were evaluated."""
        n, k = len(x), len(self.entries)
        own = np.sqrt((x * x).sum(1).astype(float))
        low = np.clip(np.searchsorted(self.norms, own), 0, k - 1)
        low -= (low > 0) & (own - self.norms[low - 1] < self.norms[low] - own)
        high = low + 1
        gap = x - self.sorted[low]
        best, who, met = (gap * gap).sum(1), self.order[low], n
        while True:
            reach = np.sqrt(best.astype(float))
            reach += 1e-9 * (own + reach) + 1e-6  # roots are rounded: too wide costs an evaluation, never an entry
            first, last = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
            ring = high - low
            down, up = np.maximum(first, low - ring), np.minimum(last, high + ring)
            fewer, more = np.maximum(low - down, 0), np.maximum(up - high, 0)
            count = fewer + more
            rows = np.flatnonzero(count)
            if not len(rows):
                return who, best, met
            count = count[rows]
            start = np.cumsum(count) - count
            row = np.repeat(rows, count)
            step = np.arange(len(row)) - np.repeat(start, count)
            # below the evaluated span first, then above it
            at = np.where(step < fewer[row], low[row] - 1 - step, high[row] + step - fewer[row])
            gap = x[row] - self.sorted[at]
            far, index = (gap * gap).sum(1), self.order[at]
            least = np.minimum.reduceat(far, start)
            lowest = np.minimum.reduceat(np.where(far == np.repeat(least, count), index, k), start)
            better = (least < best[rows]) | ((least == best[rows]) & (lowest < who[rows]))
            best[rows] = np.where(better, least, best[rows])
            who[rows] = np.where(better, lowest, who[rows])
            low, high, met = low - fewer, high + more, met + len(row)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of indexes and of squared distances."""
    cut = x.shape[1] // len(books)
    found = [book.nearest(x[:, p * cut : (p + 1) * cut]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: list[Codebook], width: int):
    """Per task: (part, entry, place, sum of that component), and counts at place -1."""
    parts, k, cut = len(books), len(books[0].entries), width // len(books)

    def run(batches):
        sums, counts = np.zeros((parts, k, cut), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for lo in range(0, len(x), CHUNK):
                rows = x[lo : lo + CHUNK]
                who, _ = assign(rows, books)
                for p in range(parts):
                    np.add.at(sums[p], who[:, p], rows[:, p * cut : (p + 1) * cut])
                    counts[p] += np.bincount(who[:, p], minlength=k)
        told = np.concatenate((counts[:, :, None], sums), 2)
        part, entry, place = np.unravel_index(np.arange(told.size), told.shape)
        used = np.repeat(counts.ravel() > 0, cut + 1)
        made = [part[used].astype(np.int32), entry[used].astype(np.int32), (place[used] - 1).astype(np.int32), told.ravel()[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["part", "entry", "place", "value"])

    return run


def whole_numbers(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Staged rows (vec_id, label, x: array of integers, as doubles) of the vectors that take part, and the width of x."""
    each = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where((F.size("embedding") > 0) & sound).select("vec_id", "label", "embedding")
    widths = kept.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    common = widths.orderBy(F.desc("rows"), "width").first()
    if common is None:
        return kept.select("vec_id", "label", F.lit(None).cast("array<double>").alias("x")), 0
    filled = -(-common["width"] // parts) * parts
    bound = float(1 << ((62 - filled.bit_length()) // 2 - 1))
    # floor() gives a long, which stops at 2**63; the bound is far below
    held = F.transform(F.transform("embedding", lambda v: F.greatest(F.least(v.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))), lambda v: F.floor(v).cast("double"))
    x = F.concat(held, F.array_repeat(F.lit(0.0), filled - common["width"])) if filled > common["width"] else held
    return stage(kept.where(F.size("embedding") == common["width"]).select("vec_id", "label", x.alias("x")), "integers"), filled


def learn(rows: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """Codebooks from staged ``rows``: they start as the parts of the first rows and move to the means of what is assigned to them."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], float).astype(np.int64).reshape(len(first), parts, -1)
    books = [Codebook(start[:, p]) for p in range(parts)]
    for _ in range(rounds):
        told = rows.select("x").mapInArrow(_sums(books, width), "part int, entry int, place int, value long")
        sums = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in told.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
        moved = []
        for p, book in enumerate(books):
            made = book.entries.copy()
            for (part, entry, place), value in sums.items():
                if part == p and place >= 0:
                    made[entry, place] = value // sums[part, entry, -1]
            moved.append(Codebook(made))
        books = moved
    return books


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code: array of indexes, error, label_error, codebooks: array of part, entry, component) for every vector that takes part."""
    rows, width = whole_numbers(vectors, parts)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    if not width:
        empty = f"vec_id {kind}, label {label}, code array<int>, error long, label_error long, codebooks array<long>"
        return vectors.sparkSession.createDataFrame([], empty)
    books = learn(rows, width, parts=parts, entries=entries, rounds=rounds)

    def code(batches):
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.slice(lo, CHUNK)
                who, far = assign(_matrix(part.column(2), width), books)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * parts), pa.array(who.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    coded = stage(rows.mapInArrow(code, f"vec_id {kind}, label {label}, code array<int>, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = bounded(stage(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels"))
    whole = F.split(F.lit(",".join(str(v) for book in books for v in book.entries.ravel().tolist())), ",").cast("array<long>")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", whole.alias("codebooks"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.array_join(F.col("codebooks").cast("array<string>"), ","), 256).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by plain search over all entries: a CTE a round."""
    size = f"(SELECT min(len(x)) // {PARTS} FROM v)"
    near = (
        "SELECT p.id, p.part, arg_min(b.entry, {{far}} * " + str(ENTRIES) + "::HUGEINT + b.entry) AS entry, min({{far}}) AS far FROM p JOIN {books} b USING (part) GROUP BY 1, 2"
    ).replace("{{far}}", "list_sum(list_transform(range(1, len(p.y) + 1), lambda i: (p.y[i] - b.y[i]) * (p.y[i] - b.y[i])))::HUGEINT")
    steps = [
        "WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"p AS MATERIALIZED (SELECT id, part, list_slice(x, part * w + 1, part * w + w) AS y FROM v, (SELECT {size} AS w), range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, y FROM p WHERE id <= {ENTRIES})",
    ]
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(books=f'b{r}')})")
        steps.append(
            f"m{r} AS (SELECT part, entry, i, floor(sum(y[i]) / count(*)::DOUBLE)::BIGINT AS c FROM (SELECT part, entry, y, unnest(range(1, len(y) + 1)) AS i FROM p JOIN a{r} USING (id, part)) GROUP BY 1, 2, 3), "
            f"l{r} AS (SELECT part, entry, list(c ORDER BY i) AS y FROM m{r} GROUP BY 1, 2), "
            f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(l.y, b.y) AS y FROM b{r} b LEFT JOIN l{r} l USING (part, entry))"
        )
    steps.append(f"z AS MATERIALIZED ({near.format(books=f'b{ROUNDS}')})")
    steps.append("c AS (SELECT id, string_agg('0' || lower(to_hex(entry)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM z GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (id), h"


OP13_SQL = _sql()
