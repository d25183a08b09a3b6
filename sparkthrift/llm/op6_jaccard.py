"""N-gram Jaccard self-join by vertical partitioning.

1. Rows with equal texts form a class (128-bit hash); one row stands for it.
2. Each block of texts is shingled (numpy), and its shingles are cut by the
   global n-gram order into fragments; a fragment gets one packed message a
   block.  Fragment tasks count each shingle's documents; what occurs in one
   document cannot overlap with anything and ends there.
3. A document whose shared shingles could not reach the threshold ends too.
   Shingles that the very same documents hold (those of a paragraph that many
   share) are one unit, as a pair has all of them in common or none.  Two linked
   documents agree on the first units that they share, in the global order
   (rarest first), and those come before either could have missed too much; so
   each document names all units that may be its first shared one.  A paragraph
   of more than ``HOT`` documents is no name by itself: it is named with each
   unit that may be the second shared one, and a third and fourth.  Documents that share
   a name are candidates, so those that share one common paragraph of five don't
   meet.
4. Documents of a group are compared in blocks bounded in documents and in
   shingles.  The global order is cut into ``LEAST_CUTS`` fragments at least; a task has one
   fragment of a block, counts the partial overlaps of its pairs and sends them
   as one packed matrix; the matrices of all fragments are summed per pair.
   (Partial counts as rows would be g^2 rows for g near copies.)
5. A group larger than a block goes round a ring of blocks first.  Then every
   document outside the group's largest component meets, in blocks again, those
   documents that share a name with it and are in another component.
   So each candidate pair is compared or is already connected, whatever the
   group's size, and documents that only hang together by chains don't meet.

Defined cases: null text is empty; a text without words has the empty set and
links with nothing; fewer words than ``words`` make one shingle; repeated rows
and equal sets link; rows with a null doc_id keep their row, their component is
the smallest non-null doc_id of it (null if there is none); extra columns are
ignored by ``near_components`` and carried by ``one_of_each``, whatever their
names; no rows give no rows.  Sets are sets of 64-bit hashes of shingles.
Calling either runs the join; the last join with the rows is left to the caller.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stage, table, text_or_empty
from .components import connected
from .shingles import mix64, shingle_sets

#: Bytes of text in a block of the first exchange.
BLOCK_BYTES = 8 << 20
#: Shingles that a fragment task counts, about.
FRAGMENT_SHINGLES = 1_500_000
#: Documents, and shingles, of one block of a large candidate group; a task compares a fragment of two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 96, 400_000
#: Shingles of a fragment of a block, about.
PART_SHINGLES = 200_000
#: Fragments of a block at least, so that each pair's overlap is a sum of partial ones.
LEAST_CUTS = 4
#: A unit of ``HEAVY`` shingles or more is named with a second one if more than ``HOT`` documents hold it, with a third if twice as many do, with a fourth if four times as many do.
HOT, HEAVY, LONGEST = 16, 16, 4
#: Distinct shingles counted at once.
COLUMNS = 4096


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as counts of their top 16 bits and 48-bit rests."""
    top = (hashes >> np.uint64(48)).astype(np.int64)
    lo, hi = (int(top[0]), int(top[-1])) if len(top) else (0, -1)
    counts = np.bincount(top - lo, minlength=hi - lo + 1).astype("<u4") if len(top) else np.empty(0, "<u4")
    rest = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.array([lo, hi, len(hashes)], "<i8").tobytes() + counts.tobytes() + rest.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    lo, hi, n = np.frombuffer(data, "<i8", 3).tolist()
    counts = np.frombuffer(data, "<u4", hi - lo + 1, 24)
    full = np.zeros((n, 8), np.uint8)
    full[:, :6] = np.frombuffer(data, np.uint8, n * 6, 24 + 4 * len(counts)).reshape(n, 6)
    return full.view("<u8").ravel() | (np.repeat(np.arange(lo, hi + 1), counts).astype(np.uint64) << np.uint64(48))


def _messages(words: int, fragments: int, block_bytes: int):
    width = math.ceil(2**64 / fragments)
    cuts = np.array([min(i * width, 2**64 - 1) for i in range(1, fragments)], np.uint64)

    def flush(ids: list, texts: list[bytes], block: int):
        hashes, owner, sizes = shingle_sets(texts, words)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order].astype("<u4")
        at = np.concatenate(([0], np.searchsorted(hashes, cuts, side="left"), [len(hashes)]))
        rows = [(-block - 1, block, b"", np.array(ids, "<i8").tobytes() + sizes.astype("<i8").tobytes())]
        rows += [(f, block, _pack(hashes[a:b]), owner[a:b].tobytes()) for f, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["fragment", "block", "hashes", "owners"])

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= block_bytes or len(ids) >= 1 << 20:
                    yield flush(ids, texts, block)
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield flush(ids, texts, block)

    return run


#: A shingle of a document: its hash, its unit, the document, and how many hold it.
_POSTING = np.dtype([("h", "<u8"), ("u", "<u8"), ("d", "<u4"), ("n", "<u4")])


def _count_fragment(group: pd.DataFrame) -> pd.DataFrame:
    """Postings of shingles that two documents or more have, by block; a block's header passes."""
    if group["fragment"].iloc[0] < 0:
        return pd.DataFrame({"block": group["block"], "kind": 0, "data": group["owners"]})
    parts = [_unpack(x) for x in group["hashes"]]
    hashes = np.concatenate(parts)
    owner = np.concatenate([np.frombuffer(x, "<u4") for x in group["owners"]])
    block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    count = np.diff(np.append(np.flatnonzero(new), len(hashes)))
    df = np.repeat(count, count)
    keep = df > 1
    hashes, owner, block, df = hashes[keep], owner[order][keep], block[order][keep], df[keep]
    # a shingle's unit: the sum over its documents of what stands for each of them
    each = mix64(mix64(group["block"].to_numpy().astype(np.int64).view("<u8"))[block] + owner.astype("<u8"))
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    unit = np.repeat(np.add.reduceat(each, first), df[first]) if len(first) else each
    made = []
    by_block = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[by_block], np.arange(len(parts) + 1))
    for i, name in enumerate(group["block"]):
        at = by_block[ends[i] : ends[i + 1]]
        if len(at):
            record = np.empty(len(at), _POSTING)
            record["h"], record["u"], record["d"], record["n"] = hashes[at], unit[at], owner[at], np.minimum(df[at], 2**32 - 1)
            made.append((name, 1, record.tobytes()))
    return pd.DataFrame(made, columns=["block", "kind", "data"])


def _names(units: np.ndarray, docs: np.ndarray, need: int, hot: int = HOT) -> np.ndarray:
    """Names under which a document meets all that share ``need`` or more of its shingles, given in the global order.

    Whether a unit needs another one beside it hangs on its own documents and
    shingles alone, so two documents always agree on it.
    """
    first = np.flatnonzero(np.concatenate(([True], units[1:] != units[:-1])))
    unit, docs = units[first], docs[first].astype(np.int64)
    weight = np.diff(np.append(first, len(units)))
    before = first  # shingles of the units before each
    miss = len(units) - need  # shingles that may be in common with nobody
    early = before <= miss
    common = (weight >= HEAVY) & (docs > hot)
    plain = mix64(unit[early & ~common])
    if not (early & common).any():
        return plain
    found: list[int] = []
    low, mask = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def extend(name: int, last: int, held: int, level: int) -> None:
        """All names that begin with the units in ``name``, of which the last is ``last``."""
        for j in range(last + 1, len(unit)):
            if before[j] - held > miss:
                return
            if not level and not common[j]:
                continue  # is in ``plain``
            mine, more = (name * mask + int(unit[j])) & low, held + int(weight[j])
            if level + 1 == LONGEST or not common[j] or docs[j] <= hot * 2**level:
                found.append(mine)
                continue
            if more >= need:  # these may be all that is shared
                found.append(mine ^ mask)
            extend(mine, j, more, level + 1)

    extend(1, -1, 0, 0)
    return np.unique(np.concatenate((plain, mix64(np.array(found, "<u8")))))


def _survivors(percent: int, hot: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Documents of a block that could reach the threshold, with their shared shingles in the global order."""
        head = np.frombuffer(group.loc[group["kind"] == 0, "data"].iloc[0], "<i8")
        ids, sizes = np.split(head, 2)
        record = np.concatenate([np.frombuffer(x, _POSTING) for x in group.loc[group["kind"] == 1, "data"]] or [np.empty(0, _POSTING)])
        shared = np.bincount(record["d"], minlength=len(ids))
        keep = (100 * shared >= percent * sizes) & (sizes > 0)
        record = record[keep[record["d"]]]
        record = record[np.lexsort((record["h"], record["u"], record["n"], record["d"]))]
        ends = np.cumsum(np.where(keep, shared, 0))
        rows = []
        for i in np.flatnonzero(keep):
            mine, size = record[ends[i] - shared[i] : ends[i]], int(sizes[i])
            rows.append((int(ids[i]), size, np.ascontiguousarray(mine["h"]).view("<i8"), _names(mine["u"], mine["n"], -(-percent * size // 100), hot).view("<i8")))
        return pd.DataFrame(rows, columns=["node", "n", "shared", "prefix"])

    return run


def _pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all pairs of a block: partial counts of each fragment, summed per pair."""
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    docs, column = docs[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, len(names), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, len(names) - lo)), np.float32)
        part[docs[a:b], column[a:b] - lo] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _cut(batches):
    """Cuts each document's shingles of a block into the block's fragments of the global order."""
    for batch in batches:
        rows: list[tuple] = []
        for task, part, cuts, node, n, shared in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
            hashes = np.sort(shared.values.to_numpy().view("<u8"))
            width = math.ceil(2**64 / cuts)
            at = np.concatenate(([0], np.searchsorted(hashes, np.array([i * width for i in range(1, cuts)], "<u8")), [len(hashes)]))
            rows += [(task, f, part, node, n, hashes[x:y].tobytes()) for f, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["task", "fragment", "part", "node", "n", "hashes"])


def _partial(group: pd.DataFrame) -> pd.DataFrame:
    """Partial overlaps of all pairs of each block in one fragment, as a packed matrix a block."""
    made = []
    for part, g in group.sort_values("node").groupby("part", sort=False):
        g = g.drop_duplicates("node")
        if len(g) > 1:
            counts = _pair_counts([np.frombuffer(x, "<u8") for x in g["hashes"]])
            made.append((g["task"].iloc[0], part, g["node"].to_numpy("<i8").tobytes(), g["n"].to_numpy("<i8").tobytes(), zlib.compress(counts.astype("<u4").tobytes(), 1)))
    return pd.DataFrame(made, columns=["task", "part", "nodes", "sizes", "counts"])


def _summed(percent: int):
    def links(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        nodes = [np.frombuffer(x, "<i8") for x in group["nodes"]]
        node, first = np.unique(np.concatenate(nodes), return_index=True)
        n = np.concatenate([np.frombuffer(x, "<i8") for x in group["sizes"]])[first]
        both = np.zeros((len(node), len(node)), np.int64)
        for mine, counts in zip(nodes, group["counts"], strict=True):
            at = np.searchsorted(node, mine)
            both[np.ix_(at, at)] += np.frombuffer(zlib.decompress(counts), "<u4").reshape(len(mine), -1)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, True)
        label = np.arange(len(node))
        while True:
            low = np.where(linked, label[None, :], len(node)).min(axis=1)
            if (low == label).all():
                return node, node[label]
            label = low

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = [links(g) for _, g in group.groupby("part", sort=False)]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": a, "b": b})

    return run


def _compared(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of a block that are linked, as stars, from (task, part, cuts, node, n, shared)."""
    cut = parts.select("task", "part", "cuts", "node", "n", "shared").mapInArrow(_cut, "task string, fragment long, part string, node long, n long, hashes binary")
    partial = cut.groupBy("task", "fragment").applyInPandas(_partial, "task string, part string, nodes binary, sizes binary, counts binary")
    return partial.groupBy("task").applyInPandas(_summed(percent), "a long, b long")


def _fragments(shingles: Column) -> Column:
    return F.greatest(F.lit(LEAST_CUTS), F.ceil(shingles / PART_SHINGLES)).cast("long")


def _blocks(docs: DataFrame, block_docs: int) -> tuple[DataFrame, DataFrame]:
    """Whole small groups, and large groups with each document's block."""
    size = docs.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("shared")).alias("held"))
    docs = docs.join(stage(size, "groups"), "label")
    large = (F.col("size") > 2 * block_docs) | ((F.col("held") > 2 * BLOCK_SHINGLES) & (F.col("size") > 2))
    blocks = F.greatest(F.lit(2), F.ceil(F.col("size") / block_docs), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("long")
    cut = docs.where(large).withColumn("blocks", F.least(blocks, F.col("size")))
    return docs.where(~large), cut.withColumn("at", F.pmod(F.xxhash64("node", F.lit(11)), "blocks"))


def _heads(batches):
    for batch in batches:
        for x in batch.column(0):
            ids, sizes = np.split(np.frombuffer(x.as_py(), "<i8"), 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes)], ["node", "n"])


def _remaining(large: DataFrame, found: DataFrame, posts: DataFrame, block_docs: int) -> DataFrame | None:
    """Blocks in which each document outside a group's largest component meets those that share a prefix shingle with it."""
    placed = stage(large.join(found.select("node", F.col("label").alias("comp")), "node"), "placed")
    counts = placed.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("shared")).alias("most_held"))
    main = counts.groupBy("label").agg(F.max_by(F.struct("comp", "most_held"), F.struct("docs", "comp")).alias("x"), F.sum("docs").alias("all"), F.max("docs").alias("most"), F.sum("most_held").alias("total"))
    main = main.where("all > most").withColumn("others", F.col("total") - F.col("x.most_held"))
    rests = F.greatest(F.ceil((F.col("all") - F.col("most")) / block_docs), F.ceil(F.col("others") / BLOCK_SHINGLES)).cast("long")
    main = stage(main.select("label", F.col("x.comp").alias("main"), rests.alias("rests")), "main")
    if main.isEmpty():
        return None
    placed = stage(placed.join(bounded(main), "label").withColumn("r", F.pmod(F.xxhash64("node", F.lit(13)), "rests")), "open")
    mine = posts.join(placed.select("node", "label", "comp", F.when(F.col("comp") != F.col("main"), F.col("r")).alias("r")), "node")
    asks = mine.where("r is not null").select("h", "r", F.col("comp").alias("other"), "label").distinct()
    partners = mine.select("h", "node", "comp", "label").join(asks, ["h", "label"]).where("comp <> other").select("label", "r", "node").distinct()
    partners = stage(partners.join(placed.select("node", F.size("shared").alias("held")), "node"), "partners")
    chunks = partners.groupBy("label", "r").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("held") / BLOCK_SHINGLES)).cast("long").alias("chunks"))
    chunks = stage(chunks, "chunks")
    columns = ["node", "n", "shared", "label", "r", "chunk", "held"]
    theirs = partners.select("node", "label", "r").join(chunks, ["label", "r"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(17)), "chunks"))
    theirs = theirs.join(placed.select("node", "n", "shared", F.size("shared").alias("held")), "node").select(*columns)
    asking = placed.where("comp <> main").join(chunks, ["label", "r"]).withColumn("held", F.size("shared")).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(*columns)
    part = F.concat_ws("/", "label", "r", "chunk")
    return theirs.unionByName(asking).select("node", "n", "shared", part.alias("part"), part.alias("task"), F.lit(_most_cuts()).alias("cuts"))


def _most_cuts() -> int:
    """Fragments of two full blocks."""
    return max(LEAST_CUTS, math.ceil(2 * BLOCK_SHINGLES / PART_SHINGLES))


def near_components(docs: DataFrame, *, words: int = 5, percent: int = 75, block_bytes: int = BLOCK_BYTES, fragment_shingles: int = FRAGMENT_SHINGLES, block_docs: int = BLOCK_DOCS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, label) for every row of ``docs`` (doc_id, text)."""
    text = text_or_empty()
    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("|")).alias("h2")]
    rows = stage(docs.select("doc_id", *keys, F.octet_length(text).alias("bytes")), "rows")
    classes = stage(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")), "classes")
    clash = stage(classes.groupBy("h1").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clash")
    classes = stage(classes.join(bounded(clash), "h1", "left").withColumn("node", F.when(F.col("texts") > 1, F.xxhash64("h1", "h2")).otherwise(F.col("h1"))), "classes")
    special = bounded(stage(classes.where("rows > 1 or texts > 1").select("h1", "h2", "low", "node"), "special"))
    total = classes.agg(F.sum("bytes")).first()[0] or 0

    first = docs.select("doc_id", text.cast("binary").alias("bytes"), *keys).join(special, ["h1", "h2"], "left").where(F.col("low").isNull() | (F.col("low") == F.col("doc_id")))
    fragments = max(96, math.ceil(total / 6 / fragment_shingles))
    sent = first.select(F.coalesce("node", "h1").alias("node"), "bytes").mapInArrow(_messages(words, fragments, block_bytes), "fragment long, block long, hashes binary, owners binary")
    counted = stage(sent.groupBy("fragment").applyInPandas(_count_fragment, "block long, kind int, data binary"), "fragments")
    sizes = stage(counted.where("kind = 0").select("data").mapInArrow(_heads, "node long, n long").groupBy("node").agg(F.max("n").alias("n")), "sizes")
    shared = counted.groupBy("block").applyInPandas(_survivors(percent, hot), "node long, n long, shared array<long>, prefix array<long>")
    shared = stage(shared.groupBy("node").agg(F.max("n").alias("n"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix")), "shared")

    posts = stage(shared.select("node", F.explode("prefix").alias("h")), "posts")
    lows = posts.groupBy("h").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    stars = stage(posts.join(lows, "h").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    groups = stage(shared.select("node", "n", "shared").join(connected(stars), "node"), "groups")
    small, large = _blocks(groups, block_docs)
    tasks = max(96, math.ceil(groups.count() / block_docs))
    whole = small.select("node", "n", "shared", F.col("label").cast("string").alias("part"), F.pmod(F.xxhash64("label"), F.lit(tasks)).cast("string").alias("task"), _fragments(F.col("held")).alias("cuts"))
    ring = large.withColumn("at", F.explode(F.array_distinct(F.array(F.col("at"), F.pmod(F.col("at") + 1, "blocks")))))
    part = F.concat_ws("/", "label", "at")
    ring = ring.select("node", "n", "shared", part.alias("part"), part.alias("task"), _fragments(2 * F.col("held") / F.col("blocks")).alias("cuts"))
    # a document that is alone in its block, or shares no shingle there, is still a node
    alone = groups.select(F.col("node").alias("a"), F.col("node").alias("b"))
    edges = stage(_compared(whole.unionByName(ring), percent).unionByName(alone), "links")
    found = stage(connected(edges), "found")
    rest = _remaining(large, found, posts, block_docs)
    if rest is not None:
        edges = stage(edges.unionByName(_compared(rest, percent)), "links")
        found = stage(connected(edges), "found")

    comps = classes.select("h1", "h2", "low", "node").join(sizes, "node").join(found, "node", "left")
    comps = stage(comps.select("h1", "h2", "low", "n", F.coalesce("label", "node").alias("label")), "comps")
    lowest = comps.groupBy("label").agg(F.min("low").alias("lowest"))
    comps = stage(comps.join(lowest, "label").select("h1", "h2", "n", "lowest", "label"), "lowest")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("lowest"))
    return rows.join(comps, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("h1").alias("text_hash"), "label")


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` of which no other row stays that links to them over any links.

    Of each component the row with the smallest doc_id stays (null last, then by
    the hash of its text); of rows equal in both, one.
    """
    found = near_components(docs, **options).where("n_shingles > 0")
    members = stage(found.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")), "members")
    best = members.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("best"), F.sum("rows").alias("all")).where("all > 1")
    touched = members.join(stage(best, "best"), "label").withColumn("stays", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash")))
    touched = stage(touched.where("not stays or rows > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "stays").distinct(), "touched")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    kept = rows.join(bounded(touched), same, "left_anti").select("row.*")
    several = touched.where("stays")
    if several.isEmpty():
        return kept
    first = rows.join(bounded(several), same, "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return kept.unionByName(first.select("row.*"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).drop("text_hash", "label")
