"""Retrieval memory: a graph of texts, retrieval, summaries, compaction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkthrift.functions import keys as K
from sparkthrift.functions import terms as V
from sparkthrift.functions import text as T

CONTEXT_HEADER = "Relevant earlier context (retrieved from memory):\n"
SUMMARY_HEADER = "Conversation summary so far:\n"
#: Rows of a block of vectors or of queries, about, and blocks of each at least.
BLOCK_ROWS, LEAST_BLOCKS = 16_384, 6


def _turns(messages: DataFrame) -> DataFrame:
    """Non-blank messages with their node (system text is a fact, others are turns)."""
    rows = messages.withColumn("text", T.strip(F.col("text"))).where(F.col("text") != "")
    kind = F.when(F.col("role") == "system", "fact").otherwise("turn")
    return rows.withColumn("kind", kind).withColumn("id", K.node_id(F.col("kind"), F.col("text")))


def nodes(messages: DataFrame) -> DataFrame:
    """(id, kind, text, terms): content-addressed, so equal texts are one node."""
    rows = _turns(messages).groupBy("id").agg(F.first("kind").alias("kind"), F.first("text").alias("text"))
    return rows.withColumn("terms", F.array_sort(V.terms(F.col("text"))))


def node_order(messages: DataFrame, seq: str) -> DataFrame:
    """(id, seq): the order in which nodes came in, by the first message of each."""
    return _turns(messages).groupBy("id").agg(F.min(seq).alias("seq"))


def follows(messages: DataFrame) -> DataFrame:
    """(request_id, src, dst): each turn follows the one before; edges are a multiset."""
    turns = _turns(messages).where("kind = 'turn'")
    before = F.lag("id").over(Window.partitionBy("request_id").orderBy("msg_idx"))
    return turns.select("request_id", before.alias("src"), F.col("id").alias("dst")).where(F.col("src").isNotNull())


def neighbors(edges: DataFrame, src: str) -> DataFrame:
    return edges.where(F.col("src") == src).select("dst")


def missing_vectors(node_rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return node_rows.join(vectors, "id", "left_anti")


def relevant(queries: DataFrame, node_rows: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank): ``k`` nodes of the highest Jaccard score over ``min_score``.

    An inverted index: only pairs that share a term meet, and a score over 0
    needs one.  Ties: larger overlap, then smaller seq.
    """
    q = queries.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("nq"))
    d = node_rows.select("id", "seq", F.explode("terms").alias("term"), F.size("terms").alias("nd"))
    both = q.join(d, "term").groupBy("query_id", "id", "seq", "nq", "nd").agg(F.count(F.lit(1)).alias("overlap"))
    scored = both.withColumn("score", F.col("overlap") / (F.col("nq") + F.col("nd") - F.col("overlap"))).where(F.col("score") > min_score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("overlap"), "seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "overlap", "rank")


def semantic(queries: DataFrame, vectors: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, score, rank): ``k`` nearest by cosine, then those not over 0 go.

    Queries meet the vectors block by block, and a pair of blocks emits ``k`` rows
    a query.  Vectors and queries that are null or hold null or non-finite
    components take no part.
    """
    scored = _by_blocks(queries, vectors, k, block_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    return scored.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0)).drop("seq")


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(query_id, id, seq, score): of each block of vectors, the ``k`` best of each query with a score over 0."""

    def usable(v: Column) -> Column:
        return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def dealt(rows: DataFrame, vector: str, key: str, own: str, other: str, blocks: int, others: int) -> DataFrame:
        rows = rows.where(usable(F.col(vector))).withColumn(vector, F.col(vector).cast("array<double>"))
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key, vector), F.lit(blocks)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    n, asked = (max(LEAST_BLOCKS, math.ceil(x.count() / block_rows)) for x in (vectors, queries))
    left = dealt(vectors.select("id", "seq", "vector"), "vector", "id", "b", "q", n, asked)
    right = dealt(queries.select("query_id", "qvector"), "qvector", "query_id", "q", "b", asked, n)
    kinds = [(x, df.schema[x].dataType.simpleString()) for x, df in (("query_id", queries), ("id", vectors), ("seq", vectors))]
    out = ", ".join(f"{x} {kind}" for x, kind in kinds)

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "id": [], "seq": [], "score": []})]
        if not len(v) or not len(q):
            return found[0]
        if len({*map(len, v["vector"]), *map(len, q["qvector"])}) > 1:
            raise ValueError("vectors of different lengths")
        v = v.sort_values("seq", kind="stable")
        a, b = np.array(v["vector"].tolist(), float), np.array(q["qvector"].tolist(), float)
        # sums go from left to right, as those of V.norm and V.dot
        na, nb = (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x)) for x in (a, b))
        ua, ub = (x / np.where(n == 0, 1, n)[:, None] for x, n in ((a, na), (b, nb)))
        for lo in range(0, len(b), 128):
            rough = ub[lo : lo + 128] @ ua.T
            least = np.partition(rough, -k, axis=1)[:, -k] if k < rough.shape[1] else np.full(len(rough), -2.0)
            qs, vs = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -1e-9))
            best = []
            for part in range(0, len(qs), 1 << 16):
                i, j = qs[part : part + (1 << 16)] + lo, vs[part : part + (1 << 16)]
                scale = nb[i] * na[j]
                sums = np.cumsum(a[j] * b[i], axis=1)[:, -1] if a.shape[1] else np.zeros(len(i))
                best.append(np.where(scale == 0, 0.0, sums / np.where(scale == 0, 1, scale)))
            score = np.concatenate([np.empty(0), *best])
            order = np.lexsort((vs, -score, qs))
            nth = np.arange(len(order)) - np.searchsorted(qs[order], qs[order])
            order = order[(nth < k) & (score[order] > 0)]
            i, j = qs[order] + lo, vs[order]
            found.append(pd.DataFrame({"query_id": q["query_id"].to_numpy()[i], "id": v["id"].to_numpy()[j], "seq": v["seq"].to_numpy()[j], "score": score[order]}))
        return pd.concat(found[1:])

    return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(search, f"{out}, score double")


def window_start(messages: DataFrame, keep_recent: int = 4) -> DataFrame:
    """(request_id, n, start, latest): where the kept window starts (a user message), latest user text.

    ``start`` is null without a user message at or before n - keep_recent.
    """
    numbered = messages.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("request_id")))
    user = F.col("role") == "user"
    target = F.greatest(F.lit(0), F.col("n") - keep_recent)
    return numbered.groupBy("request_id").agg(F.max("n").alias("n"), F.max(F.when(user & (F.col("msg_idx") <= target), F.col("msg_idx"))).alias("start"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("msg_idx"))).alias("latest"))


def summarize(messages: DataFrame, max_items: int = 5) -> DataFrame:
    """(request_id, summary): distinct leads in order, the first ``max_items`` as bullets."""
    rows = messages.withColumn("lead", T.lead(F.col("text"))).where(F.col("lead") != "")
    first = rows.groupBy("request_id", F.lower("lead").alias("l")).agg(F.min(F.struct("msg_idx", "lead")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("f.msg_idx"))
    top = first.withColumn("nth", nth).where(F.col("nth") <= max_items)
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("f.lead").alias("lead")))), lambda x: F.concat(F.lit("- "), x["lead"]))
    return top.groupBy("request_id").agg(F.array_join(bullets, "\n").alias("summary"))


def _rewrite(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """Drops messages before ``start`` and puts ``header`` before the first that stays."""
    rows = messages.join(plan, "request_id", "left")
    kept = rows.where(F.col("header").isNull() | (F.col("msg_idx") >= F.col("start")))
    text = F.when(F.col("header").isNotNull() & (F.col("msg_idx") == F.col("start")), F.concat("header", "text")).otherwise(F.col("text"))
    return kept.select("request_id", "msg_idx", "role", text.alias("text"), F.col("header").isNotNull().alias("compacted"))


def compact_by_summary(messages: DataFrame, *, keep_recent: int = 4, max_items: int = 5, min_messages: int = 8) -> DataFrame:
    starts = window_start(messages, keep_recent).where((F.col("n") > min_messages) & (F.col("start") > 0)).select("request_id", "start")
    old = messages.join(starts, "request_id").where(F.col("msg_idx") < F.col("start"))
    plan = summarize(old, max_items).join(starts, "request_id")
    return _rewrite(messages, plan.select("request_id", "start", F.concat(F.lit(SUMMARY_HEADER), "summary", F.lit("\n\n")).alias("header")))


def compact_by_retrieval(messages: DataFrame, *, keep_recent: int = 4, retrieve: int = 3, min_messages: int = 8) -> DataFrame:
    """Old turns are replaced by those of the request's own memory nearest to the latest user text."""
    starts = window_start(messages, keep_recent).where((F.col("n") > min_messages) & (F.col("start") > 0))
    turns = _turns(messages).groupBy("request_id", "id").agg(F.min(F.struct("msg_idx", "text")).alias("t"))
    docs = turns.select("request_id", "id", F.col("t.msg_idx").alias("seq"), F.col("t.text").alias("text"), V.terms(F.col("t.text")).alias("terms"))
    asked = starts.select("request_id", "start", V.terms(F.col("latest")).alias("asked"))
    scored = docs.join(asked, "request_id").withColumn("overlap", F.size(F.array_intersect("terms", "asked"))).withColumn("score", V.jaccard(F.col("terms"), F.col("asked"))).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("overlap"), "seq"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= retrieve)
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"]))
    plan = top.groupBy("request_id").agg(F.first("start").alias("start"), F.concat(F.lit(CONTEXT_HEADER), F.array_join(bullets, "\n"), F.lit("\n\n")).alias("header"))
    return _rewrite(messages, plan)


def sound(messages: Column) -> Column:
    """May a rewritten request be sent: does it begin with a user message?"""
    return F.coalesce(F.get(messages, F.lit(0))["role"] == "user", F.lit(False))


def recalled(requests: DataFrame, *, keep_recent: int = 4, retrieve: int = 3, min_messages: int = 8) -> DataFrame:
    """(request_id, start, header): what takes the place of the messages before ``start``, for requests that are compacted.

    ``requests`` has request_id, tenant, ts, system, messages (role, text, raw).
    A tenant's memory holds the texts of its requests up to and with the one that
    asks, in the order of (ts, request_id, message); equal texts are one node,
    from the first on.  Requests with raw messages are remembered by their texts
    but not compacted, nor are those of which nothing is near.  Nodes and queries
    meet by shared terms; the text of a node is joined back only for the few
    that are retrieved.
    """
    own = F.transform("messages", lambda m, i: F.struct((i + 1).alias("msg_idx"), m["role"].alias("role"), m["text"].alias("text")))
    listed = F.concat(F.array(F.struct(F.lit(0).alias("msg_idx"), F.lit("system").alias("role"), F.col("system").alias("text"))), own)
    turns = _turns(requests.select("request_id", "tenant", "ts", F.explode(listed).alias("m")).select("request_id", "tenant", "ts", "m.*").where("text is not null"))
    order = F.struct("ts", "request_id", "msg_idx")
    known = turns.groupBy("tenant", "id").agg(F.min(order).alias("seq"), F.min_by("text", order).alias("text"))
    m = F.col("messages")
    target = F.greatest(F.lit(0), F.size(m) - keep_recent)
    start = F.array_max(F.transform(m, lambda x, i: F.when((x["role"] == "user") & (i <= target), i)))
    latest = F.get(F.reverse(F.filter(m, lambda x: x["role"] == "user")), F.lit(0))["text"]
    apt = (F.size(m) > min_messages) & ~F.exists(m, lambda x: x["raw"].isNotNull()) & (start > 0)
    asked = requests.where(apt).select("request_id", "tenant", "ts", start.alias("start"), V.terms(latest).alias("terms"))
    q = asked.select("request_id", "tenant", F.col("ts").alias("at"), F.explode("terms").alias("term"), F.size("terms").alias("nq"))
    d = known.select("tenant", "id", "seq", V.terms(F.col("text")).alias("terms")).select("tenant", "id", "seq", F.explode("terms").alias("term"), F.size("terms").alias("nd"))
    before = (F.col("seq.ts") < F.col("at")) | ((F.col("seq.ts") == F.col("at")) & (F.col("seq.request_id") <= F.col("request_id")))
    both = q.join(d, ["tenant", "term"]).where(before).groupBy("request_id", "tenant", "id", "seq", "nq", "nd").agg(F.count(F.lit(1)).alias("overlap"))
    scored = both.withColumn("score", F.col("overlap") / (F.col("nq") + F.col("nd") - F.col("overlap")))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("overlap"), "seq"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= retrieve).select("request_id", "tenant", "id", "rank")
    lines = top.join(known.select("tenant", "id", "text"), ["tenant", "id"]).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("lines"))
    bullets = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    header = F.concat(F.lit(CONTEXT_HEADER), bullets, F.lit("\n\n"))
    return lines.join(asked.select("request_id", "start"), "request_id").select("request_id", "start", header.alias("header"))


def action(*, ingest: bool, structured: Column, summarise: bool, inject: bool) -> Column:
    """What the memory does with a request: off, ingest, summary or compact."""
    if not ingest:
        return F.lit("off")
    other = "summary" if summarise else "compact" if inject else "ingest"
    return F.when(structured, "ingest").otherwise(other)
