"""Queries over the retrieval memory, embeddings, summaries and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkthrift.functions import keys as K
from sparkthrift.functions import terms as V
from sparkthrift.functions import text as T
from sparkthrift.operators import memory as M

from .common import NL, conversations, table


def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nodes(conversations(spark, sf_dir)).select("id", "kind", F.size("terms").cast("long").alias("terms"))


def follows_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.follows(conversations(spark, sf_dir))


def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = M.follows(conversations(spark, sf_dir))
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_sort(V.terms(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("terms"), F.sha2(F.array_join(found, " "), 256).alias("sha"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), V.terms(F.col("text")).alias("terms"))


def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), V.terms(F.col("text")).alias("terms"))
    return M.relevant(_asked(spark, sf_dir), docs, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "overlap", F.round("score", 9).alias("score"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is one of the best documents for an item one that holds its whole text?"""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), V.terms(F.col("text")).alias("terms"))
    best = M.relevant(_asked(spark, sf_dir), docs, 5)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("must"))
    found = best.join(items, "query_id").join(texts, "id").groupBy("query_id").agg(F.max(F.contains("text", F.col("must"))).alias("found"))
    return found


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, bucket, value): sparse hashed embeddings, of norm 1."""
    rows = df.select(key, F.explode(V.terms(F.col(text))).alias("term"))
    sums = rows.groupBy(key, V.term_bucket(F.col("term"), dim).alias("bucket")).agg(F.sum(V.term_sign(F.col("term"))).alias("raw")).where("raw <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return sums.join(norms, key).select(key, F.col("bucket").cast("long").alias("bucket"), F.round(F.col("raw") / F.col("norm"), 9).alias("value"))


def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _nearest(rows: DataFrame, asked: DataFrame) -> DataFrame:
    asked = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("qvector"))
    return M.semantic(asked, rows.select("id", "seq", "vector"), 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row asks."""
    rows = _vectors(spark, sf_dir)
    return _nearest(rows, rows)


def node_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).withColumn("seq", F.col("request_id") * 1000 + F.col("msg_idx"))
    return M.node_order(rows, "seq")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind, and edges."""
    rows = conversations(spark, sf_dir)
    found = M.nodes(rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(M.follows(rows).agg(F.count(F.lit(1)).alias("n")).select(F.lit("follows").alias("kind"), "n"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return M.missing_vectors(docs, _vectors(spark, sf_dir).where("label <> 3").select("id")).groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))


def lead_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.lead(F.col("text")), 256).alias("sha"))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summarize(conversations(spark, sf_dir), 3).select("request_id", F.sha2("summary", 256).alias("sha"))


def window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.window_start(conversations(spark, sf_dir), 2).select("request_id", "n", "start", F.sha2("latest", 256).alias("latest_sha"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "msg_idx", "role", "compacted", F.sha2("text", 256).alias("sha"))


def compact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.compact_by_summary(conversations(spark, sf_dir), keep_recent=2, max_items=3, min_messages=4))


def compact_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.compact_by_retrieval(conversations(spark, sf_dir), keep_recent=2, retrieve=2, min_messages=4))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TURNS = f"t AS (SELECT *, CASE WHEN role = 'system' THEN 'fact' ELSE 'turn' END AS kind, {_TRIM.format('text')} AS s FROM conversations WHERE {_TRIM.format('text')} <> ''), n AS (SELECT *, kind || ':' || substr(sha256(kind || chr(0) || s), 1, 16) AS id FROM t)"
_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def _terms_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w)))"


def _lead_sql(text: str) -> str:
    line = f"regexp_extract({_TRIM.format(text)}, '^[^\\n]*')"
    cut = f"CASE WHEN strpos(l, '. ') > 0 THEN substr(l, 1, strpos(l, '. ')) WHEN strpos(l, '? ') > 0 THEN substr(l, 1, strpos(l, '? ')) WHEN strpos(l, '! ') > 0 THEN substr(l, 1, strpos(l, '! ')) ELSE l END"
    return line, cut


_LINE, _CUT = _lead_sql("text")
_STARTS = "z AS (SELECT conv_id, max(n) AS n, max(turn) FILTER (WHERE role = 'user' AND turn <= greatest(0, n - 2)) AS start, max_by(text, turn) FILTER (WHERE role = 'user') AS latest FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id)"
_LEADS = f"a AS (SELECT conv_id, turn, {_TRIM.format(f'substr({_CUT}, 1, 200)')} AS lead FROM (SELECT conv_id, turn, {_TRIM.format(_LINE)} AS l FROM {{src}}))"


def _bullets(src: str, n: int) -> str:
    return f"{_LEADS.format(src=src)}, b AS (SELECT conv_id, min(turn) AS turn, min_by(lead, turn) AS lead FROM a WHERE lead <> '' GROUP BY conv_id, lower(lead)), s AS (SELECT conv_id, string_agg('- ' || lead, {NL} ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM b) WHERE r <= {n} GROUP BY conv_id)"


_REWRITE = f"SELECT c.conv_id AS request_id, c.turn AS msg_idx, c.role, h.header IS NOT NULL AS compacted, sha256(CASE WHEN c.turn = h.start THEN h.header || c.text ELSE c.text END) AS sha FROM conversations c LEFT JOIN h USING (conv_id) WHERE h.header IS NULL OR c.turn >= h.start"
_RELEVANT = "q AS (SELECT item_id AS query_id, {tb} AS t FROM benchmark), k AS (SELECT doc_id AS id, {td} AS t FROM documents), qe AS (SELECT query_id, len(t) AS nq, unnest(t) AS term FROM q), ke AS (SELECT id, len(t) AS nd, unnest(t) AS term FROM k), o AS (SELECT query_id, id, nq, nd, count(*) AS overlap FROM qe JOIN ke USING (term) GROUP BY ALL), r AS (SELECT *, overlap / (nq + nd - overlap) AS score, row_number() OVER (PARTITION BY query_id ORDER BY overlap / (nq + nd - overlap) DESC, overlap DESC, id) AS rank FROM o)".format(tb=_terms_sql("text"), td=_terms_sql("text"))

QUERIES = {
    "node_ids": (node_ids, f"WITH {_TURNS} SELECT id, any_value(kind) AS kind, len({_terms_sql('any_value(s)')}) AS terms FROM n GROUP BY id"),
    "follows_edges": (follows_edges, f"WITH {_TURNS}, e AS (SELECT conv_id AS request_id, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS src, id AS dst FROM n WHERE kind = 'turn') SELECT * FROM e WHERE src IS NOT NULL"),
    "graph_neighbors": (graph_neighbors, f"WITH {_TURNS}, e AS (SELECT lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM n WHERE kind = 'turn') SELECT src, count(*) AS out_degree FROM e WHERE src IS NOT NULL GROUP BY src"),
    "terms": (terms, f"WITH k AS (SELECT doc_id, list_sort({_terms_sql('text')}) AS t FROM documents) SELECT doc_id, len(t) AS terms, sha256(array_to_string(t, ' ')) AS sha FROM k"),
    "jaccard_topk": (jaccard_topk, f"WITH {_RELEVANT} SELECT query_id, id, rank, overlap, round(score, 9) AS score FROM r WHERE rank <= 5"),
    "retrieval_recall": (retrieval_recall, f"WITH {_RELEVANT} SELECT r.query_id, bool_or(contains(d.text, b.text)) AS found FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.id WHERE rank <= 5 GROUP BY r.query_id"),
    "hashing_embed": (hashing_embed, f"WITH t AS (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents), h AS (SELECT doc_id, ('0x' || substr(sha256(term), 15, 2))::INT AS bucket, CASE WHEN (('0x' || substr(sha256(term), 11, 2))::INT & 2) <> 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM t), a AS (SELECT doc_id, bucket, sum(s) AS raw FROM h GROUP BY ALL HAVING sum(s) <> 0) SELECT doc_id, bucket::BIGINT AS bucket, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 9) AS value FROM a"),
    "semantic_topk": (semantic_topk, "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_cosine_similarity(q.v, d.v) AS score FROM v q, v d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10 AND score > 0"),
    "node_order": (node_order, f"WITH {_TURNS} SELECT id, min(conv_id * 1000 + turn) AS seq FROM n GROUP BY id"),
    "graph_counts": (graph_counts, f"WITH {_TURNS}, k AS (SELECT id, any_value(kind) AS kind FROM n GROUP BY id) SELECT kind, count(*) AS n FROM k GROUP BY kind UNION ALL SELECT 'follows', count(*) FROM (SELECT lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM n WHERE kind = 'turn') WHERE src IS NOT NULL"),
    "missing_vectors": (missing_vectors, "SELECT lang, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3) GROUP BY lang"),
    "lead_sentence": (lead_sentence, f"SELECT doc_id, sha256({_TRIM.format(f'substr({_CUT}, 1, 200)')}) AS sha FROM (SELECT doc_id, {_TRIM.format(_LINE)} AS l FROM documents)"),
    "extractive_summary": (extractive_summary, f"WITH {_bullets('conversations', 3)} SELECT conv_id AS request_id, sha256(summary) AS sha FROM s"),
    "window_start": (window_start, f"WITH {_STARTS} SELECT conv_id AS request_id, n, start, sha256(latest) AS latest_sha FROM z"),
    "compact_summary": (compact_summary, f"WITH {_STARTS}, y AS (SELECT conv_id, start FROM z WHERE n > 4 AND start > 0), old AS (SELECT c.* FROM conversations c JOIN y USING (conv_id) WHERE c.turn < y.start), {_bullets('old', 3)}, h AS (SELECT conv_id, start, '{M.SUMMARY_HEADER.strip()}' || {NL} || summary || {NL} || {NL} AS header FROM s JOIN y USING (conv_id)) {_REWRITE}"),
    "compact_retrieval": (
        compact_retrieval,
        f"WITH {_STARTS}, {_TURNS}, y AS (SELECT conv_id, start, {_terms_sql('latest')} AS q FROM z WHERE n > 4 AND start > 0), m AS (SELECT conv_id, id, min(turn) AS seq, min_by(s, turn) AS text FROM n GROUP BY conv_id, id), p AS (SELECT conv_id, seq, text, start, q, {_terms_sql('text')} AS t FROM m JOIN y USING (conv_id)), o AS (SELECT *, len(list_intersect(q, t)) AS overlap FROM p), sc AS (SELECT *, overlap / (len(q) + len(t) - overlap) AS score FROM o WHERE overlap > 0), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, overlap DESC, seq) AS rank FROM sc), h AS (SELECT conv_id, any_value(start) AS start, '{M.CONTEXT_HEADER.strip()}' || {NL} || string_agg('- ' || text, {NL} ORDER BY rank) || {NL} || {NL} AS header FROM r WHERE rank <= 2 GROUP BY conv_id) {_REWRITE}",
    ),
}
