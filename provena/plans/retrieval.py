"""Retrieval channels, fusion and selection on the fixture: embeddings are objects, words of documents are postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import audit
from provena.operators import retrieve as R
from provena.plans.registry import query

QUERY = {"the": 0.4, "of": 0.3, "on": 0.2, "reed": 0.9, "de": 0.1}


def _query_vector(t):
    """The vector of object 0: one row."""
    return t.embeddings.where("vec_id = 0").select("embedding").first()[0]


def _dense(t, k=50):
    return R.dense_topk(t.embeddings, "vec_id", "embedding", _query_vector(t), k)


_DENSE = "SELECT vec_id AS object_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings {where} ORDER BY score DESC, vec_id LIMIT {k}"


@query(_DENSE.format(where="", k=20))
def dense_topk(t):
    """TOP-01."""
    return _dense(t, 20)


@query(_DENSE.format(where="WHERE label IN (1, 3, 5)", k=20))
def scoped_dense_topk(t):
    """TOP-02: eligibility before distance."""
    return R.dense_topk(t.embeddings, "vec_id", "embedding", _query_vector(t), 20, F.col("label").isin(1, 3, 5))


def _postings(t):
    words = t.documents.select(F.col("doc_id").alias("object_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return words.groupBy("object_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


_WORDS = "SELECT doc_id AS object_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents"
_TERMS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in QUERY.items()) + ") q(token, q)"
_SPARSE = f"SELECT object_id, round(sum(n * q), 6)::DOUBLE AS score FROM (SELECT object_id, token, count(*) AS n FROM ({_WORDS}) GROUP BY ALL) JOIN {_TERMS} USING (token) GROUP BY 1 ORDER BY score DESC, object_id LIMIT "


@query(_SPARSE + "25")
def sparse_topk(t):
    """TOP-03, JOIN-10, AGG-11."""
    return R.sparse_topk(_postings(t), QUERY, 25)


_CH = f"""d AS ({_DENSE.format(where='', k=50)}), s AS ({_SPARSE}50), dr AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM d), sr AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM s)"""
_RRF = f"""WITH {_CH}, u AS (SELECT object_id, 1.0::DOUBLE / (60 + rank) AS part, 'dense' AS channel FROM dr UNION ALL SELECT object_id, 1.0::DOUBLE / (60 + rank), 'sparse' FROM sr)
SELECT object_id, round(sum(part), 9)::DOUBLE AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM u GROUP BY 1"""


@query(_RRF)
def rrf_fusion(t):
    """TOP-05."""
    return R.fuse("rrf_dense_sparse", {"dense": _dense(t), "sparse": R.sparse_topk(_postings(t), QUERY, 50)}, {})


@query(f"""WITH {_CH}, u AS (SELECT object_id, CASE WHEN (SELECT max(score) <= min(score) FROM d) THEN 1.0 ELSE (score - (SELECT min(score) FROM d)) / (SELECT max(score) - min(score) FROM d) END * 0.1::DOUBLE AS part FROM d
UNION ALL SELECT object_id, CASE WHEN (SELECT max(score) <= min(score) FROM s) THEN 1.0 ELSE (score - (SELECT min(score) FROM s)) / (SELECT max(score) - min(score) FROM s) END * 0.9::DOUBLE FROM s)
SELECT object_id, round(sum(part), 6)::DOUBLE AS score FROM u GROUP BY 1""")
def weighted_fusion(t):
    """TOP-06, TOP-07."""
    return R.fuse("weighted", {"dense": _dense(t), "sparse": R.sparse_topk(_postings(t), QUERY, 50)}, {"dense": 0.1, "sparse": 0.9})


@query(f"""WITH {_CH}, p AS (SELECT doc_id AS object_id, 0.5::DOUBLE AS score FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 50),
u AS (SELECT object_id, score, 'dense' AS channel FROM d UNION ALL SELECT object_id, score, 'sparse' FROM s UNION ALL SELECT object_id, score, 'property' FROM p)
SELECT object_id, max(score)::DOUBLE AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM u GROUP BY 1""")
def channel_merge(t):
    """TOP-04, TOP-08."""
    prop = t.documents.where("source = 'src1'").select(F.col("doc_id").alias("object_id"), F.lit(0.5).alias("score")).orderBy("object_id").limit(50)
    base = _dense(t).withColumn("channels", F.array(F.lit("dense")))
    return R.merge_channels(base, {"sparse": R.sparse_topk(_postings(t), QUERY, 50), "property": prop}).withColumn("channels", F.array_join("channels", ","))


@query(f"""WITH s AS ({_SPARSE}50) SELECT object_id, CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END + CASE WHEN source = 'src3' THEN 0.9 ELSE 0 END + CASE WHEN n_chars > 3000 THEN 0.45 ELSE 0 END AS rerank_bonus, round(score + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END + CASE WHEN source = 'src3' THEN 0.9 ELSE 0 END + CASE WHEN n_chars > 3000 THEN 0.45 ELSE 0 END, 6) AS score FROM s JOIN documents ON doc_id = object_id ORDER BY score DESC, object_id LIMIT 30""".replace("AS rerank_bonus", "::DOUBLE AS rerank_bonus").replace("SELECT object_id, CASE", "SELECT object_id, (CASE").replace("ELSE 0 END ::DOUBLE", "ELSE 0 END)::DOUBLE"))
def soft_rerank(t):
    """TOP-09."""
    pool = R.sparse_topk(_postings(t), QUERY, 50).join(t.documents.select(F.col("doc_id").alias("object_id"), "lang", "source", "n_chars"), "object_id")
    return R.rerank(pool, [(F.col("lang") == "en", 0.25), (F.col("source") == "src3", 0.9), (F.col("n_chars") > 3000, 0.45)], 30).select("object_id", "rerank_bonus", "score")


@query("""SELECT vec_id AS object_id, label, round(score + CASE WHEN label = 2 THEN 3.0 ELSE -5.0 END + CASE WHEN vec_id % 4 = 0 THEN 2.0 ELSE 0.0 END + CASE WHEN vec_id % 7 = 0 THEN 1.5 ELSE 0.0 END - CASE WHEN vec_id % 5 = 0 THEN 2.0 ELSE 0.0 END, 6) AS score FROM (
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60)""")
def structured_rerank(t):
    """TOP-10: matches add, a wrong document and a confusion take away."""
    pool = _dense(t, 60).join(t.embeddings.select(F.col("vec_id").alias("object_id"), "label"), "object_id")
    i = F.col("object_id")
    return R.rerank(pool, [(F.col("label") == 2, 3.0), (F.col("label") != 2, -5.0), (i % 4 == 0, 2.0), (i % 7 == 0, 1.5), (i % 5 == 0, -2.0)]).select("object_id", "label", "score")


def _pool(t, k=60):
    return _dense(t, k).join(t.embeddings.select(F.col("vec_id").alias("object_id"), F.col("label").alias("doc")), "object_id")


_POOL = f"p AS (SELECT object_id, score, label AS doc FROM ({_DENSE.format(where='', k=60)}) JOIN embeddings ON vec_id = object_id)"


@query(f"""WITH {_POOL}, t AS (SELECT *, row_number() OVER w AS turn, first_value(score) OVER w AS bs, first_value(object_id) OVER w AS bo FROM p WINDOW w AS (PARTITION BY doc ORDER BY score DESC, object_id))
SELECT object_id, doc, score, turn::INTEGER AS turn, row_number() OVER (ORDER BY turn, bs DESC, bo)::INTEGER AS position FROM t""")
def round_robin(t):
    """TOP-11: documents take turns."""
    return R.round_robin(_pool(t), "doc").select("object_id", "doc", "score", "turn", "position")


@query(f"""WITH {_POOL}, f AS (SELECT *, CASE WHEN object_id % 3 = 0 THEN 0 ELSE 1 END AS block FROM p), t AS (SELECT *, row_number() OVER w AS turn, first_value(score) OVER w AS bs, first_value(object_id) OVER w AS bo FROM f WINDOW w AS (PARTITION BY block, doc ORDER BY score DESC, object_id))
SELECT object_id, doc, score, block, turn::INTEGER AS turn, row_number() OVER (ORDER BY block, turn, bs DESC, bo)::INTEGER AS position FROM t""")
def partition_then_rest(t):
    """TOP-12: the channel's rows first, then the rest."""
    return R.round_robin(_pool(t), "doc", F.col("object_id") % 3 == 0).select("object_id", "doc", "score", "block", "turn", "position")


@query(f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY doc) AS doc_rank FROM r),
n AS (SELECT *, dense_rank() OVER (ORDER BY doc_rank) AS doc_no FROM t), q AS (SELECT *, CASE WHEN turn = 1 AND doc_no <= 4 THEN 1 WHEN turn <= 2 THEN 2 ELSE 3 END AS pass FROM n)
SELECT object_id, doc, score, pass, row_number() OVER (ORDER BY pass, rank)::INTEGER AS position FROM q QUALIFY position <= 30""")
def expand_selection(t):
    """TOP-13."""
    return R.expand_selection(_pool(t), "doc")


@query(f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id)::INTEGER AS position FROM p)
SELECT object_id, score, position, (SELECT count(*) FROM p) > 30 AS has_more, CASE WHEN (SELECT count(*) FROM p) > 30 THEN 30 END AS next_offset FROM r WHERE position > 20 AND position <= 30""")
def paginate(t):
    """TOP-14: the third page of ten."""
    return R.page(_pool(t), 20, 10, [F.desc("score"), F.col("object_id")]).select("object_id", "score", "position", "has_more", "next_offset")


@query(f"""WITH {_CH}, u AS (SELECT object_id, rank, score, 'a' AS variant FROM dr UNION ALL SELECT object_id, rank, score, 'b' FROM sr UNION ALL SELECT object_id, rank + 5, score, 'c' FROM dr WHERE object_id % 2 = 0)
SELECT object_id, min(rank)::INTEGER AS rank, max(score)::DOUBLE AS score, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM u GROUP BY 1""")
def variant_merge(t):
    """TOP-15."""
    d, s = R.ranked(_dense(t)), R.ranked(R.sparse_topk(_postings(t), QUERY, 50))
    parts = [d.withColumn("variant", F.lit("a")), s.withColumn("variant", F.lit("b")), d.where("object_id % 2 = 0").withColumn("rank", F.col("rank") + 5).withColumn("variant", F.lit("c"))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p.select(both.columns))
    return R.merge_variants(both)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, 'status' AS unmet FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def adjacent_relax(t):
    """TOP-16: nothing is exact, so the first axis that can be dropped is."""
    axes = {"status": F.col("o_orderstatus") == "NONE", "priority": F.col("o_orderpriority") == "1-URGENT", "price": F.col("o_totalprice") > 300}
    got, _ = R.relax(t.orders, axes, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")])
    return got.select("o_custkey", "o_orderkey", "o_totalprice", "unmet")


_SCAN = " + ".join(f"CASE WHEN lower({f}) LIKE '%{w}%' THEN {p} ELSE 0 END" for f in ("p_name", "p_brand") for w, p in (("red", "1.0"), ("ring", "1.0"), ("red ring", "3.0")))


@query(f"""WITH s AS (SELECT p_partkey, {_SCAN} AS m, CASE WHEN p_size > 40 THEN 2.0 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 0.5 ELSE 0 END AS b FROM part)
SELECT p_partkey, (m + b)::DOUBLE AS score FROM s WHERE m > 0 OR NOT EXISTS (SELECT 1 FROM s WHERE m > 0)""")
def doc_scan_rank(t):
    """TOP-17."""
    got = R.field_scan(t.part, "p_partkey", ["p_name", "p_brand"], ["red", "ring"], "red ring", [(F.col("p_size") > 40, 2.0), (F.col("p_brand") == "Brand#1", 0.5)])
    return got.select("p_partkey", "score")


@query("""WITH b AS (SELECT o_custkey, max(o_totalprice) AS doc_score FROM orders GROUP BY 1 ORDER BY doc_score DESC, o_custkey LIMIT 20), r AS (SELECT o_custkey, o_orderkey, o_totalprice, doc_score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders JOIN b USING (o_custkey) QUALIFY turn <= 3),
s AS (SELECT *, sum(o_orderkey % 100) OVER (ORDER BY doc_score DESC, o_custkey, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM r) SELECT o_custkey, o_orderkey, doc_score, turn::INTEGER AS turn, spent FROM s WHERE spent <= 1500""")
def grouped_chunk_search(t):
    """TOP-18: best chunks of the best documents, within a budget."""
    got = R.grouped_search(t.orders.withColumn("score", F.col("o_totalprice")), "o_custkey", "o_orderkey", 3, 20, 1500, F.col("o_orderkey") % 100)
    return got.select("o_custkey", "o_orderkey", "doc_score", "turn", "spent")


@query("""WITH v AS (SELECT DISTINCT 'type' AS dimension, p_type AS value FROM part UNION SELECT DISTINCT 'brand', p_brand FROM part UNION SELECT DISTINCT 'segment', c_mktsegment FROM customer)
SELECT dimension, value, CASE WHEN lower(value) = 'brand#1' THEN 'exact' WHEN lower(value) LIKE '%brand#1%' THEN 'related' ELSE 'browse' END AS kind, CASE WHEN lower(value) = 'brand#1' THEN 0 WHEN lower(value) LIKE '%brand#1%' THEN 1 ELSE 2 END AS place FROM v""")
def vocab_rank(t):
    """TOP-22."""
    part, customer = t.part, t.customer
    values = part.select(F.lit("type").alias("dimension"), F.col("p_type").alias("value")).union(part.select(F.lit("brand"), F.col("p_brand"))).union(customer.select(F.lit("segment"), F.col("c_mktsegment"))).distinct()
    return R.vocabulary(values, "Brand#1")


@query("""SELECT dimension, value, count(*)::BIGINT AS n FROM (SELECT 'type' AS dimension, p_type AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part) GROUP BY ALL""")
def vocab_histogram(t):
    """AGG-24."""
    values = t.part.select(F.explode(F.array(F.struct(F.lit("type").alias("dimension"), F.col("p_type").alias("value")), F.struct(F.lit("brand").alias("dimension"), F.col("p_brand").alias("value")))).alias("v"))
    return values.groupBy("v.dimension", "v.value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT conv_id * 1000 + turn AS id, role, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM conversations), s AS (SELECT id, len(list_intersect(w, ['the', 'of', 'und', 'que'])) AS overlap, role FROM m)
SELECT id, overlap::INTEGER AS overlap, round(CASE WHEN role = 'user' THEN 2.0 ELSE -1.0 END + overlap + (id % 10) / 10.0, 6)::DOUBLE AS score FROM s ORDER BY score DESC, id LIMIT 8""")
def memory_relevance(t):
    """TOP-21: the eight most relevant memories."""
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("tokens"))
    return R.memory_relevance(rows, ["the", "of", "und", "que"], F.col("role") == "user", (F.col("id") % 10) / 10.0).select("id", "overlap", "score")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, sum(length(text))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations GROUP BY 1, 2),
b AS (SELECT conv_id, turn, size, i, 0 AS batch, size AS used FROM s WHERE i = 1 UNION ALL
SELECT s.conv_id, s.turn, s.size, s.i, CASE WHEN used > 0 AND used + s.size > 2000 THEN batch + 1 ELSE batch END, CASE WHEN used > 0 AND used + s.size > 2000 THEN s.size ELSE used + s.size END FROM b JOIN s ON s.conv_id = b.conv_id AND s.i = b.i + 1)
SELECT conv_id, turn, size, batch::INTEGER AS batch, size > 2000 AS oversize FROM b""")
def batch_planning(t):
    """TOP-25: greedy batches of a conversation's turns under a budget."""
    rows = t.conversations.withColumn("size", F.length("text").cast("long"))
    return R.plan_batches(rows, "conv_id", "turn", "size", 2000)


@query("""SELECT conv_id, max(turn)::BIGINT AS turn, arg_max(text, turn) AS text, count(*)::BIGINT AS turns FROM conversations WHERE role = 'user' GROUP BY 1""".replace("arg_max(text, turn)", "md5(arg_max(text, turn))"))
def latest_cursor(t):
    """Survey 2.10: the latest valid cursor of a conversation."""
    rows = t.conversations.where("role = 'user'")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn").cast("binary")).alias("text"), F.count(F.lit(1)).alias("turns"))


@query(f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id)::INTEGER AS position FROM p),
g AS (SELECT CAST((position - 1) // 10 AS INTEGER) AS page, object_id, position FROM r WHERE position <= 20),
s AS (SELECT page, count(*)::BIGINT AS n, count(DISTINCT object_id)::BIGINT AS n_ids, (min(position) - 1)::BIGINT AS offset_, count(*) FILTER (object_id IN (SELECT object_id FROM g GROUP BY 1 HAVING count(DISTINCT page) > 1))::BIGINT AS n_shared FROM g GROUP BY 1)
SELECT page, n, n_ids, offset_ AS "offset", n_shared, n = 10 AND n_ids = 10 AND offset_ = page * 10 AND n_shared = 0 AS ok FROM s""")
def release_pages(t):
    """QA-11: two pages of ten are full, distinct and in place."""
    pages = [R.page(_pool(t), at, 10, [F.desc("score"), F.col("object_id")]) for at in (0, 10)]
    return audit.page_gates(pages, "object_id", "position", 10)
