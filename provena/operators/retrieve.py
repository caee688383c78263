"""Candidate channels, fusion, reranking, diversification and pages (survey TOP)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
QUERY_TERMS = 256
#: Rows of a block of queries and of objects; a task multiplies STRIP queries of one by all objects of another at a time.
QUERY_BLOCK, OBJECT_BLOCK, STRIP = 2048, 4096, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dense_topk(objects: DataFrame, object_id: str, vector: str, query: Sequence[float], k: int, eligible: Column | None = None) -> DataFrame:
    """The k most similar objects (score, then id); eligibility is settled before distance (TOP-01, TOP-02)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = objects if eligible is None else objects.where(eligible)
    return rows.select(F.col(object_id).alias("object_id"), F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), "object_id").limit(k)


def nearest(queries: DataFrame, objects: DataFrame, k: int, bonus: float = 0.0) -> DataFrame:
    """The k objects of greatest dot product for every query, itself left out, with ranks from 1 by (score, id).

    ``queries``: query_id, query_label, q. ``objects``: object_id, label, embedding;
    ids are keys. A shared label adds ``bonus``. Blocks of queries meet blocks of
    objects, so that all pairs are scored; a pair of blocks gives on what its scores
    rounded to six digits can rank within k, and of equal scores the least ids.
    Sums run from the first place on, in doubles. A null vector has a null score.
    """
    n_q, n_o = queries.count(), objects.count()
    q_blocks, o_blocks = -(-n_q // QUERY_BLOCK) or 1, -(-n_o // OBJECT_BLOCK) or 1
    deal = lambda rows, c, own, n, other, m: rows.where(F.col(c).isNotNull()).withColumns({own: F.pmod(F.xxhash64(c), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}).repartition(n * m, "qb", "ob").groupBy("qb", "ob")
    left = deal(queries.select("query_id", "query_label", "q"), "query_id", "qb", q_blocks, "ob", o_blocks)
    right = deal(objects.select("object_id", "label", "embedding"), "object_id", "ob", o_blocks, "qb", q_blocks)
    kinds = dict(queries.dtypes) | dict(objects.dtypes)
    strip = STRIP

    def pair(a, b):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(column):
            rows = column.combine_chunks()
            there, kept = rows.is_valid().to_numpy(zero_copy_only=False), rows.drop_null()
            if (widths := len(set(pc.list_value_length(kept).to_pylist()))) > 1:
                raise ValueError("vectors of different lengths")
            flat = kept.flatten().to_numpy(zero_copy_only=False).astype("float64")
            out = np.zeros((len(rows), len(flat) // max(1, len(kept)) if widths else 0))
            out[there] = flat.reshape(len(kept), -1) if len(kept) else 0
            return out, there

        plain = lambda t, c: t[c].to_numpy()
        q_id, o_id = plain(a, "query_id"), plain(b, "object_id")
        q_label, o_label = plain(a, "query_label"), plain(b, "label")
        found = []
        if len(q_id) and len(o_id):
            (x, x_there), (y, y_there) = matrix(a["q"]), matrix(b["embedding"])
            if x.shape[1] != y.shape[1] and x_there.any() and y_there.any():
                raise ValueError("vectors of different lengths")
            x, y = (v if ok.any() else np.zeros((len(v), max(x.shape[1], y.shape[1]))) for v, ok in ((x, x_there), (y, y_there)))
            columns = np.ascontiguousarray(y.T)
            for at in range(0, len(q_id), strip):
                part = x[at : at + strip]
                raw = part @ columns  # near enough to choose by; what is chosen is summed in order below
                slack = 4e-6 + 1e-12 * np.sqrt((part**2).sum(1).max() * (columns**2).sum(0).max())  # two roundings of two scores, and this product's error
                raw[~x_there[at : at + strip]] = -np.inf
                raw[:, ~y_there] = -np.inf
                same = q_label[at : at + strip, None] == o_label
                score = raw + bonus * same if bonus else raw
                if len(o_id) > k + 1:  # one more, for the query itself
                    least = np.partition(score, len(o_id) - k - 1, axis=1)[:, len(o_id) - k - 1, None]
                    i, j = np.nonzero(~(score < least - slack))
                else:
                    i, j = (z.ravel() for z in np.indices(raw.shape))
                own = q_id[at + i] != o_id[j]
                i, j = i[own], j[own]
                r, m = np.zeros(len(i)), same[i, j]
                for d in range(part.shape[1]):
                    r += part[i, d] * columns[d, j]
                r[np.isneginf(raw[i, j])] = -np.inf
                order = np.lexsort((o_id[j], m, r, i))  # copies tie: the first k ids of each score are enough
                i, j, r, m = i[order], j[order], r[order], m[order]
                fresh = np.ones(len(i), bool)
                fresh[1:] = (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (m[1:] != m[:-1])
                place = np.arange(len(i))
                keep = place - np.maximum.accumulate(np.where(fresh, place, 0)) < k
                found.append((at + i[keep], j[keep], r[keep]))
        i, j, r = (np.concatenate([f[c] for f in found] or [np.zeros(0, t)]) for c, t in enumerate(("int64", "int64", "float64")))
        return pa.table({
            "query_id": a["query_id"].combine_chunks().take(pa.array(i)), "query_label": a["query_label"].combine_chunks().take(pa.array(i)),
            "object_id": b["object_id"].combine_chunks().take(pa.array(j)), "label": b["label"].combine_chunks().take(pa.array(j)), "raw": pa.array(r, mask=r == -np.inf),
        })

    rows = left.cogroup(right).applyInArrow(pair, f"query_id {kinds['query_id']}, query_label {kinds['query_label']}, object_id {kinds['object_id']}, label {kinds['label']}, raw double")
    score = F.round("raw", 6)
    if bonus:
        score = F.round(score + F.when(F.col("label") == F.col("query_label"), bonus).otherwise(0.0), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id")
    return rows.withColumn("score", score).drop("raw").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def sparse_topk(postings: DataFrame, query: Mapping[str, float], k: int) -> DataFrame:
    """Sum of query weight times posting weight; the query is cut to its heaviest terms (TOP-03, JOIN-10, AGG-11).

    ``postings``: object_id, token, weight. The query is at most QUERY_TERMS rows, so it is sent to the postings.
    """
    heavy = sorted(query.items(), key=lambda x: (-x[1], x[0]))[:QUERY_TERMS]
    terms = postings.sparkSession.createDataFrame([(t, float(w)) for t, w in heavy], "token string, q double")
    hits = postings.where(F.col("token").isin([t for t, _ in heavy])).join(F.broadcast(terms), "token")
    scored = hits.groupBy("object_id").agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "object_id").limit(k)


def ranked(channel: DataFrame) -> DataFrame:
    """A bounded channel with ranks from 1 by (score, id)."""
    return channel.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "object_id")))


def rrf(channels: Mapping[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of bounded channels (TOP-05)."""
    parts = [ranked(c).select("object_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(n).alias("channel")) for n, c in channels.items()]
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy("object_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


def weighted(channels: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of min-max scores; a channel of one value counts 1, a missing object 0 (TOP-06)."""
    parts = []
    for n, c in channels.items():
        ends = c.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        unit = F.when(F.col("hi") <= F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        parts.append(c.crossJoin(F.broadcast(ends)).select("object_id", (unit * float(weights.get(n, 0.0))).alias("part")))
    return reduce(DataFrame.unionAll, parts).groupBy("object_id").agg(F.round(F.sum("part"), 6).alias("score"))


def fuse(name: str, channels: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Fusion by configuration name (TOP-07)."""
    return rrf(channels) if name.startswith("rrf") else weighted(channels, weights)


def merge_channels(base: DataFrame, more: Mapping[str, DataFrame]) -> DataFrame:
    """Greatest score and all channels of each object (TOP-08). ``base``: object_id, score, channels array."""
    parts = [base.select("object_id", "score", "channels")] + [c.select("object_id", "score", F.array(F.lit(n)).alias("channels")) for n, c in more.items()]
    both = reduce(DataFrame.unionAll, parts)
    return both.groupBy("object_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"))


def rerank(rows: DataFrame, rules: Sequence[tuple[Column, float]], limit: int | None = None) -> DataFrame:
    """Adds the weight of every rule that holds to ``score`` (TOP-09, TOP-10)."""
    bonus = reduce(lambda a, b: a + b, (F.when(c, F.lit(float(w))).otherwise(0.0) for c, w in rules), F.lit(0.0))
    out = rows.withColumn("rerank_bonus", F.round(bonus, 6)).withColumn("score", F.round(F.col("score") + F.col("rerank_bonus"), 6))
    out = out.orderBy(F.desc("score"), "object_id")
    return out.limit(limit) if limit else out


def round_robin(pool: DataFrame, doc: str, flag: Column | None = None) -> DataFrame:
    """Documents take turns, in the order of their best item; flagged rows come first as a block (TOP-11, TOP-12).

    ``pool`` is a bounded candidate pool with object_id, score and the document.
    """
    first = F.when(flag, 0).otherwise(1) if flag is not None else F.lit(0)
    rows = pool.withColumn("block", first)
    own = Window.partitionBy("block", doc).orderBy(F.desc("score"), "object_id")
    turn = rows.withColumn("turn", F.row_number().over(own)).withColumn("best", F.first(F.struct((-F.col("score")).alias("s"), "object_id")).over(own))
    return turn.withColumn("position", F.row_number().over(Window.orderBy("block", "turn", "best"))).drop("best")


def expand_selection(pool: DataFrame, doc: str, limit: int = 30, first_docs: int = 4, per_doc: int = 2) -> DataFrame:
    """The first item of up to ``first_docs`` documents, then up to ``per_doc`` a document, then the rest, to ``limit`` (TOP-13)."""
    order = Window.orderBy(F.desc("score"), "object_id")
    rows = pool.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(doc).orderBy("rank"))).withColumn("doc_rank", F.first("rank").over(Window.partitionBy(doc).orderBy("rank")))
    rows = rows.withColumn("doc_no", F.dense_rank().over(Window.orderBy("doc_rank")))
    step = F.when((F.col("turn") == 1) & (F.col("doc_no") <= first_docs), 1).when(F.col("turn") <= per_doc, 2).otherwise(3)
    out = rows.withColumn("pass", step).withColumn("position", F.row_number().over(Window.orderBy("pass", "rank")))
    return out.where(F.col("position") <= limit).select("object_id", doc, "score", "pass", "position")


def page(pool: DataFrame, offset: int, size: int, order: Sequence[Column]) -> DataFrame:
    """A page of a stable pool with next_offset and has_more (TOP-14); only the rows up to its end are numbered."""
    rows = pool.orderBy(*order).limit(offset + size).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    total = pool.agg(F.count(F.lit(1)).alias("total"))
    out = rows.where((F.col("position") > offset) & (F.col("position") <= offset + size)).crossJoin(F.broadcast(total))
    more = F.col("total") > offset + size
    return out.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + size)))


def merge_variants(results: DataFrame) -> DataFrame:
    """Least rank, greatest score and all variants of each object (TOP-15)."""
    return results.groupBy("object_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("variant")), ",").alias("variants"))


def relax(rows: DataFrame, axes: Mapping[str, Column], doc: str, order: Sequence[Column]) -> tuple[DataFrame, str | None]:
    """Exact matches, or, if there are none, one hit a document with the first axis dropped that has any (TOP-16).

    The axes are few and their order is fixed, so the driver probes them in turn.
    """
    every = lambda names: reduce(lambda a, b: a & b, (axes[n] for n in names), F.lit(True))
    exact = rows.where(every(axes))
    if exact.limit(1).count():
        return exact.withColumn("unmet", F.lit("")), None
    for dropped in axes:
        near = rows.where(every([n for n in axes if n != dropped]))
        if near.limit(1).count():
            one = near.withColumn("rn", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where("rn = 1").drop("rn")
            return one.withColumn("unmet", F.lit(dropped)), dropped
    return exact.withColumn("unmet", F.lit("")), None


def field_scan(rows: DataFrame, row_id: str, fields: Sequence[str], terms: Sequence[str], phrase: str, boosts: Sequence[tuple[Column, float]] = ()) -> DataFrame:
    """1 per term in a field, 3 for the phrase, plus boosts; all rows if none matches (TOP-17)."""
    score = F.lit(0.0)
    for f in fields:
        low = F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))
        for t in terms:
            score = score + F.when(low.contains(t.lower()), 1.0).otherwise(0.0)
        score = score + F.when(low.contains(phrase.lower()), 3.0).otherwise(0.0)
    matched = score
    for c, w in boosts:
        score = score + F.when(c, F.lit(float(w))).otherwise(0.0)
    scored = rows.withColumn("matched", matched > 0).withColumn("score", score)
    some = scored.agg(F.coalesce(F.max(F.col("matched").cast("int")), F.lit(0)).alias("any_match"))
    return scored.crossJoin(F.broadcast(some)).where(F.col("matched") | (F.col("any_match") == 0)).drop("any_match")


def grouped_search(chunks: DataFrame, doc: str, chunk: str, per_doc: int, docs: int, budget: int, size: Column) -> DataFrame:
    """Best chunks of the best documents, within a running budget of characters (TOP-18)."""
    own = Window.partitionBy(doc).orderBy(F.desc("score"), chunk)
    best = chunks.groupBy(doc).agg(F.max("score").alias("doc_score")).orderBy(F.desc("doc_score"), doc).limit(docs)  # bounded by ``docs``
    rows = chunks.join(F.broadcast(best), doc).withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= per_doc)
    order = Window.orderBy(F.desc("doc_score"), doc, "turn")
    rows = rows.withColumn("spent", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("spent") <= budget)


def _equals(word: str):
    return lambda w: w == word


def bm25(chunks: DataFrame, chunk: str, text: Column, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``chunks`` with ``score``: BM25 of the terms, over all chunks (TOP-18).

    Words are runs of letters and digits in lower case. Counts of the terms, the
    number of chunks and their mean length are one row, which is sent to all.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    rows = chunks.withColumn("__w", words).withColumns({f"__f{i}": F.size(F.filter("__w", _equals(t))) for i, t in enumerate(wanted)})
    rows = rows.withColumn("__size", F.size("__w")).drop("__w")
    seen = [F.sum((F.col(f"__f{i}") > 0).cast("long")).alias(f"__n{i}") for i in range(len(wanted))]
    stats = rows.agg(F.count(F.lit(1)).alias("__n"), F.avg("__size").alias("__mean"), *seen)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        rarity = F.log(1 + (F.col("__n") - F.col(f"__n{i}") + 0.5) / (F.col(f"__n{i}") + 0.5))
        score = score + rarity * F.col(f"__f{i}") * (k1 + 1) / (F.col(f"__f{i}") + k1 * (1 - b + b * F.col("__size") / F.col("__mean")))
    scored = rows.crossJoin(F.broadcast(stats)).withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 6))
    return scored.select(*chunks.columns, "score")


def vocabulary(values: DataFrame, query: str) -> DataFrame:
    """Exact before related before browse, then dimension and value (TOP-22). ``values``: dimension, value."""
    low, q = F.lower("value"), query.lower()
    kind = F.when(low == q, "exact").when(low.contains(q), "related").otherwise("browse")
    rows = values.select("dimension", "value", kind.alias("kind"))
    place = F.element_at(F.create_map(F.lit("exact"), F.lit(0), F.lit("related"), F.lit(1), F.lit("browse"), F.lit(2)), F.col("kind"))
    return rows.withColumn("place", place)


def memory_relevance(memories: DataFrame, words: Sequence[str], scope: Column, confidence: Column, k: int = 8) -> DataFrame:
    """2 in scope, -1 outside, plus shared words and confidence; the best k (TOP-21). ``memories``: id, tokens."""
    shared = F.size(F.array_intersect("tokens", F.array(*map(F.lit, words))))
    score = F.when(scope, 2.0).otherwise(-1.0) + shared + confidence
    return memories.withColumn("overlap", shared).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(k)


def plan_batches(items: DataFrame, packet: str, group: str, size: str, budget: int) -> DataFrame:
    """Greedy batches under a budget, groups kept whole in order, one too large on its own (TOP-25).

    Sequential within a packet, so each packet runs as one group.
    """
    import pandas as pd

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.groupby(group, sort=True)[size].sum()
        batch, used, rows = 0, 0, []
        for g, n in sums.items():
            if used and used + n > budget:
                batch, used = batch + 1, 0
            used += n
            rows.append((pdf[packet].iloc[0], g, int(n), batch, bool(n > budget)))
        return pd.DataFrame(rows, columns=[packet, group, "size", "batch", "oversize"])

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return items.select(packet, group, size).groupBy(packet).applyInPandas(plan, f"{packet} {kinds[packet]}, {group} {kinds[group]}, size long, batch int, oversize boolean")
