"""Retrieval quality (survey AGG-20 to AGG-22, TOP-19, TOP-20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20)


def target_ranks(results: DataFrame, targets: DataFrame, on: Sequence[str] = ("query_id", "object_id")) -> DataFrame:
    """Least rank of an acceptable object for each target; null if not found.

    ``results``: query_id, object_id, rank. ``targets``: target_id, query_id, target_type, object_id (one row per acceptable object).
    Objects that are acceptable by what they are need no row each: ``on`` names columns that both sides have instead.
    """
    hits = targets.join(results.select(*on, "rank"), list(on)).groupBy("target_id").agg(F.min("rank").alias("rank"))
    return targets.select("target_id", "query_id", "target_type").distinct().join(hits, "target_id", "left")


def recall_mrr(ranks: DataFrame, by: Sequence[str] = ("target_type",), cuts: Sequence[int] = CUTS) -> DataFrame:
    """Recall at each cut and mean reciprocal rank: overall, then by each column of ``by``."""
    measures = [F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in cuts), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr")]
    out = ranks.agg(*measures).select(F.lit("overall").alias("slice"), F.lit("all").alias("value"), "*")
    for c in by:
        out = out.unionByName(ranks.groupBy(F.col(c).cast("string").alias("value")).agg(*measures).select(F.lit(c).alias("slice"), "*"))
    return out


def confusion(results: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """Share of queries and of results within k that hit a hard negative (AGG-21). ``negatives``: query_id, object_id."""
    top = results.where(F.col("rank") <= k).join(negatives.select("query_id", "object_id", F.lit(1).alias("bad")).distinct(), ["query_id", "object_id"], "left")
    q = top.groupBy("query_id").agg(F.max(F.coalesce("bad", F.lit(0))).alias("hit"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.count(F.lit(1)).alias("n"))
    return q.agg(F.round(F.avg("hit"), 4).alias("query_rate"), F.round(F.sum("bad") / F.sum("n"), 4).alias("result_rate"), F.count(F.lit(1)).alias("queries"))


def rank_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """improved / regressed / unchanged / still_missing per target (TOP-19). Both: target_id, rank."""
    both = before.select("target_id", F.col("rank").alias("old")).join(after.select("target_id", F.col("rank").alias("new")), "target_id", "full_outer")
    lost = lambda c: F.coalesce(F.col(c), F.lit(1 << 30))
    state = F.when(F.col("old").isNull() & F.col("new").isNull(), "still_missing").when(lost("new") < lost("old"), "improved").when(lost("new") > lost("old"), "regressed").otherwise("unchanged")
    return both.withColumn("state", state)


def failures(ranks: DataFrame, results: DataFrame, most: int, show: int = 5) -> DataFrame:
    """Targets not found within ``most``, with what was found instead (TOP-20)."""
    missed = ranks.where(F.col("rank").isNull() | (F.col("rank") > most))
    top = results.where(F.col("rank") <= show).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "object_id"))), lambda x: x["object_id"].cast("string")), ",").alias("top"))
    return missed.join(top, "query_id", "left")


def best_config(metrics: DataFrame) -> DataFrame:
    """Greatest (mrr, recall_1, recall_3, less confusion), then name (AGG-22)."""
    return metrics.orderBy(F.desc("mrr"), F.desc("recall_1"), F.desc("recall_3"), "confusion", "config").limit(1)
