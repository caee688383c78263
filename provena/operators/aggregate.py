"""Identity-aware aggregates (survey AGG-01 to AGG-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_EXAMPLES = 8


def identity_counts(rows: DataFrame, **identities: Sequence[str | Column]) -> DataFrame:
    """One row: distinct identities of each kind; an identity with a null part is none."""
    return rows.agg(*(F.countDistinct(*cols).alias(name) for name, cols in identities.items()))


def distinct_values(rows: DataFrame, value: Column, doc: Column, limit: int | None = None, canonical: Column | None = None) -> DataFrame:
    """Buckets by lower-cased value: its documents, the least label, and how many buckets there are before the limit.

    Ordered by falling count, then value.
    """
    keys = [F.lower(value).alias("value")] + ([F.lower(canonical).alias("canonical_id")] if canonical is not None else [])
    buckets = rows.select(*keys, value.alias("label"), doc.alias("doc")).where(F.col("value").isNotNull())
    out = buckets.groupBy("value", *(["canonical_id"] if canonical is not None else [])).agg(F.countDistinct("doc").alias("doc_count"), F.min("label").alias("label"))
    total = out.agg(F.count(F.lit(1)).alias("group_count"))
    out = out.crossJoin(F.broadcast(total))  # one row
    out = out.orderBy(F.desc("doc_count"), "value", *(["canonical_id"] if canonical is not None else []))
    return out.limit(limit) if limit else out


def composite_counts(rows: DataFrame, doc: str, dims: Sequence[str], limit: int | None = None) -> DataFrame:
    """Documents per combination of one to three document dimensions, with the membership total.

    A dimension may be an array, whose combinations all count; missing becomes ``unknown_<dim>``.
    """
    if not 1 <= len(dims) <= 3:
        raise ValueError("one to three dimensions")
    flat = rows.select(doc, *dims)
    for d in dims:
        if flat.schema[d].dataType.typeName() == "array":
            flat = flat.withColumn(d, F.explode_outer(d))
        flat = flat.withColumn(d, F.coalesce(F.nullif(F.trim(F.col(d).cast("string")), F.lit("")), F.lit(f"unknown_{d}")))
    out = flat.groupBy(*dims).agg(F.countDistinct(doc).alias("doc_count"))
    total = out.agg(F.sum("doc_count").alias("membership"), F.count(F.lit(1)).alias("group_count"))
    out = out.crossJoin(F.broadcast(total)).orderBy(F.desc("doc_count"), *dims)
    return out.limit(limit) if limit else out


def numeric_distribution(rows: DataFrame, unit: Column, value: Column, doc: Column, owner: Column) -> DataFrame:
    """Per unit: values, documents, owners, least, greatest and mean."""
    return rows.groupBy(F.coalesce(unit, F.lit("unspecified")).alias("unit")).agg(
        F.count(value).alias("n"), F.countDistinct(doc).alias("doc_count"), F.countDistinct(owner).alias("owner_count"),
        F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean"),
    )


def vote(rows: DataFrame, doc: str, category: Column, weight: Column) -> DataFrame:
    """The category of each document with the greatest sum of weights; ties by name."""
    scores = rows.select(doc, category.alias("category"), weight.alias("w")).where(F.col("category").isNotNull()).groupBy(doc, "category").agg(F.sum("w").alias("score"))
    best = scores.groupBy(doc).agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    return best.select(doc, F.col("b.category").alias("category"), (-F.col("b.s")).alias("score"))


def share_of(votes: DataFrame, doc: str, unknown: str = "unknown") -> DataFrame:
    """Documents per category, as percent of all and of the classified."""
    counts = votes.groupBy("category").agg(F.countDistinct(doc).alias("doc_count"))
    total = counts.agg(F.sum("doc_count").alias("every"), F.sum(F.when(F.col("category") != unknown, F.col("doc_count"))).alias("classified"))
    joined = counts.crossJoin(F.broadcast(total))
    return joined.select(
        "category", "doc_count", F.round(F.col("doc_count") * 100.0 / F.col("every"), 2).alias("pct_all"),
        F.when(F.col("category") != unknown, F.round(F.col("doc_count") * 100.0 / F.col("classified"), 2)).alias("pct_classified"),
    )


def bounded_examples(rows: DataFrame, bucket: str, doc: str, order: Sequence[str], most: int = MOST_EXAMPLES) -> DataFrame:
    """Up to ``most`` rows a bucket, one a document: each document's first row by ``order``, documents in the order of those rows."""
    first = rows.groupBy(bucket, doc).agg(F.min(F.struct(*order)).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy("first", doc)))  # WindowGroupLimit prunes before the shuffle
    return ranked.where(F.col("rank") <= most).select(bucket, doc, *(F.col(f"first.{c}").alias(c) for c in order if c != doc), "rank")


def coverage(rows: DataFrame, mapped: Column, has_source: Column, has_profile: Column, ambiguous: Column) -> DataFrame:
    """Rows per state of a classification axis, and whether it is complete."""
    state = F.when(ambiguous, "ambiguous").when(~has_profile, "missing_profile").when(~has_source, "missing_source").when(mapped, "mapped").otherwise("unclassified")
    out = rows.select(state.alias("state"))
    names = ("mapped", "missing_profile", "missing_source", "ambiguous", "unclassified")
    counts = out.agg(*(F.count(F.when(F.col("state") == n, 1)).alias(n) for n in names), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("complete", F.col("mapped") == F.col("total"))
