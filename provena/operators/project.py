"""Facts to contexts, field values and wide tables (survey AGG-12 to AGG-16, AGG-23, AGG-28, AGG-29)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.85


def context_rollup(facts: DataFrame, context: str, polarity: Column, confidence: Column, sets: Mapping[str, Column]) -> DataFrame:
    """Per context: facts, polarity histogram, confidence and sorted distinct values (AGG-12)."""
    named = lambda p: F.count(F.when(polarity == p, 1)).alias(f"n_{p}")
    return facts.groupBy(context).agg(
        F.count(F.lit(1)).alias("n_facts"), named("positive"), named("negative"), named("unknown"),
        F.round(F.avg(confidence), 3).alias("confidence_mean"), F.min(confidence).alias("confidence_min"), F.count(F.when(confidence < LOW_CONFIDENCE, 1)).alias("n_low"),
        *(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for n, c in sets.items()),
    )


def field_records(facts: DataFrame, context: str, fact: str, evidence: str, fields: Mapping[str, Column], source: Column) -> DataFrame:
    """Values of each field of a context with facts, evidence, sources, confidence and place by facts (AGG-12, AGG-14).

    ``fields`` are arrays; null, blank and unknown values are left out. Facts and evidence are counted
    distinct and never gathered, so a context may hold any number of them.
    """
    pairs = [F.transform(F.coalesce(v, F.array().cast("array<string>")), _in_field(n)) for n, v in fields.items()]
    rows = facts.select(context, fact, evidence, source.alias("source"), F.explode(F.concat(*pairs)).alias("pair")).select(context, "pair.*", fact, evidence, "source")
    rows = rows.where("value IS NOT NULL AND value NOT IN ('', 'unknown')")
    got = rows.groupBy(context, "field", "value").agg(
        F.countDistinct(fact).alias("fact_count"), F.countDistinct(evidence).alias("evidence_count"),
        F.coalesce(F.max(F.col("source") == "fact_explicit"), F.lit(False)).alias("explicit"), F.coalesce(F.max(F.col("source").startswith("doc_profile")), F.lit(False)).alias("profile"),
    )
    sure = field_confidence(F.col("fact_count"), F.col("evidence_count"), F.col("explicit"), F.col("profile"))
    order = Window.partitionBy(context, "field").orderBy(F.desc("fact_count"), "value")
    return got.withColumn("confidence", sure).withColumn("place", F.row_number().over(order))


def context_quality(facts: DataFrame, context: str, fact: str, evidence: str, confidence: Column, binding: Column, status: Column, records: DataFrame, primary: Sequence[str]) -> DataFrame:
    """Counts, confidences, resolution status, conflicting fields and unambiguous primary values of each context (AGG-12, AGG-13).

    ``records`` are those of ``field_records``; a context without any has no conflicts.
    """
    known = F.when(status != "", status)
    got = facts.groupBy(context).agg(
        F.countDistinct(fact).alias("fact_count"), F.countDistinct(evidence).alias("evidence_count"),
        F.round(F.avg(confidence), 3).alias("mean_confidence"), F.round(F.min(confidence), 3).alias("min_confidence"), F.count(F.when(confidence < LOW_CONFIDENCE, 1)).alias("n_low"),
        F.round(F.avg(binding), 3).alias("mean_binding"), F.round(F.min(binding), 3).alias("min_binding"),
        F.when(F.min(known) == F.max(known), F.min(known)).when(F.min(known).isNotNull(), "mixed").alias("resolution_status"),
    )
    at = lambda f, k: F.max(F.when((F.col("field") == f) & (F.col("place") == k), F.col("fact_count")))
    first = lambda f: F.max(F.when((F.col("field") == f) & (F.col("place") == 1), F.col("value")))
    sure = lambda f: at(f, 2).isNull() | (at(f, 1) >= F.greatest(F.lit(2), at(f, 2) * 2))
    several = F.collect_set(F.when(F.col("place") == 2, F.col("field")))  # no more than there are fields
    more = records.groupBy(context).agg(F.array_join(F.array_sort(several), ",").alias("conflicts"), F.size(several).alias("conflict_count"), *(F.when(sure(f), first(f)).alias(f"primary_{f}") for f in primary))
    return got.join(more, context, "left").withColumns({"conflicts": F.coalesce("conflicts", F.lit("")), "conflict_count": F.coalesce("conflict_count", F.lit(0))})


def _in_field(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def primary_values(values: DataFrame, context: str, value: str, n: str) -> DataFrame:
    """The top value where it stands alone or has at least max(2, twice the second) facts (AGG-13)."""
    w = Window.partitionBy(context).orderBy(F.desc(n), value)
    rows = values.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead(n).over(w))
    sure = F.col("second").isNull() | (F.col(n) >= F.greatest(F.lit(2), F.col("second") * 2))
    return rows.where("place = 1").select(context, F.when(sure, F.col(value)).alias("primary_value"), F.col(value).alias("top_value"), F.col(n).alias("top_count"), "second")


def field_confidence(facts: Column, evidence: Column, explicit: Column, profile: Column) -> Column:
    """Confidence of a field value from its support (AGG-14)."""
    score = 0.55 + F.least(F.lit(0.25), 0.05 * facts) + F.least(F.lit(0.15), 0.05 * evidence) + F.when(explicit, 0.05).otherwise(0.0)
    score = F.when(profile, F.least(score, F.lit(0.80))).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), score)), 3)


def kind_consensus(rows: DataFrame, context: str, kind: Column) -> DataFrame:
    """The one known kind, else ambiguous, else unknown (AGG-15)."""
    known = F.when(~kind.isin("unknown", ""), kind)
    got = rows.groupBy(context).agg(F.countDistinct(known).alias("kinds"), F.min(known).alias("one"))
    return got.select(context, F.when(F.col("kinds") == 1, F.col("one")).when(F.col("kinds") > 1, "ambiguous").otherwise("unknown").alias("example_kind"), (F.col("kinds") > 1).alias("conflict"))


def coverage_summary(rows: DataFrame, context: str, pct: Column, basis: Column) -> DataFrame:
    """Least known coverage (shares as percent), how many lack it, and the bases (AGG-16)."""
    value = F.when(pct <= 1.0, pct * 100.0).otherwise(pct)
    return rows.groupBy(context).agg(F.round(F.min(value), 3).alias("min_coverage"), F.count(F.when(pct.isNull(), 1)).alias("n_missing"), F.array_join(F.array_sort(F.collect_set(basis)), ",").alias("bases"))


def dominant_polarity(rows: DataFrame, context: str, polarity: Column) -> DataFrame:
    """The commonest known polarity, conflict if there are several (AGG-29)."""
    n = rows.select(context, polarity.alias("p")).where("p IN ('positive', 'negative')").groupBy(context, "p").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(context).agg(F.min(F.struct((-F.col("n")).alias("m"), "p"))["p"].alias("dominant"), (F.count(F.lit(1)) > 1).alias("conflict"))
    return rows.select(context).distinct().join(best, context, "left").select(context, F.coalesce("dominant", F.lit("unknown")).alias("dominant"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def merge_queue(rows: DataFrame, proposed: str, unit: str, confidence: str, most: int = 20) -> DataFrame:
    """Proposed ids: occurrences, the most confident unit, and some of their units (AGG-23)."""
    return rows.groupBy(proposed).agg(
        F.count(F.lit(1)).alias("occurrences"), F.max(F.struct(F.col(confidence), F.col(unit)))[unit].alias("best_unit"),
        F.array_join(F.slice(F.array_sort(F.collect_set(unit)), 1, most), ",").alias("units"),
    ).orderBy(F.desc("occurrences"), proposed)


def wide(rows: DataFrame, context: str, bucket: str, buckets: Sequence[str], cell: Column, prefix: str = "") -> DataFrame:
    """One row a context, a column a bucket of its distinct cells in order (AGG-28)."""
    got = rows.select(context, bucket, cell.alias("cell")).groupBy(context).pivot(bucket, list(buckets)).agg(F.array_join(F.array_sort(F.collect_set("cell")), "; "))
    return got.select(context, *(F.coalesce(F.col(f"`{b}`"), F.lit("")).alias(prefix + b.lower().replace(" ", "_")) for b in buckets))


def _as_role(role: str):
    return lambda v: F.struct(F.lit(role).alias("role"), v.alias("name"))


def unify_materials(rows: DataFrame, key: str, slots: Mapping[str, Column]) -> DataFrame:
    """One row a material with its role, from all role slots (PRJ-33)."""
    parts = [F.transform(F.coalesce(c, F.array().cast("array<string>")), _as_role(r)) for r, c in slots.items()]
    return rows.select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.role", "m.name").where("name IS NOT NULL AND trim(name) != ''").distinct()
