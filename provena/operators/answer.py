"""From expanded evidence to what an answer may show (survey QA-12, QA-13, PRJ-37)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Citations that an answer carries.
MOST_CITATIONS = 12
#: Fixed value: publication numbers that a claim may mention.
PUBLICATION = r"(?i)\b((?:WO|US|EP|CN|JP|AU|CA)\d{6,}[A-C]\d?)\b"


def sample_catalogue(items: DataFrame) -> DataFrame:
    """Samples of each packet with handles S1, S2 ... in order of appearance (QA-12).

    ``items``: packet, position, source, doc_id, sample_id, context_id, object_id,
    facts_refs, evidence_refs, status (exact, adjacent, related, excluded or
    null), unmet (array). A sample is a source's document with the sample id, else
    the context id; rows with neither, and excluded ones, are in no sample. One
    that has an adjacent or related row is adjacent.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    field = F.when(blank("sample_id").isNotNull(), "sample_id").when(blank("context_id").isNotNull(), "context_id")
    rows = items.where("status IS NULL OR status != 'excluded'").withColumn("field", field).where("field IS NOT NULL")
    rows = rows.withColumn("sample", F.coalesce(blank("sample_id"), blank("context_id")))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    groups = rows.groupBy("packet", "source", "doc_id", "field", "sample").agg(
        F.min("position").alias("first"), F.array_sort(F.collect_set("object_id")).alias("object_ids"), flat("facts_refs").alias("facts_refs"), flat("evidence_refs").alias("evidence_refs"),
        F.max(F.coalesce(F.col("status").isin("adjacent", "related"), F.lit(False))).alias("near"), flat("unmet").alias("unmet"),
    )
    number = F.row_number().over(Window.partitionBy("packet").orderBy("first", "source", "doc_id", "field", "sample"))
    return groups.select(
        "packet", F.concat(F.lit("S"), number.cast("string")).alias("handle"), "source", "doc_id", "field", "sample", "object_ids", "facts_refs", "evidence_refs",
        F.when(F.col("near"), "adjacent").otherwise("expanded").alias("match_scope"), "unmet",
    )


def validate_selection(catalogue: DataFrame, claims: DataFrame, limit: int) -> DataFrame:
    """packet and the first rule that its claims break, null if none (QA-12).

    ``claims``: packet, handle, text, facts_refs, evidence_refs. Exactly
    min(limit, samples) different samples must be shown; every claim has a text and
    evidence, refers to its own sample only and names no other publication.
    """
    shown = claims.join(catalogue.select("packet", "handle", "doc_id", F.col("facts_refs").alias("own_facts"), F.col("evidence_refs").alias("own_evidence")), ["packet", "handle"], "left")
    none = F.array().cast("array<string>")
    strangers = lambda a, b: F.size(F.array_except(F.coalesce(a, none), F.coalesce(b, none))) > 0
    own = F.upper(F.coalesce("doc_id", F.lit("")))
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PUBLICATION), F.lit(1))
    rule = lambda place, problem: F.struct(F.lit(place).alias("place"), F.lit(problem).alias("problem"))
    broken = (
        F.when(F.col("doc_id").isNull(), rule(1, "answer_sample_identity"))
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", rule(3, "answer_empty_claim"))
        .when(strangers(F.col("facts_refs"), F.col("own_facts")) | strangers(F.col("evidence_refs"), F.col("own_evidence")), rule(4, "answer_unbound_reference"))
        .when(F.size(F.coalesce("evidence_refs", none)) == 0, rule(5, "answer_missing_evidence"))
        .when(F.exists(named, lambda d: ~F.endswith(own, F.upper(d))), rule(6, "answer_cross_patent_claim"))
    )
    found = shown.groupBy("packet").agg(F.min(broken).alias("broken"), F.countDistinct("handle").alias("shown"))
    have = catalogue.groupBy("packet").agg(F.count(F.lit(1)).alias("samples"))
    both = have.join(found, "packet", "full")
    off = F.coalesce("shown", F.lit(0)) != F.least(F.coalesce("samples", F.lit(0)), F.lit(limit))
    counted = F.when(off, rule(2, "answer_display_count"))
    return both.select("packet", F.least("broken", counted)["problem"].alias("problem"))


def aggregate_lines(groups: DataFrame, dims: Sequence[str], unit: str, total: int, coverage: Sequence[tuple[str, int]] = (), has_more: bool = False) -> DataFrame:
    """(line, text) of an aggregate's answer: headline, coverage, a table of the groups, what is missing (QA-13).

    ``groups``: the dimensions and ``count``, a bounded page of buckets. Bars in
    values are escaped; null reads as ``(not given)``.
    """
    spark = groups.sparkSession
    head = [f"{total} {unit} match the filters."] + [f"{name}: {n}." for name, n in coverage]
    head += ["Groups may overlap, so their counts do not add up.", "| " + " | ".join([*dims, f"count ({unit})"]) + " |", "|" + " --- |" * (len(dims) + 1)]
    tail = ["More groups were not returned."] if has_more else []
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("(not given)")), r"[|\r\n]", " ")
    order = Window.orderBy(F.desc("count"), *dims)  # a bounded page
    body = groups.select((F.row_number().over(order) + len(head)).alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, dims), F.col("count").cast("string")), F.lit(" |")).alias("text"))
    fixed = [(k, t) for k, t in enumerate(head, 1)] + [((1 << 30) + k, t) for k, t in enumerate(tail)]
    return spark.createDataFrame(fixed, "line int, text string").unionByName(body)


def citations(observations: DataFrame, most: int = MOST_CITATIONS) -> DataFrame:
    """The first quotes of each packet, from verified expansions, aggregate examples and field scans (PRJ-37).

    ``observations``: packet, position, tool, status, gate, items (array of doc_id,
    object_id, quotes: array of page, quote).
    """
    usable = (F.col("tool") == "expand") & (F.col("status") == "ok") & (F.col("gate") == "verified") | F.col("tool").isin("aggregate", "field_scan")
    rows = observations.where(usable).select("packet", "position", F.posexplode("items").alias("item_no", "item"))
    rows = rows.select("packet", "position", "item_no", "item.doc_id", "item.object_id", F.posexplode("item.quotes").alias("quote_no", "q"))
    number = F.row_number().over(Window.partitionBy("packet").orderBy("position", "item_no", "quote_no"))
    return rows.withColumn("number", number).where(F.col("number") <= most).select("packet", "number", "doc_id", "object_id", "q.page", "q.quote")
