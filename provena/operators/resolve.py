"""Id resolution, expansion and alias joins (survey JOIN, GRF)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.text import tokens


#: A dictionary of so many aliases is small enough to be sent to all tasks.
FEW_ALIASES = 100_000


def closure(edges: DataFrame, facts: DataFrame, on: Sequence[str], fact_id: str, context: str, most: int) -> DataFrame:
    """Facts of each edge row with how they were found: by id, by source link, else by context up to ``most`` (JOIN-01 to JOIN-03, JOIN-07).

    ``edges``: object_id, the document columns of ``on``, fact_ids array, context.
    ``facts``: the same document columns, fact_id, source_object, context.
    """
    direct = edges.select("object_id", *on, F.explode("fact_ids").alias(fact_id)).join(facts, [*on, fact_id]).select("object_id", *on, fact_id, F.lit(1).alias("order"), F.lit("direct").alias("match_mode"))
    linked = edges.select("object_id", *on).join(facts.where("source_object IS NOT NULL"), [*on]).where(F.col("object_id") == F.col("source_object"))
    linked = linked.select("object_id", *on, fact_id, F.lit(2).alias("order"), F.lit("source_link").alias("match_mode"))
    both = direct.unionAll(linked)
    bare = edges.join(both.select("object_id").distinct(), "object_id", "left_anti")
    # no edge takes more than the first ``most`` facts of a context, so a common context is cut before the join
    first = facts.withColumn("rn", F.row_number().over(Window.partitionBy(*on, context).orderBy(fact_id))).where(F.col("rn") <= most).drop("rn")
    by_context = bare.select("object_id", *on, context).join(first, [*on, context])
    by_context = by_context.withColumn("rn", F.row_number().over(Window.partitionBy("object_id").orderBy(fact_id, *on))).where(F.col("rn") <= most)
    every = both.unionAll(by_context.select("object_id", *on, fact_id, F.lit(3).alias("order"), F.lit("context").alias("match_mode")))
    return every.groupBy("object_id", *on, fact_id).agg(F.min(F.struct("order", "match_mode"))["match_mode"].alias("match_mode"))


def unresolved(refs: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """References that nothing answers (JOIN-04, SET-11)."""
    return refs.join(known.select(*on).distinct(), list(on), "left_anti")


def resolve_alias(texts: DataFrame, text: str, must: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Canonical id of a text: must-merge, else its most confident alias, else the node of that name or id (JOIN-13).

    ``must``: alias_text, canonical_id. ``aliases``: also confidence. ``nodes``: canonical_id, name.
    """
    key = F.lower(F.trim(F.col(text)))
    best = aliases.select(F.lower("alias_text").alias("__k"), "canonical_id", "confidence")
    best = best.groupBy("__k").agg(F.max_by("canonical_id", F.struct(F.coalesce("confidence", F.lit(-1.0)), "canonical_id")).alias("__alias"))
    first = must.groupBy(F.lower("alias_text").alias("__k")).agg(F.min("canonical_id").alias("__must"))
    named = nodes.select(F.lower("name").alias("__k"), "canonical_id").unionAll(nodes.select(F.lower("canonical_id").alias("__k"), "canonical_id"))
    named = named.groupBy("__k").agg(F.min("canonical_id").alias("__node"))
    rows = texts.withColumn("__k", key)
    for side in (first, best, named):
        rows = rows.join(side, "__k", "left")
    source = F.when(F.col("__must").isNotNull(), "must_merge").when(F.col("__alias").isNotNull(), "alias").when(F.col("__node").isNotNull(), "node").otherwise("none")
    return rows.withColumn("canonical_id", F.coalesce("__must", "__alias", "__node")).withColumn("resolved_by", source).drop("__k", "__must", "__alias", "__node")


def _run_at(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def mentions(texts: DataFrame, row_id: str, text: str, aliases: DataFrame) -> DataFrame:
    """Aliases in a text as whole words, longest first, one row per canonical id (JOIN-16).

    Runs of as many words as an alias has are joined with the aliases by equality,
    so no text meets every alias; the driver sees the lengths that occur. Up to
    FEW_ALIASES aliases are sent to the runs, so that only those that match are
    shuffled; more are joined by sort and merge. ``aliases``: alias_text, canonical_id.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = texts.select(row_id, words(text).alias("w"))
    sizes = aliases.select(F.size(words("alias_text")).alias("n")).where("n > 0").distinct()
    none = F.array().cast("array<string>")
    grams = []
    for n in sorted(r.n for r in sizes.collect()) or [1]:
        # repeated runs are left in: the aliases sift them sooner than a set of all runs would
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        grams.append(F.when(F.size("w") >= n, F.transform(at, _run_at(n)) if n > 1 else F.col("w")).otherwise(none))
    known = aliases.select(F.lower("alias_text").alias("run"), "canonical_id").distinct()
    if known.limit(FEW_ALIASES + 1).count() <= FEW_ALIASES:
        known = F.broadcast(known)
    found = rows.select(row_id, F.explode(F.concat(*grams)).alias("run")).join(known, "run")
    longest = F.min(F.struct((-F.length("run")).alias("n"), "run"))
    return found.groupBy(row_id, "canonical_id").agg(longest["run"].alias("alias_text"))


def bind(cohort: DataFrame, rows: DataFrame, exact: str, legacy: Sequence[str]) -> DataFrame:
    """Bind cohort members to rows by exact id, else by a legacy key that only one row has (JOIN-09)."""
    hit = cohort.join(rows.select(exact, F.lit("exact").alias("bound_by")), exact)
    rest = cohort.join(rows.select(exact), exact, "left_anti")
    unique = rows.groupBy(*legacy).agg(F.count(F.lit(1)).alias("n"), F.min(exact).alias("row_id")).where("n = 1")
    old = rest.join(unique, list(legacy)).select(*cohort.columns, F.col("row_id"), F.lit("legacy").alias("bound_by"))
    return hit.select(*cohort.columns, F.col(exact).alias("row_id"), "bound_by").unionAll(old)


def any_of(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """An OR-join as a union of equi-joins, each pair once (JOIN-11)."""
    parts = [left.select(F.col(left_id), F.col(a).alias("__k")).join(right.select(F.col(right_id), F.col(b).alias("__k")), "__k").select(left_id, right_id) for a, b in keys]
    return reduce(DataFrame.unionAll, parts).distinct()


def comparison_pairs(facts: DataFrame, fact_id: str, scope: Sequence[str], positive: Column, negative: Column) -> DataFrame:
    """Positive facts with the baseline of their scope, where it has exactly one (JOIN-18, GRF-02)."""
    base = facts.where(negative).groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.min(fact_id).alias("baseline_id")).where("n = 1").drop("n")
    return facts.where(positive).join(base, list(scope)).select(*scope, fact_id, "baseline_id")


def inherit(rows: DataFrame, key: str, candidates: Sequence[tuple[str, DataFrame, str, float]]) -> DataFrame:
    """First value among candidates in order of precedence, its source and capped confidence (JOIN-19).

    Each candidate: name, frame (key column, value, confidence), key column, cap.
    """
    out = rows
    for i, (_, frame, on, _) in enumerate(candidates):
        out = out.join(frame.select(F.col(on).alias(f"__k{i}"), F.col("value").alias(f"__v{i}"), F.col("confidence").alias(f"__c{i}")), F.col(on) == F.col(f"__k{i}"), "left")
    pick = lambda f: F.coalesce(*(F.when(F.col(f"__v{i}").isNotNull(), f(i)) for i in range(len(candidates))))
    out = out.withColumn("value", pick(lambda i: F.col(f"__v{i}"))).withColumn("source", pick(lambda i: F.lit(candidates[i][0])))
    out = out.withColumn("confidence", pick(lambda i: F.least(F.col(f"__c{i}"), F.lit(candidates[i][3]))))
    return out.drop(*(f"__{x}{i}" for x in "kvc" for i in range(len(candidates))))


def repair_missing(rows: DataFrame, row_id: str, doc: str, refs: DataFrame) -> DataFrame:
    """Fill a missing document from references that agree on one (JOIN-20). ``refs``: row_id, doc."""
    only = refs.groupBy(row_id).agg(F.min(doc).alias("__d"), F.countDistinct(doc).alias("__n"))
    out = rows.join(only, row_id, "left")
    fixed = F.when(F.col(doc).isNotNull(), F.col(doc)).when(F.col("__n") == 1, F.col("__d"))
    state = F.when(F.col(doc).isNotNull(), "kept").when(F.col("__n") == 1, "repaired").when(F.col("__n") > 1, "conflict").otherwise("missing")
    return out.withColumn("state", state).withColumn(doc, fixed).drop("__d", "__n")


def project_axes(profile: DataFrame, rules: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Axis values by exact rules, and the profile values without a rule (JOIN-21)."""
    return profile.join(rules, list(on)), profile.join(rules.select(*on).distinct(), list(on), "left_anti")


def one_hop(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges at a seed with the node at the other end (GRF-05, JOIN-23). ``seeds``: node."""
    out = edges.join(seeds.withColumnRenamed("node", src), src).select(F.col(src).alias("node"), F.col(dst).alias("other"), "edge_type", F.lit("out").alias("direction"))
    back = edges.join(seeds.withColumnRenamed("node", dst), dst).select(F.col(dst).alias("node"), F.col(src).alias("other"), "edge_type", F.lit("in").alias("direction"))
    return out.unionAll(back)


def token_recall(nodes: DataFrame, node_id: str, name: Column, text: Column, question: str, k: int = 10) -> DataFrame:
    """The k nodes that share most words with a question, a name it holds counting two more (GRF-05)."""
    asked = F.array(*map(F.lit, sorted(set(re.findall(r"\w{2,}", question.lower())))))
    shared = F.size(F.array_intersect(tokens(text), asked))
    score = shared + F.when(F.contains(F.lit(question.lower()), F.lower(name)), 2).otherwise(0)
    return nodes.select(F.col(node_id).alias("node"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "node").limit(k)


def edges_of(rows: DataFrame, edge_type: str, src: Column, dst: Column) -> DataFrame:
    """Edges with ids from the SHA-1 of type and ends (GRF-01)."""
    flat = rows.select(src.alias("src"), F.lit(edge_type).alias("edge_type"), dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return flat.withColumn("edge_id", F.concat(F.lit("EDGE_"), F.substring(F.sha1(F.concat_ws("|", "edge_type", "src", "dst").cast("binary")), 1, 16)))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which (GRF-03). ``nodes``: node."""
    known = nodes.select("node").distinct()
    lost = [edges.join(known.withColumnRenamed("node", side), side, "left_anti").withColumn("missing", F.lit(side)) for side in ("src", "dst")]
    return lost[0].unionByName(lost[1])
