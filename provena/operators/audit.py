"""Graph and pack quality (survey AGG-17 to AGG-19, AGG-27, AGG-30, QA)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-blank values per column, as rows (AGG-19)."""
    got = rows.agg(*(F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c) for c in columns), F.count(F.lit(1)).alias("__total"))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return got.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, filled)", "__total AS total")


def trace_rate(facts: DataFrame, fact: str, refs: str, known: DataFrame, ref: str) -> DataFrame:
    """Share of facts all of whose references exist; 1 where there are none (AGG-18)."""
    wanted = facts.select(fact, F.explode_outer(refs).alias("r")).where("r IS NOT NULL")
    broken = wanted.join(known.select(F.col(ref).alias("r")).distinct(), "r", "left_anti").select(fact).distinct().withColumn("bad", F.lit(1))
    both = facts.select(fact).join(broken, fact, "left")
    return both.agg(F.count(F.lit(1)).alias("facts"), F.count("bad").alias("broken")).withColumn("rate", F.when(F.col("facts") == 0, 1.0).otherwise(F.round((F.col("facts") - F.col("broken")) / F.col("facts"), 4)))


def qa_summary(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each named check, as (check, n, ok) (AGG-17, QA-04)."""
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check"), "n", (F.col("n") == 0).alias("ok")) for k, d in counts.items()]
    return reduce(DataFrame.unionAll, parts)


def kg_summary(facts: DataFrame, edges: DataFrame, nodes: DataFrame, conflicts: DataFrame, status: str, proposed: Column, missing_refs: DataFrame) -> DataFrame:
    """(section, name, value): dangling edges by type, the histogram of a validation status, the rate of proposed ids, conflicts and missing references (AGG-17)."""
    row = lambda section, name, value: (F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    known = nodes.select("node").distinct()
    lost = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti")
    every = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("all")).join(lost.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")), "edge_type", "left")
    n = F.count(F.lit(1))
    parts = [
        every.select(*row("dangling", F.col("edge_type"), F.coalesce("n", F.lit(0)))),
        facts.groupBy(F.coalesce(status, F.lit("(none)")).alias("s")).agg(n.alias("n")).select(*row("validation", F.col("s"), F.col("n"))),
        facts.agg(F.round(F.coalesce(F.avg(proposed.cast("double")), F.lit(0.0)), 4).alias("rate")).select(*row("proposed", F.lit("rate"), F.col("rate"))),
        conflicts.agg(n.alias("n")).select(*row("conflicts", F.lit("all"), F.col("n"))),
        missing_refs.agg(n.alias("n")).select(*row("missing_refs", F.lit("all"), F.col("n"))),
    ]
    return reduce(DataFrame.unionAll, parts)


def budgeted_distinct(rows: DataFrame, key: str, most_rows: int | None = None) -> DataFrame:
    """One row: exact distinct values, rows read, and whether all were (AGG-25).

    Beyond ``most_rows`` the count is a lower bound over the rows read, and says so.
    """
    read = rows.select(key) if most_rows is None else rows.select(key).limit(most_rows + 1)
    got = read.agg(F.count(F.lit(1)).alias("rows_read"), F.countDistinct(key).alias("n"))
    if most_rows is None:
        return got.select("n", "rows_read", F.lit("complete").alias("state"))
    over = F.col("rows_read") > most_rows
    return got.select("n", F.least("rows_read", F.lit(most_rows)).alias("rows_read"), F.when(over, "incomplete").otherwise("complete").alias("state"))


def categorise(rows: DataFrame, text: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows per first pattern that matches, with their share (AGG-27)."""
    kind = F.when(text.isNull() | (F.trim(text) == ""), "blank")
    for name, pattern in rules:
        kind = kind.when(text.rlike(pattern), name)
    got = rows.select(kind.otherwise("other").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("total")))).select("category", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


def gate(rows: DataFrame, issues: Mapping[str, Column], fatal: Sequence[str]) -> DataFrame:
    """Names of the issues of each row and ok / warning / error (QA-01, FLT-18)."""
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in issues.items())), lambda x: x.isNotNull())
    bad = reduce(lambda a, b: a | b, (issues[n] for n in fatal), F.lit(False))
    return rows.withColumn("issues", F.array_join(found, ",")).withColumn("status", F.when(bad, "error").when(F.size(found) > 0, "warning").otherwise("ok"))


def receipt(rows: DataFrame, by: str, verified: Column, sample: Column) -> DataFrame:
    """Input rows, verified rows and distinct samples (AGG-30, QA-06)."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_input"), F.count(F.when(verified, 1)).alias("n_verified"), F.countDistinct(F.when(verified, sample)).alias("n_samples"))


def reference_conflicts(rows: DataFrame, ref: str, body: Column) -> DataFrame:
    """References with several contents (QA-08)."""
    return rows.groupBy(ref).agg(F.countDistinct(F.md5(body.cast("binary"))).alias("contents"), F.count(F.lit(1)).alias("n")).where("contents > 1")


def remap(rows: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """A mapped column beside the raw one, always from the raw one, so again gives the same (QA-09)."""
    raw = f"{column}_raw"
    src = F.col(raw) if raw in rows.columns else F.col(column)
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return rows.withColumn(raw, src).withColumn(column, F.coalesce(F.element_at(F.create_map(*pairs), F.col(raw)), F.col(raw)))


def inventory_differences(candidate: DataFrame, live: DataFrame, name: str, body: str) -> DataFrame:
    """Names whose contents differ between two inventories or that one of them lacks (QA-11).

    ``newlines_only`` is set where both agree but for CR LF against LF. Digests,
    not bodies, meet in the join; a null body is empty. Names are unique.
    """

    def digests(rows: DataFrame, side: str) -> DataFrame:
        text = F.coalesce(F.col(body), F.lit(""))
        plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
        return rows.select(name, F.sha2(text.cast("binary"), 256).alias(f"{side}_sha256"), F.sha2(plain.cast("binary"), 256).alias(f"__{side}"))

    both = digests(candidate, "candidate").join(digests(live, "live"), name, "full").where(~F.col("candidate_sha256").eqNullSafe(F.col("live_sha256")))
    same = F.coalesce(F.col("__candidate") == F.col("__live"), F.lit(False))
    return both.select(name, "candidate_sha256", "live_sha256", same.alias("newlines_only"))


def page_gates(pages: Sequence[DataFrame], object_id: str, position: str, size: int) -> DataFrame:
    """Per page of ``size`` rows: rows, distinct ids, offset, ids that another page has too, and whether all is as it should be (QA-11)."""
    rows = reduce(DataFrame.unionAll, (p.select(F.lit(k).alias("page"), F.col(object_id).alias("id"), F.col(position).alias("at")) for k, p in enumerate(pages)))
    shared = rows.groupBy("id").agg(F.countDistinct("page").alias("n_pages"))
    got = rows.join(shared, "id").groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), (F.min("at") - 1).cast("long").alias("offset"), F.count(F.when(F.col("n_pages") > 1, 1)).alias("n_shared"),
    )
    good = (F.col("n") == size) & (F.col("n_ids") == size) & (F.col("offset") == F.col("page") * size) & (F.col("n_shared") == 0)
    return got.withColumn("ok", good)
