"""Lines, sections, passages and table blocks of documents (survey WIN, TOP-23, TOP-24, PRJ-17, PRJ-26, PRJ-28, JOIN-24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line number from 0, line (SRC-10)."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))


def zones(rows: DataFrame, doc: str, heading: Column) -> DataFrame:
    """The last heading seen at or before each line (WIN-01)."""
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("zone", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit("front")))


def signals_ahead(rows: DataFrame, doc: str, signals: dict[str, Column], ahead: int = 40) -> DataFrame:
    """How many of the signals occur within the next lines (WIN-02)."""
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(0, ahead)
    total = sum((F.max(F.when(c, 1).otherwise(0)).over(w) for c in signals.values()), F.lit(0))
    return rows.withColumn("signals", total)


def section_span(rows: DataFrame, doc: str, score: Column, hard_end: Column) -> DataFrame:
    """The best-scored start line (the later one on ties) and the first hard end after it (TOP-23, TOP-24)."""
    scored = rows.withColumn("s", score)
    start = scored.where("s > 0").groupBy(doc).agg(F.max(F.struct("s", "line_no")).alias("b")).select(doc, F.col("b.line_no").alias("start_line"), F.col("b.s").alias("score"))
    ends = rows.where(hard_end).select(doc, F.col("line_no").alias("end_line"))
    last = rows.groupBy(doc).agg((F.max("line_no") + 1).alias("stop"))
    got = start.join(ends, doc, "left").groupBy(doc, "start_line", "score").agg(F.min(F.when(F.col("end_line") > F.col("start_line"), F.col("end_line"))).alias("end_line"))
    return got.join(last, doc).select(doc, "start_line", "score", F.coalesce("end_line", "stop").alias("end_line"))


def section_type(position: Column, total: Column, text: Column | None = None, hints: Sequence[tuple[str, str, int | None, int | None]] = ()) -> Column:
    """The first hint (section, pattern, least and greatest position) that a text meets, else abstract in the first 15 %, claims in the last, description between (PRJ-17)."""
    share = position / F.greatest(total, F.lit(1))
    out = None
    for section, pattern, least, most in hints:
        holds = text.rlike(pattern)
        holds = holds if least is None else holds & (position >= least)
        holds = holds if most is None else holds & (position <= most)
        out = F.when(holds, section) if out is None else out.when(holds, section)
    return (F if out is None else out).when(share < 0.15, "abstract").when(share > 0.85, "claims").otherwise("description")


def passages(rows: DataFrame, doc: str, least: int = 30) -> DataFrame:
    """Lines of enough characters, numbered, with their section type (PRJ-28, PRJ-17)."""
    total = rows.groupBy(doc).agg(F.max("line_no").alias("last_line"))
    kept = rows.where((F.length("line") >= least) & ~F.col("line").rlike(r"^\s*\d+(\.\d+)*\s*\S{0,20}$"))
    out = kept.join(total, doc).withColumn("section", section_type(F.col("line_no"), F.col("last_line")))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy("line_no"))).drop("last_line")


def ledger(entries: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """Sequenced evidence ids of a unit (PRJ-26, WIN-03)."""
    n = F.row_number().over(Window.partitionBy(unit).orderBy(*order))
    return entries.withColumn("ledger_id", F.concat(F.lit("LEDGER_"), F.col(unit).cast("string"), F.lit("_"), F.lpad(n.cast("string"), 4, "0")))


def merge_continued(rows: DataFrame, doc: str, order: str, continues: Column) -> DataFrame:
    """Blocks that continue the one before share its group number (WIN-04)."""
    w = Window.partitionBy(doc).orderBy(order)
    begins = F.when(continues & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("block_no", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def nearest_block(rows: DataFrame, doc: str, order: str, visual: Column, caption: Column) -> DataFrame:
    """For captions the visual block right before, else the one right after (JOIN-24)."""
    w = Window.partitionBy(doc).orderBy(order)
    before, after = F.lag(F.when(visual, F.col(order))).over(w), F.lead(F.when(visual, F.col(order))).over(w)
    return rows.withColumn("__cap", caption).withColumn("owner", F.coalesce(before, after)).where("__cap").drop("__cap")
