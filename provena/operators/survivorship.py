"""Deduplication, conflicts and merges (survey SET, SNK-04)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by a total order (SET-01, SET-02)."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def variants(rows: DataFrame, key: Sequence[str], raw: Column, origin: Column) -> DataFrame:
    """Distinct contents of each key with where they came from (SET-03)."""
    return rows.select(*key, raw.alias("raw"), origin.alias("origin")).groupBy(*key, F.md5("raw").alias("raw_hash")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("origins"))


def conflicts(rows: DataFrame, key: Sequence[str], raw: Column) -> DataFrame:
    """Keys with more than one content (SET-04)."""
    return rows.groupBy(*key).agg(F.countDistinct(raw).alias("variants"), F.count(F.lit(1)).alias("n")).where("variants > 1")


def without_conflicts(rows: DataFrame, key: Sequence[str], raw: Column) -> DataFrame:
    """Rows of keys with one content (SET-05)."""
    return rows.join(conflicts(rows, key, raw).select(*key), list(key), "left_anti")


def last_non_null(rows: DataFrame, key: str, fields: Sequence[str], order: Column) -> DataFrame:
    """For every field the value of the latest row that has one (SET-06)."""
    return rows.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    x, y = F.lower(a), F.lower(b)
    return F.least(x, y), F.greatest(x, y)


def pair_conflicts(must: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Pairs that are both to merge and forbidden to, in either order (SET-09, JOIN-14). Columns a, b."""
    norm = lambda d: d.select(*(c.alias(n) for c, n in zip(unordered(F.col("a"), F.col("b")), ("a", "b"), strict=True))).distinct()
    return norm(must).join(norm(forbidden), ["a", "b"])


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones (SNK-04, SNK-05)."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def union_nodes(parts: Sequence[DataFrame], key: str, lists: Sequence[str]) -> DataFrame:
    """Nodes of all parts with the union of their lists (SET-07, SET-12)."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists))


def union_packs(parts: Sequence[DataFrame], key: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes of all packs, one row a key; keys that packs describe differently) (SET-07).

    Packs may repeat a node if its identity columns are the same; ``require_no_conflicts``
    turns the second table into an error.
    """
    both = reduce(DataFrame.unionByName, parts)
    same = F.struct(*identity)
    seen = both.groupBy(key).agg(F.min(same).alias("one"), F.max(same).alias("other"), F.count(F.lit(1)).alias("copies"))
    nodes = seen.where("one <=> other").select(key, "one.*", "copies")
    return nodes, seen.where("NOT (one <=> other)").select(key, "copies")


def require_no_conflicts(conflicts: DataFrame, key: str) -> None:
    """Raise with some of the keys if there are any."""
    found = [r[0] for r in conflicts.select(key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"nodes described differently: {found}")


def expand_synonyms(values: Sequence[str], families: Sequence[Sequence[str]]) -> list[str]:
    """Values with all members of the synonym families they belong to, in stable order (SET-08)."""
    out = list(dict.fromkeys(v.strip() for v in values if v.strip()))
    for f in families:
        if {x.lower() for x in f} & {v.lower() for v in out}:
            out += [x for x in f if x.lower() not in {v.lower() for v in out}]
    return out
