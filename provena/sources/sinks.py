"""Sinks (survey SNK)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.survivorship import first_wins, upsert


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write JSON lines; the count comes from the same pass (SNK-01)."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def append_jsonl(rows: DataFrame, path: str) -> None:
    """SNK-07."""
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Add rows to a log of CSV files, each with a header (QA-04)."""
    rows.write.mode("append").option("header", "true").csv(path)


def write_manifest(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Rows of each table and a histogram of edge types, as one JSON file (SNK-02)."""
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("kind"), F.lit(k).alias("name"), "n") for k, d in tables.items()]
    out = edges.groupBy(F.lit("edge_type").alias("kind"), F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for p in parts:
        out = out.unionAll(p)
    out.coalesce(1).orderBy("kind", "name").write.json(path)  # a few rows: tables and edge types
    return spark.read.schema(out.schema).json(path)


def write_wide_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Columns in a fixed order, with a header (SNK-03)."""
    rows.select(*columns).write.option("header", "true").csv(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table: folders v<n> with Spark's mark of success."""
    hadoop, at, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last finished version of a table that ``merge_table`` keeps."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")


def merge_table(new: DataFrame, path: str, key: Sequence[str], order: Sequence | None = None) -> None:
    """Insert or replace by key (SNK-04, SNK-05).

    With ``order`` the first row by it wins, stored or new, so late rows do not
    replace better ones. The result is a new version beside the old one; a run
    that breaks off leaves the last finished version as it was. The version
    before it stays for readers that have begun.
    """
    spark = new.sparkSession
    done = _versions(spark, path)
    if done:
        old = spark.read.schema(new.schema).parquet(f"{path}/v{done[-1]}")
        new = upsert(old, new, key) if order is None else first_wins(old.unionByName(new), key, order)
    new.write.mode("overwrite").parquet(f"{path}/v{done[-1] + 1 if done else 1}")
    hadoop, _, fs = _files(spark, path)
    for n in done[:-1]:
        fs.delete(hadoop.Path(f"{path}/v{n}"), True)


def replace_collection(rows: DataFrame, path: str, column: str = "collection_id") -> None:
    """Replace exactly the collections that the rows hold (SNK-06)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
