"""Exact dedup against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest. New data is reduced to one
row per digest, set against the index by a sort-merge anti-join, and what is new
is appended in the same bucketing. Appended batches leave several sorted files in
a bucket; beyond MOST_BATCHES they are compacted into one.

Defined results: a null text is the empty text; of equal rows the one with the
largest id stays (a null id is smaller than any other; rows that repeat an id
and its text are one document and share its decision, rows that share an id but
not the text are decided each by its own); a digest the index knew before keeps
its first id and the whole new group goes; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.skew import salted_join
from provena.runtime import materialise, shuffle_partitions

#: Batches that an index holds before it is compacted.
MOST_BATCHES = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with A-Z in lower case."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


class DigestIndex:
    """A digest index kept as tables ``name``_v1, _v2 ...; the last version counts. Made on first use."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        # as many buckets as shuffle partitions: each reduce task writes one bucket file
        self.buckets = buckets or shuffle_partitions(spark)

    def _versions(self) -> list[int]:
        found = self.spark.sql(f"SHOW TABLES LIKE '{self.name}_v*'").collect()
        return sorted(int(r["tableName"].rsplit("_v", 1)[1]) for r in found if not r["isTemporary"])

    def known(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.table(f"{self.name}_v{versions[-1]}") if versions else None

    def _write(self, rows: DataFrame, version: int) -> None:
        name = f"{self.name}_v{version}"
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)
        self.spark.catalog.refreshTable(name)

    def compact(self) -> None:
        """All batches as one, in a new version; the old one goes once the new one is there."""
        old = self._versions()[-1]
        self._write(self.known().select("digest", "keep_id", "group_size", "batch"), old + 1)
        self.spark.sql(f"DROP TABLE {self.name}_v{old}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; return id, digest, keep_id, group_size and kept of its rows."""
        return self.ingest_digests(digests(docs, id_col, text_col)).withColumnRenamed("__id", id_col)

    def ingest_digests(self, rows: DataFrame) -> DataFrame:
        """``ingest`` for a stored table of ids and digests."""
        batch = uuid.uuid4().hex
        groups = rows.groupBy("digest").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.known()
        fresh = groups if known is None else groups.join(known.select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.withColumn("batch", F.lit(batch)), (self._versions() or [1])[-1])
        index = self.known()
        if index.select("batch").distinct().count() > MOST_BATCHES:
            self.compact()
            index = self.known()
        if known is not None:  # a digest seen before counts what this batch has of it
            index = index.drop("group_size").join(groups.select("digest", "group_size"), "digest")
        own = F.col("batch") == batch
        decided = salted_join(rows, index, "digest", "__id")
        return decided.select("__id", "digest", "keep_id", "group_size", (own & F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def drop(self) -> None:
        for v in self._versions():
            self.spark.sql(f"DROP TABLE {self.name}_v{v}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of ``__id`` and ``digest`` of every row."""
    return materialise(docs.select(F.col(id_col).alias("__id"), F.unhex(digest(F.col(text_col))).alias("digest")), "digests")


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    kept = index.ingest(docs).where("kept").select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__digest")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["__kept"]) & (F.unhex(digest(docs["text"])) == kept["__digest"])
    return docs.join(kept, same, "left_semi")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal documents stays.

    The larger half of the ids is loaded into an empty index first, the rest is
    set against it: what the index knows has the larger id and stays.
    """
    rows = digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    middle = rows.agg(F.percentile_approx("__id", 0.5)).first()[0]
    upper = F.coalesce(F.col("__id") > F.lit(middle), F.lit(False))
    index = DigestIndex(spark)
    found = materialise(index.ingest_digests(rows.where(upper)), "load")
    found = materialise(found.unionAll(index.ingest_digests(rows.where(~upper))), "loads")
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    sized = salted_join(found.drop("group_size"), sizes, "digest", "__id")
    result = materialise(sized.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")), "decided")
    index.drop()
    return result


OP3_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
