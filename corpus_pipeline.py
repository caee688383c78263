"""A corpus pipeline of five stages, from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``.

Defined results: a null or empty text is judged like any other and packed as its
end marker if it is kept; a null id is an id of its own; rows that share an id
are judged each by its text where the text decides (quality, exact) and share the
decision where the id does (near, mix); empty documents give no pieces; labels
without a row to learn from are refused, for nothing could be told good; columns
besides those of ``documents`` are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena.llm import exact_dedup, mixing, near_dedup, packing, quality
from provena.runtime import materialise, release, scratch_count


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote finds good."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.labels) and not docs.isEmpty():
        raise ValueError("no labelled document to learn from")
    return quality.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in five-word shingles, at a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, n=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, *packing.public_paths())


STAGES = [("quality", quality_filter), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: Models, sketches and tokenisers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = scratch_count(spark)
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
