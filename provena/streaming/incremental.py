"""Incremental index maintenance: micro-batches merged by key (survey 2.10, SNK-04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from provena.operators.survivorship import first_wins
from provena.sources.sinks import merge_table


def follow_jsonl(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).json(folder)


def maintain(stream: DataFrame, path: str, key: Sequence[str], order: Sequence, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the table at ``path``.

    The first row by ``order`` of a key wins, within a batch and against the
    stored row, so a late older row changes nothing; replaying a batch after a
    failure gives the same table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            merge_table(first_wins(batch, key, order), path, key, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
