"""Equi-join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys can hold more than one part in this many of the rows.
HOT_KEYS = 1000


def hot_keys(left: DataFrame, key: str, floor: int = 100) -> tuple[DataFrame, int]:
    """Keys of ``left`` with more than max(floor, rows / HOT_KEYS) rows, and that limit.

    Fewer than HOT_KEYS keys can pass once the table exceeds HOT_KEYS * floor
    rows, and rows / floor before that, so the result may be broadcast.
    """
    limit = max(floor, left.count() // HOT_KEYS)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > limit), limit


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", floor: int = 100) -> DataFrame:
    """``left.join(right, key, how)`` for a right side with one row per key.

    The rows of a hot key are spread over several salts by a hash of ``spread``;
    the matching right rows are repeated once per salt. ``left`` is read three
    times, so it should be a materialised, narrow table. ``how`` is inner or left.
    Null keys match nothing.
    """
    hot, limit = hot_keys(left.where(F.col(key).isNotNull()), key, floor)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__salts")))
    salts = F.coalesce(F.col("__salts"), F.lit(1))
    left = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("__salts")
    right = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
