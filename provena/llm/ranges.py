"""Ranges of ids with bounds that occur in the data, for work that follows the order of ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.runtime import plan_bytes, shuffle_partitions

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def parts_of(docs: DataFrame, part_bytes: int, least: int = 1) -> int:
    """Parts of about ``part_bytes`` of stored input each; at least ``least`` a shuffle partition."""
    return max(least * shuffle_partitions(docs.sparkSession), plan_bytes(docs) // part_bytes)


def bounds(ids: DataFrame, column: str, ranges: int) -> np.ndarray:
    """At most ``ranges - 1`` increasing ids that cut the rows into about equal ranges."""
    at = [k / ranges for k in range(1, ranges)]
    if not at:
        return np.zeros(0, np.int64)
    found = ids.agg(F.percentile_approx(column, at, 20 * ranges)).first()[0]
    return np.array(sorted(set(found or [])), np.int64)


#: Finer ranges that are weighed for each batch.
FINER = 8


def even_bounds(rows: DataFrame, column: str, text: str, ranges: int) -> np.ndarray:
    """Increasing ids that cut the rows into about ``ranges`` ranges of equal bytes of text.

    Fine ranges of equal rows are weighed and joined up; where texts are very
    long, a fine range is a range of its own. Only bounds and sums reach the driver.
    """
    fine = bounds(rows, column, FINER * ranges)
    weighed = rows.groupBy(range_of(F.col(column), fine).alias("range")).agg(F.sum(F.octet_length(text)).alias("n")).collect()
    size = np.zeros(len(fine) + 1, np.int64)
    for r in weighed:
        size[r["range"]] = r["n"] or 0
    share, held, cuts = size.sum() / ranges, 0, []
    for k, bound in enumerate(fine.tolist()):
        held += size[k]
        if held + size[k + 1] > share:  # the next fine range would be too much
            cuts.append(bound)
            held = 0
    return np.array(cuts, np.int64)


def range_of(column: Column, cuts: np.ndarray) -> Column:
    """Index of the range (cuts[j-1], cuts[j]] that an id falls in; a null id falls in the last."""

    @F.pandas_udf("int")
    def index(ids: pd.Series) -> pd.Series:
        values = ids.fillna(HIGH).astype("int64").to_numpy() if ids.isna().any() else ids.to_numpy()
        return pd.Series(np.searchsorted(cuts, values, "left").astype("int32"))

    return index(column)


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 array as its first value and the differences, in the fewest whole bytes each."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    out = steps.reshape(-1).view("<u8").astype(np.uint64)
    out[0] = int.from_bytes(raw[1:9], "little")
    return np.cumsum(out, dtype=np.uint64)
