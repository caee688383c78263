"""Removal of repeated word windows by a log-structured fingerprint index.

Documents are dealt into batches by ranges of ascending id. Each batch gives one
sorted, immutable run of the distinct hashes of its word windows, cut into
buckets by hash. The runs of a bucket are merge-joined: a window is repeated if
its hash is in an earlier run (history, or a batch of smaller ids) and an
independent check hash (of other codes of the same words) verifies it, or if it also starts in a document of
smaller id of the same batch. A bit per window goes back to the batch, which
drops the words that repeated windows cover. With an index folder, the runs of a
load are compacted into one run of what history lacks, in the pass that merges
them, and stored; stored runs are compacted into one when there are many; later
loads are set against them.

At most one row per (batch, bucket) is shuffled, so a window that a third of all
documents share is one entry of each run, not a hot key.

Defined results: a null or empty text has no words; fewer words than a window
are never removed; windows are judged on the input; rows that share an id do not
remove each other's windows; a null id counts as larger than any other; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.buffers import blocks, ngrams, row_of, string_buffer, word_hashes, words
from provena.llm.ranges import HIGH, even_bounds, pack_sorted, parts_of, range_of, unpack_sorted
from provena.runtime import integer_id, materialise, scratch_path, ship

WINDOW = 13
#: Input bytes of a batch, as stored.
BATCH_BYTES = 4 << 20
#: Stored input a bucket: what one task merges.
BUCKET_BYTES = 16 << 20
#: Bytes of the check hash that verifies a match of the 64-bit hashes.
CHECK_BYTES = 3
#: Runs that an index holds before they are compacted.
MOST_RUNS = 8
#: Part of the ids that the query loads first.
FIRST = 1 / 16


class _Batch:
    """Words and window hashes of the rows of a batch."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int, checked: bool):
        self.data, self.offsets = string_buffer(texts)
        self.ids = ids.combine_chunks().fill_null(HIGH).to_numpy(zero_copy_only=False).astype(np.int64) if ids.null_count else ids.to_numpy().astype(np.int64)
        starts, ends, hashes, seconds, counts = [], [], [], [], []
        for first, _, d, o in blocks(self.data, self.offsets):
            s, e, w = words(d, o)
            starts.append(s + self.offsets[first])
            ends.append(e + self.offsets[first])
            hashes.append(word_hashes(d, s, e))
            if checked:
                seconds.append(word_hashes(d, s, e, 1))
            counts.append(np.diff(w))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        self.words = np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64)
        h = join(hashes, np.uint64)
        row = row_of(self.words)
        every = ngrams(h, window)
        last = self.words[1:][row[: len(every)]]
        self.at = np.flatnonzero(np.arange(len(every)) + window <= last) if len(every) else np.zeros(0, np.int64)
        self.doc = row[self.at]
        keys = every[self.at]
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        self.keys = keys[order][new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(self.ids[self.doc][order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        self.first = order[new]
        self.seconds = join(seconds, np.uint64)

    def checks(self, window: int) -> np.ndarray:
        """(distinct keys, CHECK_BYTES), from a second hash of the words that is independent of the first."""
        second = ngrams(self.seconds, window, 3)
        return second[self.at[self.first]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES] if len(self.first) else np.zeros((0, CHECK_BYTES), np.uint8)

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each bucket begins among the sorted keys: buckets are ranges of the hash."""
        edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
        return np.append(np.searchsorted(self.keys, edges), len(self.keys))


RUN = "bucket int, run long, keys binary, checks binary"
#: What a load stores: its run, and its answers (``run`` the batch, ``keys`` the bits).
STORED = f"{RUN}, kind string"
BITS = "batch int, bucket int, bits binary"


def _runs(window: int, buckets: int):
    def make(key, table):
        batch = _Batch(table.column("id"), table.column("text"), window, True)
        cuts, checks = batch.cuts(buckets), batch.checks(window)
        rows = [(b, pack_sorted(batch.keys[i:j]), checks[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return pa.table([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
        ], names=["bucket", "run", "keys", "checks"])

    return make


def _merge(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a bucket in order: numbers, lengths, keys, checks, and whether a key is in an earlier run."""
    rows = sorted(zip(table.column("run").to_pylist(), range(table.num_rows), strict=True))
    runs, sizes, keys, checks = [], [], [], []
    for run, i in rows:
        k = unpack_sorted(table.column("keys")[i].as_py())
        runs.append(run)
        sizes.append(len(k))
        keys.append(k)
        checks.append(np.frombuffer(table.column("checks")[i].as_py(), np.uint8).reshape(-1, CHECK_BYTES))
    keys, checks = np.concatenate(keys), np.concatenate(checks)
    order = np.argsort(keys, kind="stable")  # sorted runs, merged; equal keys stay in order of runs
    sorted_ = keys[order]
    head = np.ones(len(order), bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[order] = ~head & (checks[first] == checks[order]).all(axis=1)
    return runs, sizes, keys, checks, again


def _bits(runs: list[int], sizes: list[int], again: np.ndarray) -> list[tuple[int, bytes]]:
    """Per run of a batch (numbers from 0 up; history is below 0): a bit per key, set if an earlier run has it."""
    out, at = [], 0
    for run, n in zip(runs, sizes, strict=True):
        if run >= 0 and again[at : at + n].any():
            out.append((run, np.packbits(again[at : at + n]).tobytes()))
        at += n
    return out


def _answers(key, table):
    """The bits of a bucket."""
    runs, sizes, _, _, again = _merge(table)
    out = _bits(runs, sizes, again)
    return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], names=["batch", "bucket", "bits"])


def _stored(bucket: int, rows: list[tuple[int, bytes, bytes, str]]) -> pa.Table:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string()]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), *columns], names=["bucket", "run", "keys", "checks", "kind"])


def _add(number: int):
    """The bits of a bucket and, as run ``number``, the keys of its batches that history lacks."""

    def add(key, table):
        runs, sizes, keys, checks, again = _merge(table)
        rows = [(batch, bits, b"", "bits") for batch, bits in _bits(runs, sizes, again)]
        old = sum(n for run, n in zip(runs, sizes, strict=True) if run < 0)  # history comes first
        new = old + np.flatnonzero(~again[old:])
        new = new[np.argsort(keys[new], kind="stable")]
        if len(new):
            rows.append((number, pack_sorted(keys[new]), checks[new].tobytes(), "run"))
        return _stored(key[0].as_py(), rows)

    return add


def _compact(key, table):
    """All runs of a bucket as one."""
    _, _, keys, checks, again = _merge(table)
    keys, checks = keys[~again], checks[~again]
    order = np.argsort(keys, kind="stable")
    return _stored(key[0].as_py(), [(-1, pack_sorted(keys[order]), checks[order].tobytes(), "run")])


OUT = "doc_id long, n_words long, n_removed long, kept string"


def _drop(window: int, buckets: int):
    def drop(left, right):
        batch = _Batch(left.column("id"), left.column("text"), window, False)
        flagged = np.zeros(len(batch.keys), bool)
        cuts = batch.cuts(buckets)
        for b, bits in zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True):
            n = cuts[b + 1] - cuts[b]
            flagged[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        gone = flagged[batch.of] | (batch.least[batch.of] < batch.ids[batch.doc])
        edge = np.zeros(len(batch.starts) + 1, np.int64)
        hit = batch.at[gone]
        edge[hit] += 1
        edge[hit + window] -= 1
        kept = np.cumsum(edge[:-1]) == 0
        n_words = np.diff(batch.words)
        before = np.concatenate([[0], np.cumsum(kept)])
        n_kept = before[batch.words[1:]] - before[batch.words[:-1]]
        # kept words, each with one space after it; a row's last space is cut off
        s, e = batch.starts[kept], batch.ends[kept]
        size = e - s + 1
        to = np.concatenate([[0], np.cumsum(size)])
        body = np.full(to[-1], 0x20, np.uint8)
        src = np.arange(to[-1]) - np.repeat(to[:-1] - s, size)
        ink = np.ones(to[-1], bool)
        ink[to[1:] - 1] = False
        body[ink] = batch.data[src[ink]]
        row_to = to[before[batch.words]]
        raw = body.tobytes()
        texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(row_to[:-1].tolist(), row_to[1:].tolist(), strict=True)]
        kinds = [left.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.table(kinds, names=["doc_id", "n_words", "n_removed", "kept"])

    return drop


class FingerprintIndex:
    """Runs of window hashes in a folder, one a load; runs are never changed, only compacted into a new one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, window: int = WINDOW):
        self.spark, self.path, self.buckets, self.window = spark, path, buckets, window

    def _folders(self) -> list[str]:
        """Finished runs; what a lost driver left unfinished is written anew."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(p.toString() for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _read(self, paths: list[str], kind: str) -> DataFrame:
        each = [self.spark.read.schema(STORED).parquet(p).where(F.col("kind") == kind).drop("kind") for p in paths]
        return reduce(DataFrame.unionAll, each)  # folders are roots of their own

    def history(self) -> DataFrame | None:
        found = self._folders()
        return self._read(found, "run") if found else None

    def add(self, runs: DataFrame) -> DataFrame:
        """Merge the runs of a load with history, store what is new as a run and return the load's answers."""
        n = len(self._folders())
        old = self.history()
        path = f"{self.path}/run-{n:06d}"
        merged = (runs if old is None else runs.unionByName(old)).groupBy("bucket").applyInArrow(_add(-1 - n), STORED)
        merged.write.partitionBy("kind").mode("overwrite").parquet(path)
        return self._read([path], "bits").select(F.col("run").cast("int").alias("batch"), "bucket", F.col("keys").alias("bits"))

    def compact(self) -> None:
        old = self._folders()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # the compacted run appears before the old ones go: history may be read twice, never lost
        one = self.history().groupBy("bucket").applyInArrow(_compact, STORED)
        one.write.partitionBy("kind").parquet(f"{self.path}/run-000000-{uuid.uuid4().hex[:12]}")
        for p in old:
            fs.delete(hadoop.Path(p), True)

    def tidy(self) -> None:
        if len(self._folders()) > MOST_RUNS:
            self.compact()


def remove_repeats(docs: DataFrame, window: int = WINDOW, index: FingerprintIndex | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, share: float = 1.0) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row.

    The load is set against ``index`` if given and, with ``keep``, added to it.
    ``share`` is the part of the stored tables behind ``docs`` that its rows
    make up; it sizes batches only.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(integer_id(docs, id_col).alias("id"), docs[text_col].alias("text"))
    cuts = even_bounds(rows, "id", "text", parts_of(docs, int(BATCH_BYTES / share), 2))
    n = parts_of(docs, int(BUCKET_BYTES / share))
    buckets = index.buckets if index else n
    dealt = rows.withColumn("batch", range_of(F.col("id"), cuts)).repartition(n, "batch")
    runs = dealt.groupBy("batch").applyInArrow(_runs(window, buckets), RUN)
    stored = index is not None and keep
    if stored:
        bits = index.add(runs)
    else:
        old = index.history() if index else None
        bits = (runs if old is None else runs.unionByName(old)).groupBy("bucket").applyInArrow(_answers, BITS)
    out = dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(_drop(window, buckets), OUT)
    if stored:
        out = materialise(out, "kept")  # before a compaction takes the answers away
        index.tidy()
    return out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that a window of a smaller document covers, removed.

    The smallest FIRST of the ids is a load of its own, whose run the index
    keeps; the rest is merge-joined with that run.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), FIRST, round(20 / FIRST))).first()[0]
    first = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    index = FingerprintIndex(spark, scratch_path(spark, "fingerprints"), parts_of(docs, BUCKET_BYTES))
    old = remove_repeats(docs.where(first), index=index, share=FIRST)
    found = old.unionByName(remove_repeats(docs.where(~first), index=index, keep=False))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS least FROM x GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM x JOIN m USING (win) WHERE least < doc_id) CROSS JOIN range(13) r(k)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
