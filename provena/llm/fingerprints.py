"""Document fingerprints from prefix polynomial hashes.

A prefix array holds the polynomial hash of every prefix of a text, modulo
2**31 - 1 under two bases. It answers the equality of any two spans with two
subtractions and finds the longest common extension of two places by binary
search. A document's fingerprint is drawn from the hashes of all its spans of
GRAM bytes: the spans fall into SLOTS slots by hash, and each slot keeps its
least hash in full, so that equal slots estimate the share of spans that two
texts have in common however long they are. Only the least hash is cut to 16
bits, after a remix: two different ones agree by chance once in 65536. The same
prefix arrays tell how far a text runs on as its edited text or the next document
does: the longest common extension of their beginnings, in bytes.

Defined results: a null or empty text has no span and the fingerprint of the
empty text, which is alike (1.0) only to itself; a text shorter than GRAM bytes
is one span; documents are ordered by descending id, a null id last, equal ids
by text; a lone document is its own next one; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.buffers import BLOCK_BYTES, mix
from provena.llm.ranges import LOW, bounds, parts_of
from provena.runtime import integer_id, ship

P = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 747_796_405)
GRAM, SLOTS = 24, 64
#: Stored input that one task orders, about.
RANGE_BYTES = 32 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x < 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        out = []
        for b in (base % int(P), pow(base, -1, int(P))):
            row = np.ones(1, np.uint64)
            while len(row) < size:
                row = np.concatenate([row, _fold(row * np.uint64(pow(b, len(row), int(P))))])
            out.append(row[:size])
        have = (out[0], out[1])
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have


class PrefixHashes:
    """Prefix arrays of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.pre = []
        for base in BASES:
            up, _ = _power(base, self.n + 1)
            row = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold((data.astype(np.uint64) + np.uint64(1)) * up[: self.n]), out=row[1:])
            self.pre.append(_fold(row))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of data[starts:ends]; equal spans have equal hashes wherever they lie."""
        out = None
        for base, pre in zip(BASES, self.pre, strict=True):
            _, down = _power(base, self.n + 1)
            part = _fold((pre[ends] + P - pre[starts]) * down[starts])
            out = part if out is None else (out << np.uint64(31)) | part
        return out

    def equal(self, i, j, length, other: PrefixHashes | None = None) -> np.ndarray:
        """Whether the spans of ``length`` at i here and at j in ``other`` are equal; for arrays or numbers."""
        i, j, length = (np.atleast_1d(np.asarray(x, np.int64)) for x in (i, j, length))
        return self.spans(i, i + length) == (other or self).spans(j, j + length)

    def longest_common_extension(self, i, j, other: PrefixHashes | None = None, most=None) -> np.ndarray:
        """Lengths (up to ``most``) of the longest common runs that start at i here and at j in ``other``, by binary search."""
        other = other or self
        i, j = (np.atleast_1d(np.asarray(x, np.int64)) for x in (i, j))
        high = np.minimum(self.n - i, other.n - j)
        if most is not None:
            high = np.minimum(high, most)
        low = np.zeros_like(high)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_], j[open_], middle, other)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1


EMPTY = np.uint16(0xFFFF)
#: What a slot compares: the bits of a hash that do not name the slot.
REST = np.uint64(2**58 - 1)
NONE = np.uint64(2**64 - 1)
#: Spans that are hashed in one step.
PART = 1 << 21


class Prints:
    """Fingerprints of texts, and the prefix arrays that they are drawn from, in blocks of texts."""

    def __init__(self, texts: list[bytes]):
        #: (texts, SLOTS) 16 bits of the least hash per slot; EMPTY where a slot has no span
        self.sketches = np.full((len(texts), SLOTS), EMPTY, np.uint16)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.block, self.start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        self.prefixes: list[PrefixHashes] = []
        first = 0
        while first < len(texts):
            last = first + 1
            while last < len(texts) and self.size[first : last + 1].sum() <= BLOCK_BYTES:
                last += 1
            self._block(texts, first, last)
            first = last

    def _block(self, texts: list[bytes], first: int, last: int) -> None:
        prefix = PrefixHashes(np.frombuffer(b"".join(texts[first:last]), np.uint8))
        sizes = self.size[first:last]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.block[first:last], self.start[first:last] = len(self.prefixes), offsets[:-1]
        self.prefixes.append(prefix)
        grams = np.where(sizes > 0, np.maximum(sizes - GRAM + 1, 1), 0)
        goffsets = np.concatenate([[0], np.cumsum(grams)])
        least = np.full((last - first) * SLOTS, NONE)
        for at in range(0, int(goffsets[-1]), PART):  # a very long text in parts
            place = np.arange(at, min(at + PART, int(goffsets[-1])))
            row = np.searchsorted(goffsets, place, "right") - 1
            starts = place - goffsets[row] + offsets[row]
            h = mix(prefix.spans(starts, np.minimum(starts + GRAM, offsets[row + 1])))
            slot = (h >> np.uint64(58)).astype(np.int64)  # SLOTS = 2**6
            np.minimum.at(least, row * SLOTS + slot, h & REST)
        value = (mix(least) >> np.uint64(48)).astype(np.uint16)
        value[value == EMPTY] = 0xFFFE
        self.sketches[first:last] = np.where(least == NONE, EMPTY, value).reshape(-1, SLOTS)

    def common(self, other: Prints, at: np.ndarray) -> np.ndarray:
        """Bytes that each text here and text ``at`` of ``other`` begin with alike."""
        out = np.zeros(len(self.size), np.int64)
        pair = self.block * len(other.prefixes) + other.block[at]
        for p in np.unique(pair):
            rows = np.flatnonzero(pair == p)
            here, there = self.prefixes[p // len(other.prefixes)], other.prefixes[p % len(other.prefixes)]
            out[rows] = here.longest_common_extension(self.start[rows], other.start[at[rows]], there, np.minimum(self.size[rows], other.size[at[rows]]))
        return out


def sketches(texts: list[bytes]) -> np.ndarray:
    return Prints(texts).sketches


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either fingerprint fills; 1 for two empty texts."""
    filled = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & filled).sum(axis=1)
    n = filled.sum(axis=1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text's first ones, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def _fingerprint(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush(rows, following):
        texts = [t for _, t in rows]
        nexts = [*texts[1:], following]
        edited = [edit(a, b) for a, b in zip(texts, nexts, strict=True)]
        raw = [e.encode() for e in edited]
        prints, changed = Prints([t.encode() for t in [*texts, following]]), Prints(raw)
        own, other = prints.sketches, changed.sketches
        places = np.arange(len(rows))
        cols = [
            [i for i, _ in rows], [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in raw],
            [text_of(x) for x in own[:-1]], [text_of(x) for x in other], likeness(own[:-1], other), likeness(own[:-1], own[1:]),
            changed.common(prints, places), prints.common(prints, np.append(places + 1, len(rows)))[:-1],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    part, rows, size = None, [], 0
    for batch in batches:
        for p, ahead, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if p != part:
                if rows:
                    raise ValueError(f"range {part} lacks the document after its last one")
                part, over = p, False
            if over:
                continue
            text = text.as_py() or ""
            if rows and (ahead or size > BLOCK_BYTES):
                yield flush(rows, text)
                rows, size = [], 0
            if ahead:
                over = True  # what follows are further rows of the same id
            else:
                rows.append((key, text))
                size += len(text)
    if rows:
        raise ValueError(f"range {part} lacks the document after its last one")


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, ahead, key, text): ranges of ids, each with the document that follows its last one.

    The bounds of the ranges are ids that occur, so that the document after a
    range is known beforehand; only the bounds reach the driver.
    """
    rows = docs.select(integer_id(docs, "doc_id").alias("key"), docs["text"].alias("text"))
    keys = rows.select(F.coalesce("key", F.lit(LOW)).alias("key"))
    top = keys.agg(F.max("key")).first()[0]
    if top is None:
        return rows.select(F.lit(0).cast("long").alias("part"), F.lit(False).alias("ahead"), "key", "text").limit(0)
    cuts = bounds(keys, "key", ranges)
    cuts = cuts[cuts < top]

    @F.pandas_udf("array<long>")
    def parts(key: pd.Series) -> pd.Series:
        ids = key.fillna(LOW).astype("int64").to_numpy() if key.isna().any() else key.to_numpy()
        own = np.searchsorted(cuts, ids, "left")  # range j holds (cuts[j-1], cuts[j]]
        bound = np.zeros(len(ids), bool)
        inside = own < len(cuts)
        bound[inside] = cuts[own[inside]] == ids[inside]
        return pd.Series([[j, j + 1] if b else [j, 0] if i == top else [j] for j, b, i in zip(own.tolist(), bound.tolist(), ids.tolist(), strict=True)])

    # descending order: the document after range j is its lower bound, cuts[j-1]; after range 0 it is the first of all
    dealt = rows.select("key", "text", F.posexplode(parts("key")).alias("copy", "part"))
    return dealt.select("part", (F.col("copy") == 1).alias("ahead"), "key", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its own fingerprint, its edited text's, how alike they are, and the bytes they begin with alike."""
    spark = docs.sparkSession
    ship(spark)
    n = parts_of(docs, RANGE_BYTES)
    dealt = with_next(docs, 4 * n).repartition(n, "part")
    ordered = dealt.sortWithinPartitions("part", "ahead", F.coalesce("key", F.lit(LOW)).desc(), "text")
    return ordered.select("part", "ahead", "key", "text").mapInArrow(_fingerprint, SCHEMA)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
