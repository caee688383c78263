"""Packing token sequences into windows by non-negative least squares.

Documents are tokenised and cut into full windows and a remainder. Shallow
combinations of two or three remainder lengths that fill a window exactly are
enumerated; repeat counts are solved against the histogram of remainder lengths
by non-negative least squares and rounded down; what is left is packed greedily
and cut where a window is full.

Each task packs the rows it reads, in bounded chunks, so nothing is shuffled:
the sequence id carries the partition. A window that stays part-filled at the
end of a chunk is cut into powers of two, which need no padding.

Defined results: a null text is the empty text, whose only token is the end
marker; repeated rows are packed each; every id lies in exactly one piece; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from provena.runtime import integer_id, ship

WINDOW = 1024
END_ID = 0
#: Remainders packed at one time: at most so many bytes of ids are held.
CHUNK_BYTES = 24 << 20
#: How many of the commonest lengths make triples.
SHALLOW = 40


@lru_cache(maxsize=2)
def _tokenizer(path: str, ranks_path: str | None):
    """(encode a text to ids, as an array). The ranks give the same ids, faster; special strings go the slow way."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    specials = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
    if ranks_path is None:
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in specials):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast._core_bpe.encode_ordinary(text), np.uint32)

    return encode


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to ``window``, each with a positive count."""
    have = np.flatnonzero(counts[1:window]) + 1
    found = [(a, window - a, 0) for a in have if a <= window - a and counts[window - a]]
    common = have[np.argsort(-counts[have], kind="stable")][:SHALLOW]
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and counts[c]:
                found.append((a, b, c))
    return np.unique(np.sort(np.array(found, np.int64).reshape(-1, 3), axis=1), axis=0)


def solve_counts(counts: np.ndarray, combos: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares: repeats x of the combinations that best explain the histogram.

    Accelerated projected gradient; every combination has at most three lengths,
    so a step is three gathers and three scatters.
    """
    if not len(combos):
        return np.zeros(0)
    target = counts.astype(float).copy()
    target[0] = 0
    used = combos > 0
    # a bound of the largest singular value squared: row sums times column sums
    per_length = np.bincount(combos[used], minlength=len(counts))
    step = 1.0 / (9.0 * max(1, per_length.max()) / 3.0)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(steps):
        made = np.zeros(len(counts))
        for k in range(3):
            made += np.bincount(combos[:, k], weights=y, minlength=len(counts))
        off = target - made
        off[0] = 0
        new = np.maximum(0.0, y + step * (off[combos[:, 0]] + off[combos[:, 1]] + off[combos[:, 2]]))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def pack_lengths(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length) holding every item once, cut where a window is full."""
    by: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        by.setdefault(int(lengths[i]), []).append(i)
    counts = np.bincount(lengths, minlength=window + 1)
    sequences = [[(i, 0, window)] for i in by.pop(window, [])]
    combos = combinations(counts, window)
    repeats = np.floor(solve_counts(counts, combos) + 1e-6).astype(int)
    for k in np.argsort(-repeats, kind="stable").tolist():
        if repeats[k] <= 0:
            break
        parts = [int(a) for a in combos[k] if a]
        need = {a: parts.count(a) for a in parts}
        for _ in range(min(int(repeats[k]), *(len(by.get(a, ())) // n for a, n in need.items()))):
            sequences.append([(by[a].pop(), 0, a) for a in parts])
    # the residual: longest first, each window filled to the brim, the overhang opens the next one
    open_, room = [], window
    for length in sorted(by, reverse=True):
        for i in by[length]:
            at = 0
            while at < length:
                take = min(room, length - at)
                open_.append((i, at, take))
                at += take
                room -= take
                if not room:
                    sequences.append(open_)
                    open_, room = [], window
    # powers of two need no padding
    total = window - room
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        piece = []
        while size:
            i, at, n = open_[0]
            take = min(n, size)
            piece.append((i, at, take))
            size -= take
            open_[0:1] = [(i, at + take, n - take)] if take < n else []
        sequences.append(piece)
    return sequences


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, ranks_path: str | None, window: int, id_type: pa.DataType):
    kinds = [id_type, *[pa.int64()] * 6]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches):
        encode = _tokenizer(path, ranks_path)
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens: whole windows and remainders
        size = 0

        def flush():
            nonlocal next_id, held, size
            rows = []
            for sequence in pack_lengths(np.array([len(x[2]) for x in held], np.int64), window):
                at = 0
                for i, start, n in sequence:
                    doc, first, ids, tokens = held[i]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    rows.append((doc, first + start, n, crc, tokens, next_id, at))
                    at += n
                next_id += 1
            held, size = [], 0
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    held.append((doc, at, part, len(ids)))
                    size += part.nbytes + 200
                    if size > CHUNK_BYTES:
                        yield flush()
        if held:
            yield flush()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence."""
    ship(docs.sparkSession)
    rows = docs.select(integer_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, ranks_path, window, pa.int64()), PIECES)


def public_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_paths())
