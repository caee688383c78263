"""Removal of repeated byte strings with a suffix array by external induced sorting.

A string of LENGTH bytes that occurs twice shares its anchor: the GRAM-byte
piece of least hash in it. Cutting every text into stretches of strings with the
same anchor groups all occurrences of a string under one anchor hash, so:

1. every batch of documents sends one sorted run of (anchor, stretch digest);
   merged, they tell which stretches are unique by anchor, which occur again as a
   whole, and which share only their anchor with a different stretch;
2. of the last kind one copy of each distinct stretch goes to the shard of its
   anchor, where a suffix array with common prefixes is built by external
   induced sorting (see ``induced``): a string occurs elsewhere where its suffix
   and a neighbour have at least LENGTH bytes in common;
3. the answers, a bit per string, go back to the batch, which cuts the bytes.

All occurrences of a string are compared by 128 bits of hashes in step 1 and
byte by byte in step 2; only text that shares an anchor is sorted, so shards
stay far smaller than the corpus. The arrays and queues of a shard go to disk
beyond QUEUE_BYTES, however many strings share its anchor.

Defined results: a null or empty text, or one shorter than LENGTH, keeps all
bytes; overlapping repeats within a text count; strings are judged on the input;
repeated rows are documents of their own; a null id is a document like others;
kept bytes may cut a character in two; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import induced
from provena.llm.buffers import blocks, mix, piece_digests, prefix, spans, string_buffer
from provena.llm.ranges import pack_sorted, parts_of, unpack_sorted
from provena.runtime import integer_id, ship

LENGTH, GRAM = 200, 64
BATCH_BYTES = 4 << 20
#: Stored input a bucket: what one task merges and one shard sorts.
BUCKET_BYTES = 16 << 20
#: Bytes that the sorting of a shard holds in memory before arrays and queues go to disk.
QUEUE_BYTES = 96 << 20
#: Bytes of text that are sorted as one shard at least; the strings of one anchor are never parted.
SORT_BYTES = 4 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    pad = -len(values) % width
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    grid = np.concatenate([values, np.full(pad, top)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class _Stretches:
    """Stretches of the rows of a batch: strings (by first byte) from ``first`` to ``last`` share an anchor."""

    def __init__(self, texts: pa.ChunkedArray, length: int):
        self.length = length
        self.data, self.offsets = string_buffer(texts)
        window = length - GRAM + 1
        firsts, lasts, anchors, digests = [], [], [], []
        for row, _, d, o in blocks(self.data, self.offsets):
            if len(d) < length:
                continue
            pre = prefix(d)
            at = np.arange(len(d) - GRAM + 1)
            grams = spans(pre, at, at + GRAM)
            bits = np.uint64(max(20, int(len(grams)).bit_length()))
            keyed = ((grams >> bits) << bits) | at.astype(np.uint64)  # ties: the first one
            least = (_least(keyed, window) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
            m = len(least)  # strings that start at 0 .. m - 1 of the block; those across rows are left out
            inside = np.zeros(m + 1, np.int64)
            lo, hi = o[:-1], np.maximum(o[:-1], o[1:] - length + 1)
            full = hi > lo
            np.add.at(inside, lo[full], 1)
            np.add.at(inside, hi[full], -1)
            good = np.cumsum(inside[:-1]) > 0
            new = good.copy()
            new[1:] &= (least[1:] != least[:-1]) | ~good[:-1]
            new[lo[full]] = True
            first = np.flatnonzero(new)
            stop = np.append(first[1:], m)
            # a stretch ends where the next one starts or its row's strings end
            row_end = hi[np.searchsorted(o, first, "right") - 1]
            last = np.minimum(stop, row_end) - 1
            base = int(self.offsets[row])
            firsts.append(first + base)
            lasts.append(last + base)
            anchors.append(mix(grams[least[first]], 43))  # least hashes are small: spread them over the buckets
            digests.append(piece_digests(d, first, last + length, 41))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.first, self.last = join(firsts, np.int64), join(lasts, np.int64)
        anchor, digest = join(anchors, np.uint64), join(digests, np.uint64)
        order = np.lexsort((digest, anchor))
        new = np.ones(len(order), bool)
        a, g = anchor[order], digest[order]
        new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.anchor, self.digest = a[new], g[new]
        self.copies = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.example = order[new]

    def cuts(self, buckets: int) -> np.ndarray:
        edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
        return np.append(np.searchsorted(self.anchor, edges), len(self.anchor))


RUN = "bucket int, batch int, anchors binary, digests binary, many binary"


def _runs(length: int, buckets: int):
    def run(key, table):
        s = _Stretches(table.column("text"), length)
        cuts = s.cuts(buckets)
        rows = [(b, pack_sorted(s.anchor[i:j]), s.digest[i:j].tobytes(), np.packbits(s.copies[i:j] > 1).tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(cols[0], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "batch", "anchors", "digests", "many"])

    return run


#: What is known of a distinct stretch: it occurs again as a whole; it shares its anchor
#: with another one and waits for the sorting; its text is to be sent by this batch.
WHOLE, WAITS, SEND = 1, 2, 4
REPLY = "batch int, bucket int, sorted boolean, body binary"


def _reply(rows: list[tuple], sorted_: bool) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([sorted_] * len(rows), pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["batch", "bucket", "sorted", "body"])


def _compare(key, table):
    """Merge the runs of a bucket."""
    order = np.argsort(table.column("batch").to_numpy(), kind="stable")
    batches, sizes, anchors, digests, many = [], [], [], [], []
    for i in order.tolist():
        a = unpack_sorted(table.column("anchors")[i].as_py())
        batches.append(table.column("batch")[i].as_py())
        sizes.append(len(a))
        anchors.append(a)
        digests.append(np.frombuffer(table.column("digests")[i].as_py(), np.uint64))
        many.append(np.unpackbits(np.frombuffer(table.column("many")[i].as_py(), np.uint8), count=len(a)).astype(bool))
    a, g, twice = np.concatenate(anchors), np.concatenate(digests), np.concatenate(many)
    at = np.lexsort((g, a))  # stable: equal stretches stay in order of batches
    new_a = np.ones(len(at), bool)
    new_a[1:] = a[at][1:] != a[at][:-1]
    new_g = new_a.copy()
    new_g[1:] |= g[at][1:] != g[at][:-1]
    stretch = np.cumsum(new_g) - 1
    heads = np.flatnonzero(new_g)
    whole = (np.diff(np.append(heads, len(at))) > 1) | np.logical_or.reduceat(twice[at], heads)
    anchor_of = (np.cumsum(new_a) - 1)[heads]
    shared = (np.bincount(anchor_of) > 1)[anchor_of]
    state = np.zeros(len(at), np.uint8)
    state[at] = (whole * WHOLE + (shared & ~whole) * WAITS).astype(np.uint8)[stretch]
    state[at[heads[shared]]] |= SEND
    out, start = [], 0
    for batch, n in zip(batches, sizes, strict=True):
        if state[start : start + n].any():
            out.append((batch, key[0].as_py(), state[start : start + n].tobytes()))
        start += n
    return _reply(out, False)


SENT = "bucket int, batch int, indices binary, waits binary, anchors binary, lengths binary, body binary"


def _states(s: _Stretches, table: pa.Table, buckets: int) -> np.ndarray:
    state, cuts = np.zeros(len(s.anchor), np.uint8), s.cuts(buckets)
    for b, done, body in zip(table.column("bucket").to_pylist(), table.column("sorted").to_pylist(), table.column("body").to_pylist(), strict=True):
        if not done:
            state[cuts[b] : cuts[b + 1]] = np.frombuffer(body, np.uint8)
    return state


def _send(length: int, buckets: int):
    def send(left, right):
        rows = []
        if right.num_rows and left.num_rows:
            s = _Stretches(left.column("text"), length)
            state, cuts = _states(s, right, buckets), s.cuts(buckets)
            batch = left.column("batch")[0].as_py()
            for b in range(buckets):
                index = cuts[b] + np.flatnonzero(state[cuts[b] : cuts[b + 1]] & SEND)
                if len(index):
                    at = s.example[index]
                    first, stop = s.first[at], s.last[at] + length
                    body = b"".join(s.data[i:j].tobytes() for i, j in zip(first.tolist(), stop.tolist(), strict=True))
                    rows.append((b, batch, (index - cuts[b]).astype(np.int32).tobytes(), ((state[index] & WAITS) > 0).tobytes(), s.anchor[index].tobytes(), (stop - first).astype(np.int32).tobytes(), body))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "batch", "indices", "waits", "anchors", "lengths", "body"])

    return send


def repeated(pieces: list[np.ndarray], length: int = LENGTH, memory: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For every piece: whether each of its strings of ``length`` bytes also starts elsewhere in the pieces."""
    text = np.concatenate([x for p in pieces for x in (p.astype(np.int16) + 2, np.ones(1, np.int16))] + [np.zeros(1, np.int16)])
    again = np.zeros(len(text), bool)
    before = 0
    for positions, common in induced.sorted_suffixes(text, length, induced.Space(memory)):
        found = common >= length
        again[positions[found]] = True
        again[np.append(before, positions[:-1])[found]] = True  # a suffix and its neighbour repeat each other
        before = positions[-1]
    out, at = [], 0
    for p in pieces:
        out.append(again[at : at + max(0, len(p) - length + 1)])
        at += len(p) + 1
    return out


def _sort(length: int):
    def sort(key, table):
        """Sort the stretches of a shard; a bit per string goes to each that waits."""
        source, index, waits, anchors, pieces = [], [], [], [], []
        for r in table.to_pylist():
            n = np.frombuffer(r["lengths"], np.int32)
            cut = np.concatenate([[0], np.cumsum(n)])
            body = np.frombuffer(r["body"], np.uint8)
            pieces += [body[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
            source += [r["batch"]] * len(n)
            index.append(np.frombuffer(r["indices"], np.int32))
            waits.append(np.frombuffer(r["waits"], bool))
            anchors.append(np.frombuffer(r["anchors"], np.uint64))
        index, waits, anchors, source = np.concatenate(index), np.concatenate(waits), np.concatenate(anchors), np.array(source)
        # parts of whole anchor groups, each sorted on its own; a group larger than a part is one part
        by = np.argsort(anchors, kind="stable")
        replies: dict[int, list] = {}
        part, size = [], 0
        for k, i in enumerate(by.tolist()):
            part.append(i)
            size += len(pieces[i])
            ends = k + 1 == len(by) or anchors[by[k + 1]] != anchors[i]
            if ends and (size >= SORT_BYTES or k + 1 == len(by)):
                for j, bits in zip(part, repeated([pieces[j] for j in part], length), strict=True):
                    if waits[j] and bits.any():
                        replies.setdefault(int(source[j]), []).append((int(index[j]), bits))
                part, size = [], 0
        rows = []
        for batch, found in replies.items():
            head = np.array([(i, len(b)) for i, b in found], np.int32)
            rows.append((batch, key[0].as_py(), len(found).to_bytes(4, "little") + head.tobytes() + np.packbits(np.concatenate([b for _, b in found])).tobytes()))
        return _reply(rows, True)

    return sort


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(length: int, buckets: int, with_kept: bool):
    def cut(left, right):
        s = _Stretches(left.column("text"), length)
        state, cuts = _states(s, right, buckets), s.cuts(buckets)
        n = len(s.data)
        edge = np.zeros(n + 1, np.int64)  # strings that repeat, as +1 at the first byte and -1 after the last

        def mark(first, last):
            np.add.at(edge, first, 1)
            np.add.at(edge, last + length, -1)

        whole = (state[s.of] & WHOLE) > 0
        mark(s.first[whole], s.last[whole])
        fine: dict[int, np.ndarray] = {}
        for b, done, body in zip(right.column("bucket").to_pylist(), right.column("sorted").to_pylist(), right.column("body").to_pylist(), strict=True):
            if done:
                k = int.from_bytes(body[:4], "little")
                head = np.frombuffer(body, np.int32, 2 * k, 4).reshape(-1, 2)
                bits = np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + 8 * k), count=int(head[:, 1].sum())).astype(bool)
                at = np.concatenate([[0], np.cumsum(head[:, 1])])
                for (i, _), x, y in zip(head.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    fine[int(cuts[b]) + i] = bits[x:y]
        if fine:
            keys = np.zeros(len(s.anchor), bool)
            keys[list(fine)] = True
            for i in np.flatnonzero(keys[s.of]).tolist():
                hit = s.first[i] + np.flatnonzero(fine[int(s.of[i])])
                mark(hit, hit)
        gone = np.cumsum(edge[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        rows = s.offsets[:-1][(s.offsets[:-1] < n)]
        begin[rows] = gone[rows]  # runs do not go on from one row to the next
        spans_before = np.concatenate([[0], np.cumsum(begin)])
        lo, hi = s.offsets[:-1], s.offsets[1:]
        kept = s.data[~gone].tobytes()
        to = s.offsets - before[s.offsets]
        parts = [kept[i:j] for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        return pa.table([
            left.column("id").combine_chunks(), pa.array(hi - lo, pa.int64()), pa.array(before[hi] - before[lo], pa.int64()), pa.array(spans_before[hi] - spans_before[lo], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), pa.array(parts if with_kept else [None] * len(parts), pa.binary()),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(integer_id(docs, id_col).alias("id"), docs[text_col].alias("text"))
    batches, n = parts_of(docs, BATCH_BYTES, 2), parts_of(docs, BUCKET_BYTES)
    # any documents make a batch, and rows that repeat an id are dealt by their texts
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int")).repartition(n, "batch")
    runs = dealt.groupBy("batch").applyInArrow(_runs(length, n), RUN)
    states = runs.groupBy("bucket").applyInArrow(_compare, REPLY)
    sent = dealt.groupBy("batch").cogroup(states.groupBy("batch")).applyInArrow(_send(length, n), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_sort(length), REPLY)
    return dealt.groupBy("batch").cogroup(states.unionAll(answers).groupBy("batch")).applyInArrow(_cut(length, n, with_kept), OUT)


def op6_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a repeated 200-byte string covers, removed."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False).drop("kept")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS first, max(i) + {LENGTH - 1} AS last FROM g GROUP BY 1, 2),
t AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS done FROM s),
k AS (SELECT doc_id, sum(last - first + 1)::BIGINT AS n_removed, count(*) AS n_spans, max(last) AS done, string_agg(CASE WHEN first > done + 1 THEN hex(array_slice(b, done + 1, first - 1)) ELSE '' END, '' ORDER BY first) AS kept FROM t JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || CASE WHEN octet_length(b) > coalesce(done, 0) THEN hex(array_slice(b, coalesce(done, 0) + 1, octet_length(b))) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
