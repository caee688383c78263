import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from provena.llm import byte_dedup


def same(got, docs, length=200):
    want = brute.byte_dedup(docs, length)
    got = {r.doc_id: r for r in got}
    for i, (n, gone, runs, kept) in want.items():
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, brute.sha(kept)), i
    assert len(got) == len(want)
    return want


def test_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = same(byte_dedup.op6_byte_dedup(spark, sf_dir).collect(), docs)
    assert any(0 < x[1] < x[0] for x in want.values())


@pytest.mark.parametrize("seed", range(2))
def test_shifted_overlaps(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(chr(97 + x) for x in rng.integers(0, 4, 600)) for _ in range(4)]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(rng.integers(1, 6)):
            p = pool[rng.integers(0, 4)]
            a, n = rng.integers(0, 500), rng.integers(20, 420)
            text += p[a : a + n] + "é" * int(rng.integers(0, 2))
        docs.append((i, text))
    docs += [(100, "z" * 900), (101, "ab" * 150), (102, None), (103, ""), (104, "k" * 199), (105, "q" * 200), (106, "q" * 200), (107, "n" * 201)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("batch", F.lit(0)).withColumn("kept", F.lit(0))
    found = byte_dedup.remove_repeats(frame)
    want = same(found.collect(), docs)
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == {i: x[3] for i, x in want.items()}


def test_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + x) for x in np.random.default_rng(9).integers(0, 26, 300))
    frame = spark.createDataFrame([(1, text), (1, text), (None, "x" + text[5:])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in byte_dedup.remove_repeats(frame).collect())
    assert got == [("1", 300), ("1", 300), ("None", 295)]
    assert byte_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_bytes_that_defeat_polynomial_hashes(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    docs = [(1, "q" * 40 + one), (2, "r" * 40 + one.translate(str.maketrans("ab", "ba"))), (3, "x" * 150 + one[:1000])]
    same(byte_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_shard_beyond_memory():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(97, 100, 300).astype(np.uint8) for _ in range(5)]
    pieces.append(pieces[0][40:290])
    a, b = byte_dedup.repeated(pieces, 200, 1 << 30), byte_dedup.repeated(pieces, 200, 0)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
    assert a[0].sum() == a[5].sum() == 51 and not any(x.any() for x in a[1:5])
