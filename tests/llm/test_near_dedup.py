import random

import numpy as np
from pyspark.sql import functions as F

import brute
from provena.llm import links, near_dedup


def check(got, docs, n=2):
    want = brute.components(docs, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_matches_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(near_dedup.op10_near_dedup(spark, sf_dir).collect(), docs)


def test_chains_hot_buckets_and_ties(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    docs, text = [], list(base)
    for i in range(10):  # a chain: each a step from the last, its ends far apart
        text[rng.randrange(60)] = f"x{i}"
        docs.append((100 + i, " ".join(text)))
    passage = [f"p{k}" for k in range(40)]
    for i in range(40):  # many share a passage but are no links
        docs.append((200 + i, " ".join(passage + [f"q{i}_{k}" for k in range(14 + i % 3)])))
    docs += [(1, " ".join(base).upper()), (2, " ".join(base)), (3, None), (4, ""), (5, " "), (6, "one"), (7, "ONE"), (8, "a b"), (9, "b a"), (10, "É é"), (11, "é é")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit(1))
    check(near_dedup.group(frame, n=2).collect(), docs)


def test_null_ids_repeats_and_empty(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lone words here"), (2, "a b c d e f")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.group(frame, n=2).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "None", True)]
    assert near_dedup.group(frame.limit(0)).count() == 0
    assert near_dedup.keep_one(frame, n=2).count() == 4  # rows that share an id share a decision


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(20):
        shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (400, 50, 60))
        x, y = np.sort(np.concatenate([shared, a])), np.sort(np.concatenate([shared, b]))
        s, _ = near_dedup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        errors.append((s[0] == s[1]).mean() - 400 / 510)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_words_that_defeat_polynomial_hashes(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{one} x"), (2, f"{one.translate(str.maketrans('ab', 'ba'))} x"), (3, f"{one} x")]
    check(near_dedup.group(spark.createDataFrame(docs, "doc_id long, text string"), n=2).collect(), docs)


def test_components_of_long_chains_and_a_star(spark):
    name = lambda k: k.to_bytes(3, "big")
    order = list(range(5000))
    random.Random(2).shuffle(order)
    pairs = [(name(a), name(b)) for a, b in zip(order, order[1:], strict=False)]
    pairs += [(name(6000 + k), name(6001 + k)) for k in range(500)] + [(name(9000), name(8000 - k)) for k in range(900)]
    got = {bytes(r.node): bytes(r.root) for r in links.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert len(got) == 5000 + 501 + 901
    assert all(got[name(k)] == name(0) for k in order) and all(got[name(6000 + k)] == name(6000) for k in range(501))
    assert got[name(9000)] == got[name(7500)] == name(7101)
    assert links.components(spark.createDataFrame([], "a binary, b binary")).count() == 0
