"""Queries on small tables made for what a cut would lose."""

import random

import duckdb
import pytest

from provena.operators import resolve, retrieve
from provena.plans import evaluation, registry


def test_golden_targets_finds_passages_without_whole_first_words(spark, tmp_path):
    text = 'He said "one two three four five six seven eight nine" and  left\nat once.'
    docs = [(1, text), (2, "only four words here"), (3, None), (4, ""), (5, " one two three four five six seven eight nine ten")]
    passages = [
        "one two three four five six seven eight", "ne two three four five six seven eight ni", "three four", "words", "only four words here", "e two three four five si",
        " two three four five six seven eight ", "and  left\nat", "nine\" and  left\nat once.", "two three  four five six seven eight nine", "", None, "absent",
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["golden_targets"]).fetchall())
    assert sorted(map(tuple, registry.queries()["golden_targets"](spark, str(tmp_path)).collect())) == want
    assert {(0, 1), (1, 1), (2, 1), (2, 5), (3, 2), (4, 2)} <= set(want)


def test_mentions_finds_aliases_of_any_length(spark):
    texts = spark.createDataFrame([(1, "a sheet of cold rolled low carbon steel, coated"), (2, "Low Carbon"), (3, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([("cold rolled low carbon steel", "C1"), ("low carbon", "C1"), ("sheet of cold rolled", "C2"), ("steel", "C3"), (None, "C4")], "alias_text string, canonical_id string")
    got = {tuple(r) for r in resolve.mentions(texts, "doc_id", "text", aliases).collect()}
    assert got == {(1, "C1", "cold rolled low carbon steel"), (1, "C2", "sheet of cold rolled"), (1, "C3", "steel"), (2, "C1", "low carbon")}
    assert resolve.mentions(texts, "doc_id", "text", aliases.limit(0)).count() == 0


def test_answer_validation_with_more_than_9999_samples_in_a_packet(spark, tmp_path):
    spark.range(10_020).selectExpr("id AS l_orderkey", "id * 77 + 1 AS l_partkey", "id * 40 AS l_suppkey", "1 AS l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert con.sql(registry.oracle_sql()["answer_validation"]).fetchall() == [(0, "answer_sample_identity")]
    assert registry.queries()["answer_validation"](spark, str(tmp_path)).collect() == [(0, "answer_sample_identity")]


@pytest.mark.parametrize("bonus", [0.0, 0.05])
def test_nearest_over_several_blocks_is_whole(spark, monkeypatch, bonus):
    for name, n in (("QUERY_BLOCK", 7), ("OBJECT_BLOCK", 16), ("STRIP", 3)):
        monkeypatch.setattr(retrieve, name, n)
    draw = random.Random(4)
    vectors = [[draw.uniform(-1, 1) for _ in range(5)] for _ in range(40)]
    rows = [(k, draw.choice([0, 1, 2, None]), vectors[k % 40 if k < 60 else 0]) for k in range(120)] + [(120, 1, None)]  # 60 copies of one
    table = spark.createDataFrame(rows, "object_id long, label int, embedding array<float>")
    rows = [tuple(r) for r in table.collect()]
    queries = table.where("object_id % 8 = 0").selectExpr("object_id AS query_id", "label AS query_label", "embedding AS q")
    got = {}
    for r in retrieve.nearest(queries, table, 12, bonus).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.object_id, r.score))
    assert set(got) == {k for k, _, _ in rows if k % 8 == 0}
    for q, label, x in (r for r in rows if r[0] % 8 == 0):
        score = {k: x and y and round(round(sum(a * b for a, b in zip(x, y, strict=True)), 6) + (bonus if m is not None and m == label else 0), 6) for k, m, y in rows if k != q}
        best = sorted(score, key=lambda k: (score[k] is None, -(score[k] or 0), k))[:12]
        assert sorted(got[q]) == [(n, k, score[k]) for n, k in enumerate(best, 1)]


def test_targets_of_a_label_are_two_rows(spark, sf_dir):
    t = registry.Tables(spark, sf_dir)
    assert evaluation._targets(t).count() <= 2 * t.embeddings.where("vec_id % 20 = 0").count()
