import zlib

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from provena.llm import exact_dedup, mixing, quality
from test_text_ops import check_packing

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    (_, good), (_, exact), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    columns = docs.columns

    kept = good(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((i in ids) == labels[i] for i in held) >= 0.9 * len(held)
    scores = quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert ids == {r.doc_id for r in scores.where(f"score >= {quality.THRESHOLD}").collect()}

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    last = {}
    for i, t in rows:
        key = (t or "").translate(LOWER)
        last[key] = max(i, last.get(key, i))
    one = exact(spark, kept, sf_dir).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == set(last.values())

    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = brute.components(rows, 5)
    apart = near(spark, one, sf_dir).cache()
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == {i for i, (_, c) in want.items() if c == i}

    drawn = mix(spark, apart, sf_dir).cache()
    decided = mixing.mix(apart)
    assert drawn.columns == columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in decided.where("kept").collect()}

    pieces = pack(spark, drawn, sf_dir)
    assert check_packing([(r.doc_id, r.text) for r in drawn.collect()], pieces.collect()) == 0


def test_odd_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit(True)).withColumn("topic", F.lit(None).cast("string"))
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, "A lost text. " * 30, None, None, None, True, None), (5, None, "en", "a", 0, True, None), (5, "", "en", "a", 0, True, None)], docs.schema))
    for name, rows in (("odd", docs.unionByName(odd)), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, at, f"{tmp_path}/{name}").columns == docs.columns
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (got > 0) == (name == "odd")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/odd/labels.parquet")
    with pytest.raises(ValueError):
        corpus_pipeline.quality_filter(spark, docs, f"{tmp_path}/odd")


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.agg({"length": "max"}).first()[0] <= 1024
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
