import json
import zipfile

import pytest
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import documents, filters, project, resolve, retrieve, survivorship
from provena.operators.skew import salted_join
from provena.sources import readers, sinks
from provena.streaming import incremental


def column(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("v"))).collect()]


def test_needles(spark):
    hay = ["50% ABC resin", "ABC", "xABCx", "a-b c", None, "material GMA", "Höhe_1"]
    assert column(spark, hay, lambda c: T.needle_in(c, ["ABC"])) == [True, True, False, True, False, False, False]
    assert column(spark, hay, lambda c: T.needle_in(c, ["mat", "höhe 1"])) == [False, False, False, False, False, False, True]
    assert column(spark, ["resin"], lambda c: T.needle_in(c, ["epoxy resin"])) == [False]
    assert column(spark, ["x"], lambda c: T.needle_in(c, [])) == [True]


def test_document_ids(spark):
    assert column(spark, ["HE_12_WO2020123456A1_7", "wo2020123456a1.", "O2020123456A1", "3_WO2020123456A1::he", "none", None], T.doc_id) == ["12_WO2020123456A1", "WO2020123456A1", "WO2020123456A1", "3_WO2020123456A1", "", ""]
    assert column(spark, ["coll::7_O2020123456A1", "WO 2020/123456 A1", "", None, "x"], T.doc_key) == ["WO2020123456A1", "WO2020123456A1", "", "", ""]


def test_units_and_classes(spark):
    assert column(spark, ["salt spray 2 days, 48h and 1.5 weeks; 3x", "x5h", None], T.durations_hours) == [[48.0, 48.0, 252.0], [], None]
    assert column(spark, ["epoxy acrylate", "alkyd", "", None, "Silyl ester"], T.resin_system) == ["acrylic", "mixed/other", "unknown", "unknown", "silyl acrylate / silyl ester acrylic"]
    assert column(spark, ["Comparative C1", "c12", "Ref. 3", "E4", "x"], lambda c: T.example_kind(c, F.lit(""))) == ["comparative", "comparative", "reference", "inventive", "unknown"]
    assert column(spark, ["<table><tr><th>A</th><td> 1 </td></tr><tr><td></td></tr></table>"], T.table_cells) == [[["A", "1"], [""]]]
    assert column(spark, ['```json\n{"a": [1, 2,],}\n```'], T.clean_json) == ['{"a": [1, 2]}']
    assert column(spark, ["by ASTM D5402 and ISO 9227"], T.standard_of) == ["ASTM D5402"]


def test_filter_receipt_is_idempotent():
    aliases = {"resin_systems": {"pu": "polyurethane"}}
    moves = {"applications": {"antifouling": "coating_families"}}
    a = filters.normalise_request({"resin_systems": ["PU", "pu", " "], "applications": "antifouling", "colour": "red", "material_groups": [{"values": ["a", "a"]}, {"values": ["a"]}]}, aliases, moves)
    assert a.effective == {"resin_systems": ["polyurethane"], "coating_families": ["antifouling"], "material_groups": [{"values": ["a"]}]}
    assert a.unsupported == ["colour"] and len(a.adjustments) == 3
    assert filters.normalise_request(a.effective, aliases, moves).effective == a.effective


def test_empty_group_is_false(spark):
    rows = spark.createDataFrame([([("binder", "epoxy resin")],)], "m array<struct<role:string,name:string>>")
    check = lambda **g: rows.select(filters.material_group(F.col("m"), **g)).first()[0]
    assert not check() and check(roles=["Binder"]) and not check(roles=["filler"]) and check(values=["EPOXY", "zinc"]) and not check(values=["epoxy", "zinc"], match="all")


def test_synonyms():
    assert survivorship.expand_synonyms(["zinc", "x"], [["Zn", "zinc"], ["y"]]) == ["zinc", "x", "Zn"]


@pytest.mark.parametrize("negatives", [0, 1, 2])
def test_comparison_binds_only_one_baseline(spark, negatives):
    rows = spark.createDataFrame([(1, "p", "positive")] + [(10 + k, "p", "negative") for k in range(negatives)], "fact long, scope string, polarity string")
    got = resolve.comparison_pairs(rows, "fact", ["scope"], F.col("polarity") == "positive", F.col("polarity") == "negative").collect()
    assert len(got) == (1 if negatives == 1 else 0)


@pytest.mark.parametrize("docs", [1, 50])
def test_expand_selection_fills(spark, docs):
    pool = spark.range(50).select(F.col("id").alias("object_id"), (F.col("id") % docs).alias("doc"), (1.0 / (F.col("id") + 1)).alias("score"))
    assert retrieve.expand_selection(pool, "doc").count() == 30


def test_pages_are_disjoint_and_complete(spark):
    pool = spark.range(25).select(F.col("id").alias("object_id"))
    pages = [retrieve.page(pool, at, 10, [F.col("object_id")]).collect() for at in (0, 10, 20, 30)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert len({r.object_id for p in pages for r in p}) == 25
    assert [p[0].has_more for p in pages[:3]] == [True, True, False]


def test_degenerate_weights_and_dispatch(spark):
    one = spark.createDataFrame([(1, 0.5), (2, 0.5)], "object_id long, score double")
    assert {r.score for r in retrieve.fuse("weighted", {"a": one}, {"a": 0.9}).collect()} == {0.9}
    assert retrieve.fuse("rrf_x", {"a": one}, {}).where("object_id = 1").first().score == pytest.approx(1 / 61, abs=1e-8)


def test_salted_join_matches_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert sorted(map(str, salted_join(left, right, "k", "id", how).select("k", "id", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))


def test_wide_and_materials(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (1, "A", "x"), (1, "B", "y"), (2, "B", None)], "c long, b string, v string")
    got = {r.c: (r.a, r.b) for r in project.wide(rows, "c", "b", ["A", "B"], F.col("v")).collect()}
    assert got == {1: ("x", "y"), 2: ("", "")}
    rows = spark.createDataFrame([(1, ["epoxy", " "], ["zinc"])], "id long, resin array<string>, filler array<string>")
    assert {(r.role, r.name) for r in project.unify_materials(rows, "id", {"resin": F.col("resin"), "filler": F.col("filler")}).collect()} == {("resin", "epoxy"), ("filler", "zinc")}


def test_section_span_prefers_later_line(spark):
    docs = spark.createDataFrame([(1, "Abstract\nExamples\nx\nExamples\ny\nClaims\nz"), (2, "")], "doc long, text string")
    lines = documents.lines(docs, "doc", "text")
    got = documents.section_span(lines, "doc", F.when(F.col("line") == "Examples", 1).otherwise(0), F.col("line") == "Claims").collect()
    assert [(r.doc, r.start_line, r.end_line) for r in got] == [(1, 3, 5)]


def test_readers_and_sinks(spark, tmp_path):
    pack = tmp_path / "src" / "patents" / "WO1" / "kg_pack"
    pack.mkdir(parents=True)
    (pack / "facts.jsonl").write_text('﻿{"fact_id": "f1", "doc_id": "WO1"}\n\n{"fact_id": "f2"}\nnot json\n', encoding="utf-8")
    (pack / "other.jsonl").write_text("{}\n")
    rows = readers.read_jsonl(spark, str(tmp_path / "src"), "s1")
    assert [(r.kind, r.record_number, r.doc_hint) for r in rows.orderBy("record_number").collect()] == [("fact", 1, "WO1"), ("fact", 3, "WO1"), ("fact", 4, "WO1")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("patents/WO2/kg_pack/hyperedges.jsonl", '{"hyperedge_id": "h1"}\n\n{"hyperedge_id": "h2"}\n')
        z.writestr("readme.txt", "x")
    zipped = readers.read_zip(spark, str(tmp_path / "a.zip"), "s2")
    assert [(r.kind, r.record_number, r.doc_hint) for r in zipped.orderBy("record_number").collect()] == [("hyperedge", 1, "WO2"), ("hyperedge", 3, "WO2")]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 2, "collection_id": "c", "sources": [{"source_id": "s1", "root": str(tmp_path / "src")}, {"source_id": "s2", "root": str(tmp_path / "a.zip"), "expected_hyperedges": 3}]}, indent=1))
    manifest = readers.load_manifest(spark, str(tmp_path / "m.json"))
    every = readers.read_manifest(spark, manifest)
    assert every.count() == 5
    assert [(r.source_id, r.n) for r in readers.expect_counts(every, manifest).collect()] == [("s2", 2)]
    good, bad = readers.parse(rows, "fact_id string, doc_id string")
    assert sorted(r.fact_id for r in good.collect()) == ["f1", "f2"] and [r.raw for r in bad.collect()] == ["not json"]
    flat = readers.flatten_json(spark.createDataFrame([(1, '{"a": {"b": [0, "x", {"c": 2}]}, "d": false, "e": ""}'), (2, "no"), (3, None)], "id long, raw string"), "raw", ["id"])
    assert {(r.id, r.path, r.text) for r in flat.collect()} == {(1, "a.b[1]", "x"), (1, "a.b[2].c", "2")}
    assert sinks.write_jsonl(good, str(tmp_path / "out")) == good.count()


def test_bad_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 2, "sources": [{"source_id": "a", "root": "x"}]}))
    with pytest.raises(ValueError, match="collection_id"):
        readers.load_manifest(spark, str(tmp_path / "m.json"))


def test_merge_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, collection_id string")
    sinks.merge_table(frame([(1, "a", "x"), (2, "b", "x")]), path, ["k"])
    sinks.merge_table(frame([(2, "B", "x"), (3, "c", "y")]), path, ["k"])
    assert {(r.k, r.v) for r in sinks.read_table(spark, path).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    (tmp_path / "t" / "v3").mkdir()  # a run that broke off
    assert sinks.read_table(spark, path).count() == 3
    sinks.merge_table(frame([(4, "d", "y")]), path, ["k"])
    assert sinks.read_table(spark, path).count() == 4 and sinks._versions(spark, path) == [2, 3]
    path = str(tmp_path / "p")
    sinks.replace_collection(frame([(1, "a", "x"), (2, "b", "y")]), path)
    sinks.replace_collection(frame([(9, "z", "y")]), path)
    assert {(r.k, r.collection_id) for r in spark.read.parquet(path).collect()} == {(1, "x"), (9, "y")}


def test_stream_maintains_a_table(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: incremental.maintain(incremental.follow_jsonl(spark, str(inbox), "k long, v string, at long"), str(tmp_path / "t"), ["k"], [F.desc("at"), "v"], str(tmp_path / "cp")).awaitTermination(60)
    (inbox / "a.json").write_text('{"k": 1, "v": "a", "at": 1}\n{"k": 1, "v": "b", "at": 2}\n{"k": 2, "v": "c", "at": 1}\n')
    run()
    (inbox / "b.json").write_text('{"k": 2, "v": "d", "at": 5}\n{"k": 1, "v": "late", "at": 0}\n')
    run()
    assert {(r.k, r.v) for r in sinks.read_table(spark, str(tmp_path / "t")).collect()} == {(1, "b"), (2, "d")}


def test_more_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    sinks.append_jsonl(rows, str(tmp_path / "log"))
    sinks.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.schema("k long, v string").json(str(tmp_path / "log")).count() == 4
    sinks.write_wide_csv(rows, str(tmp_path / "csv"), ["v", "k"])
    assert sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()), key=str) == [("a", "1"), (None, "2")]
    edges = spark.createDataFrame([("A",), ("A",), ("B",)], "edge_type string")
    got = sinks.write_manifest(spark, str(tmp_path / "manifest"), {"rows": rows, "none": rows.limit(0)}, edges)
    assert {tuple(r) for r in got.collect()} == {("edge_type", "A", 2), ("edge_type", "B", 1), ("table", "rows", 2), ("table", "none", 0)}


def test_scopes_are_tables(spark):
    from provena.operators import filters

    rows = spark.createDataFrame([(1, "d1", None), (2, "d1", "d9"), (3, "d2", "d2"), (4, None, None)], "k long, doc string, own string")
    for scope in (["d1", "d2", "d1"], spark.createDataFrame([("d1",), ("d2",)], "x string")):
        assert sorted(r.k for r in filters.in_scope(rows, "doc", scope, "own").collect()) == [1, 3]
    assert filters.in_scope(rows, "doc", []).count() == 0
    plan = filters.in_scope(rows, "doc", ["d1"], "own")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_keep_groups_whole(spark):
    rows = spark.createDataFrame([("p", k, n) for k, n in ((1, 40), (1, 30), (2, 20), (3, 200), (4, 10))], "packet string, sample long, size long")
    got = {r["sample"]: (r.batch, r.oversize) for r in retrieve.plan_batches(rows, "packet", "sample", "size", 100).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, True), 4: (2, False)}


def test_scratch_tables_are_released(spark):
    from provena import runtime

    kept = runtime.materialise(spark.range(5), "scratch")
    assert kept.count() == 5 and runtime.release(spark) >= 1
    assert runtime.release(spark) == 0


def test_inventories_and_pages_of_a_release(spark):
    from provena.operators import audit

    candidate = spark.createDataFrame([("a", "x\n"), ("b", "x\r\ny"), ("c", "z"), ("e", None), ("f", None)], "name string, body string")
    live = spark.createDataFrame([("a", "x\n"), ("b", "x\ny"), ("c", "Z"), ("d", "w"), ("f", "")], "name string, body string")
    got = {r["name"]: (r.candidate_sha256 is None, r.live_sha256 is None, r.newlines_only) for r in audit.inventory_differences(candidate, live, "name", "body").collect()}
    assert got == {"b": (False, False, True), "c": (False, False, False), "d": (True, False, False), "e": (False, True, False)}
    assert audit.inventory_differences(candidate, candidate, "name", "body").count() == 0
    page = lambda ids, at: spark.createDataFrame([(i, at + k) for k, i in enumerate(ids, 1)], "id string, position int")
    good = audit.page_gates([page("ab", 0), page("cd", 2)], "id", "position", 2)
    assert [r.ok for r in good.collect()] == [True, True]
    for pages in ([page("ab", 0), page("bc", 2)], [page("ab", 0), page("cd", 3)], [page("aa", 0), page("cd", 2)], [page("ab", 0), page("c", 2)]):
        assert not all(r.ok for r in audit.page_gates(pages, "id", "position", 2).collect())


def test_context_without_values_has_no_conflicts(spark):
    from provena.operators import project

    facts = spark.createDataFrame([(1, 1, 1, "a", "x"), (1, 1, 1, "a", "x"), (1, 2, 1, "b", "x"), (2, 3, 2, None, None), (3, 4, 3, "unknown", ""), (4, 5, 4, "a", "x"), (4, 6, 4, "a", "y")], "k int, fact int, evidence int, v string, state string")
    records = project.field_records(facts, "k", "fact", "evidence", {"f": F.array("v")}, F.lit("fact_explicit"))
    assert sorted((r.k, r.value, r.fact_count, r.place) for r in records.collect()) == [(1, "a", 1, 1), (1, "b", 1, 2), (4, "a", 2, 1)]
    got = project.context_quality(facts, "k", "fact", "evidence", F.lit(None).cast("double"), F.lit(0.5), F.col("state"), records, ["f"]).collect()
    assert sorted((r.k, r.fact_count, r.n_low, r.mean_confidence, r.resolution_status, r.conflicts, r.conflict_count, r.primary_f) for r in got) == [
        (1, 2, 0, None, "x", "f", 1, None), (2, 1, 0, None, None, "", 0, None), (3, 1, 0, None, None, "", 0, None), (4, 2, 0, None, "mixed", "", 0, "a"),
    ]
