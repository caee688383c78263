"""Questions, seeds, units and layouts on rows."""

import json

from pyspark.sql import functions as F

from provena.operators import extract, intent
from provena.sources import packs, sinks


def test_comparisons_read_the_words_around(spark):
    want = {
        "salt spray of more than 1,000 h or at least 240 hours": [("duration_hours", "ge", 0.0), ("duration_hours", "ge", 240.0)],
        "dry film thickness no more than 3.5 mils": [("film_thickness_um", "le", 88.9)],
        "film thickness over 80 um and 500 hours": [("film_thickness_um", "gt", 80.0)],
        "盐雾超过 2 周": [("duration_hours", "gt", 336.0)],
        "nothing of 5 kg": [], "": [], None: [],
    }
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(want)], "k long, q string")
    got = {r.k: [(c["kind"], c["op"], round(c["value"], 6)) for c in r.c] for r in rows.select("k", intent.comparisons(F.col("q")).alias("c")).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_comparisons_work_each_part_out_once(spark):
    text = "5 kg,\n" + "more than 3 d; 7 hx " + "of any kind " * 4 + "7 h\n\nunder 2 wk"
    rows = spark.createDataFrame([(text,)], "q string").select(intent.comparisons(F.col("q")).alias("c"))
    assert [tuple(c) for c in rows.first()["c"]] == [("duration_hours", "gt", 72.0), ("duration_hours", "lt", 7.0), ("duration_hours", "lt", 336.0)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 4


def test_thickness_only_from_film_fields(spark):
    rows = spark.createDataFrame([("75 µm, 3 mils",), ("60",), (None,)], "v string")
    got = lambda path: [r[0] for r in rows.select(F.transform(intent.thickness_um(path, F.col("v")), lambda x: F.round(x, 3))).collect()]
    assert got("sample.dft") == [[75.0, 76.2], [60.0], []]
    assert got("film_thickness.value") == [[75.0, 76.2], [], []]
    assert got("film_thickness_loss") == got("length") == [[], [], []]


def test_examples_used_for(spark):
    rows = spark.createDataFrame([("used for C2",), ("used for 12",), ("Used for 3",)], "v string")
    assert [r[0] for r in rows.select(extract.example_id(F.col("v"))).collect()] == ["C2", "I2", "3"]


def test_units(spark, tmp_path):
    def unit(name, **files):
        folder = tmp_path / "data" / "units" / name
        folder.mkdir(parents=True)
        for k, v in files.items():
            (folder / (k.replace("_txt", ".txt") if k.endswith("_txt") else f"{k}.json")).write_text(v if isinstance(v, str) else json.dumps(v), encoding="utf-8")

    unit("U_WO1_T1", meta={"unit_id": "u1", "doc_id": "WO1", "unit_type": "table", "page": 3, "caption_footnote_text": "meta"}, caption_txt="Table 1", vlm_description={"description": "d", "identified_entities": ["A", "B"]}, route_decision={"route": "register_layer1"}, matched_paragraphs={"matches": [{"p": 1}, {"p": 2}]})
    unit("U_WO2_F12", meta={"unit_type": "figure", "caption_footnote_text": "from meta"}, caption_txt=" ")
    unit("U_WO3_T1", caption_txt="no meta")
    unit("U_WO4_T1", meta="not json")
    got = {r.unit_id: r for r in packs.read_units(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "U_WO2_F12"}
    one, two = got["u1"], got["U_WO2_F12"]
    assert (one.doc_id, one.page, one.caption, one.entities, one.context_only, one.paragraphs) == ("WO1", 3, "Table 1", ["A", "B"], True, 2)
    assert (two.doc_id, two.page, two.caption, two.entities, two.context_only, two.paragraphs) == ("WO2", None, "from meta", [], False, 0)
    assert set(one.files) == {"meta.json", "caption.txt", "vlm_description.json", "route_decision.json", "matched_paragraphs.json"}


def test_seeds(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- ('NOT', 'A', 'row')\nINSERT INTO nodes (id, type, name) VALUES\n ('MAT_A', 'MAT', 'it''s, (a) name'), -- note\n ('MAT_B', 'MAT', NULL);\ninsert into \"aliases\" values ('zinc', 'MAT_A');\n")
    (tmp_path / "b.sql").write_text("INSERT INTO nodes VALUES ('MAT_A', 'X', 'later'), ('MAT_C', 'MAT', 7);")
    seeds = packs.read_seeds(spark, str(tmp_path))
    assert sorted((r.file, r.table, r.row, r["values"]) for r in seeds.collect()) == [
        ("a.sql", "aliases", 1, ["zinc", "MAT_A"]), ("a.sql", "nodes", 1, ["MAT_A", "MAT", "it's, (a) name"]), ("a.sql", "nodes", 2, ["MAT_B", "MAT", None]),
        ("b.sql", "nodes", 1, ["MAT_A", "X", "later"]), ("b.sql", "nodes", 2, ["MAT_C", "MAT", "7"]),
    ]
    assert {tuple(r) for r in packs.seed_nodes(seeds, "nodes").collect()} == {("MAT_A", "MAT", "it's, (a) name"), ("MAT_B", "MAT", None), ("MAT_C", "MAT", "7")}


def test_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"type": "text", "text": "one", "page_idx": 0, "bbox": [1, 2, 3, 4]}, {"type": "table", "content": "two", "page_idx": 1}]))
    (tmp_path / "b.json").write_text(json.dumps([{"page_num": 4, "page_size": {"w": 500, "h": 2000}, "blocks": [{"type": "Text", "content": "x", "bbox": [-5, 1, 250.25, 4001]}]}]))
    (tmp_path / "c.json").write_text(json.dumps({"pages": [{"page_num": 0, "page_size": {"w": 1000, "h": 1000}, "blocks": [{"type": "Text", "content": "y", "bbox": [0.5, 1.5, 2, 3]}]}]}))
    got = {(r.file, r.block): (r.type, r.text, r.page, r.bbox) for r in packs.read_layout(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.json", 0): ("text", "one", 0, [1, 2, 3, 4]), ("a.json", 1): ("table", "two", 1, None),
        ("b.json", 0): ("Text", "x", 4, [0, 0, 500, 1000]), ("c.json", 0): ("Text", "y", 0, [0, 2, 2, 3]),
    }


def test_scan_by_ids_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    assert [r.v for r in packs.scan_by_ids(rows, "k", [2, 2, 9]).collect()] == ["b"] and packs.scan_by_ids(rows, "k", []).count() == 0
    sinks.append_csv(rows, str(tmp_path / "log"))
    sinks.append_csv(rows, str(tmp_path / "log"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 6


def test_conflicting_packs_and_budgets(spark):
    import pytest

    from provena.operators import audit, survivorship

    a = spark.createDataFrame([("n1", "x"), ("n2", "y")], "id string, name string")
    nodes, odd = survivorship.union_packs([a, a, spark.createDataFrame([("n2", "z")], a.schema)], "id", ["name"])
    assert [(r.id, r.name, r.copies) for r in nodes.collect()] == [("n1", "x", 2)]
    with pytest.raises(ValueError, match="n2"):
        survivorship.require_no_conflicts(odd, "id")
    survivorship.require_no_conflicts(odd.limit(0), "id")
    rows = spark.range(10).selectExpr("id % 3 AS k")
    assert tuple(audit.budgeted_distinct(rows, "k", 10).first()) == (3, 10, "complete")
    assert audit.budgeted_distinct(rows, "k", 4).first()["state"] == "incomplete"
    assert tuple(audit.budgeted_distinct(rows.limit(0), "k").first()) == (0, 0, "complete")
