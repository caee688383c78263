"""Sources and sinks on the fixture: tables are written to the scratch folder and read back; and row operators without a query of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import extract as X
from provena.operators import filters, project, survivorship
from provena.plans.registry import query
from provena.runtime import scratch_path
from provena.sources import readers, sinks


def _packs(t, rows: DataFrame, name: str) -> str:
    """Rows as JSON lines in files called ``name``, one folder ``patents/D<k>/kg_pack`` a part file."""
    spark, root = t.spark, scratch_path(t.spark, "packs")
    sinks.write_jsonl(rows, f"{root}/written")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{root}/written")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for k, part in enumerate(parts):
        fs.mkdirs(hadoop.Path(f"{root}/src/patents/D{k}/kg_pack"))
        fs.rename(hadoop.Path(part), hadoop.Path(f"{root}/src/patents/D{k}/kg_pack/{name}"))
    return f"{root}/src"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 'fact' AS kind, 's1' AS source_id, true AS hinted, true AS numbered FROM orders")
def jsonl_scan(t):
    """SRC-01, SRC-03, SNK-01, PRJ-20: written as JSON lines, scanned with provenance, parsed."""
    rows = readers.read_jsonl(t.spark, _packs(t, t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "facts.jsonl"), "s1")
    good, _ = readers.parse(rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    return good.select("o_orderkey", "o_custkey", "o_orderstatus", "kind", "source_id", F.col("doc_hint").rlike("^D[0-9]+$").alias("hinted"), (F.col("record_number") >= 1).alias("numbered"))


@query("SELECT * FROM (VALUES ('s2', 1::BIGINT, 1::BIGINT)) v(source_id, missing, sources)")
def expected_counts(t):
    """SRC-04, SRC-05: declared counts against those that a manifest's sources have."""
    root = _packs(t, t.customer.select("c_custkey"), "hyperedges.jsonl")
    n = t.customer.count()
    manifest = {"schema_version": 2, "collection_id": "c", "sources": [{"source_id": "s1", "root": root, "expected_hyperedges": n}, {"source_id": "s2", "root": root, "expected_hyperedges": n + 1}]}
    off = readers.expect_counts(readers.read_manifest(t.spark, manifest), manifest)
    return off.select("source_id", (F.col("expected") - F.col("n")).alias("missing"), F.lit(1).cast("long").alias("sources"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def wide_csv(t):
    """SNK-03: columns in a fixed order, with a header, read back by name."""
    path = scratch_path(t.spark, "csv")
    sinks.write_wide_csv(t.nation, path, ["n_name", "n_regionkey", "n_nationkey"])
    return t.spark.read.option("header", "true").csv(path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("SELECT c_mktsegment, 2 * count(*)::BIGINT AS n FROM customer GROUP BY 1")
def append_log(t):
    """SNK-07: a log that is only ever added to."""
    path = scratch_path(t.spark, "log")
    rows = t.customer.select("c_custkey", "c_mktsegment")
    sinks.append_jsonl(rows, path)
    sinks.append_jsonl(rows, path)
    return t.spark.read.schema(rows.schema).json(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_mktsegment AS collection_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS balance FROM customer WHERE c_mktsegment != 'BUILDING' OR c_acctbal > 4000")
def collection_replace(t):
    """SNK-06: one collection is replaced, the others stay."""
    path = scratch_path(t.spark, "collections")
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("collection_id"), F.col("c_acctbal").alias("balance"))
    sinks.replace_collection(rows, path)
    sinks.replace_collection(rows.where("collection_id = 'BUILDING' AND balance > 4000").withColumn("balance", F.lit(0).cast("double")), path)
    return t.spark.read.parquet(path).select("c_custkey", "collection_id", "balance")


@query("""SELECT 'table' AS kind, 'nation' AS name, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'table', 'orders', count(*) FROM orders UNION ALL SELECT 'edge_type', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def manifest_sink(t):
    """SNK-02: counts of tables and a histogram of edge types."""
    edges = t.orders.select(F.col("o_orderstatus").alias("edge_type"))
    return sinks.write_manifest(t.spark, scratch_path(t.spark, "manifest"), {"nation": t.nation, "orders": t.orders}, edges)


@query("""SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders WHERE o_totalprice >= 170000 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_totalprice < 170000""")
def merged_table(t):
    """SNK-04: two merges by key into a stored table; the better row by an order stays."""
    path = scratch_path(t.spark, "merged")
    old = t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.lit(1).alias("at"))
    sinks.merge_table(old, path, ["o_orderkey"], [F.desc("at"), "price"])
    sinks.merge_table(old.where("price < 170000").select("o_orderkey", F.lit(-1.0).alias("price"), F.lit(2).alias("at")), path, ["o_orderkey"], [F.desc("at"), "price"])
    sinks.merge_table(old.where("price < 80000").select("o_orderkey", F.lit(-9.0).alias("price"), F.lit(0).alias("at")), path, ["o_orderkey"], [F.desc("at"), "price"])
    return sinks.read_table(t.spark, path).select("o_orderkey", "price")


@query("""SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') != '0' UNION ALL SELECT event_id, 'more[1].t', event_type FROM events""")
def flatten_scalars(t):
    """PRJ-05: scalars of open JSON with their paths; nulls, blanks, zeros and false go."""
    raw = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "none": null, "no": false, "more": [0, {"t": "'), "event_type", F.lit('"}]}'))
    return readers.flatten_json(t.events.select("event_id", raw.alias("raw")), "raw", ["event_id"]).select("event_id", "path", "text")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'comparative' WHEN 1 THEN 'reference' WHEN 2 THEN 'inventive' WHEN 3 THEN 'inventive' WHEN 4 THEN 'comparative' ELSE 'unknown' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'ASTM B' || p_size WHEN p_size % 3 = 0 THEN 'ISO ' || p_size || '-1' ELSE '' END AS standard FROM part""")
def example_kinds(t):
    """PRJ-13, PRJ-18: kinds of examples, and the test standard a note names."""
    k = F.col("p_size") % 6
    label = F.when(k == 0, "Comparative 1").when(k == 1, "commercial paint").when(k == 2, "E12").otherwise("sample")
    hint = F.when(k == 3, "positive").when(k == 4, "negative")
    note = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("tested by ASTM B"), "p_size")).when(F.col("p_size") % 3 == 0, F.concat(F.lit("see ISO "), "p_size", F.lit("-1, DIN 5"))).otherwise("none")
    return t.part.select("p_partkey", T.example_kind(label, hint).alias("kind"), T.standard_of(note).alias("standard"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity < 10) GROUP BY 1, 2")
def noise_facts(t):
    """FLT-17: facts without cell, text and value go."""
    cell = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise(" ")
    said = F.when(F.col("l_linestatus") == "O", "unknown").otherwise("text")
    kept = t.lineitem.where(~filters.is_noise(cell, said, F.when(F.col("l_quantity") >= 10, F.col("l_quantity"))))
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT p_partkey, role, name FROM (SELECT p_partkey, 'resin' AS role, p_brand AS name FROM part UNION ALL SELECT p_partkey, 'resin', p_type FROM part UNION ALL SELECT p_partkey, 'pigment', p_name FROM part WHERE p_size > 10)""")
def material_rows(t):
    """PRJ-33: one row a material, with its role, from all slots."""
    none = F.array().cast("array<string>")
    return project.unify_materials(t.part, "p_partkey", {"resin": F.array("p_brand", "p_type", F.lit(" "), F.col("p_brand")), "pigment": F.when(F.col("p_size") > 10, F.array("p_name")), "wax": none})


@query("""SELECT c_custkey, substr('customer: ' || c_name || ' | segment: ' || c_mktsegment, 1, 30) AS item FROM customer""".replace(": ", ":"))
def search_items(t):
    """PRJ-25: what a hit shows, cut to its length."""
    return t.customer.select("c_custkey", X.render([("customer", F.col("c_name")), ("blank", F.lit(" ")), ("segment", F.col("c_mktsegment"))], 30, " | ").alias("item"))


@query("""SELECT * FROM (VALUES ('adjustment', 'polarity: good -> positive'), ('effective', 'doc_ids=D1,D2'), ('effective', 'polarity=positive'), ('budget', 'top_k: 9 -> 50'), ('query', 'zinc primer'), ('query', 'zinc primer galvanic anode'), ('synonym', 'cfrp'), ('synonym', 'carbon fibre'), ('unsupported', 'colour')) v(what, value)""")
def request_receipt(t):
    """FLT-24, PRJ-24, PRJ-32, SET-08: what a request comes to."""
    got = filters.normalise_request({"doc_ids": ["D1 ", "D2", "D1"], "polarity": "good", "colour": "red"}, {"polarity": {"good": "positive"}})
    rows = [("effective", f"{k}={','.join(v)}") for k, v in got.effective.items()] + [("unsupported", x) for x in got.unsupported] + [("adjustment", x) for x in got.adjustments]
    rows += [("query", q) for q in X.expand_query("zinc primer", {"zinc": ["galvanic anode", "primer"], "epoxy": ["resin"]})]
    rows += [("budget", x) for x in X.budget({"top_k": 9}, {"top_k": 50, "candidate_k": 100})[1]]
    rows += [("synonym", x) for x in survivorship.expand_synonyms(["cfrp"], [["CFRP", "carbon fibre"], ["other"]])]
    return t.spark.createDataFrame(rows, "what string, value string")
