"""Questions, answers and record scans on the fixture: parts give questions, orders observations, line items facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.operators import answer, audit, documents, intent, resolve
from provena.operators import extract as X
from provena.operators import retrieve as R
from provena.operators import survivorship as S
from provena.plans.registry import query
from provena.sources import packs

_QUESTION = """CASE p_size % 8 WHEN 0 THEN 'CFRP panel as substrate, salt spray over ' || p_size * 10 || ' hours' WHEN 1 THEN 'epoxy zinc-rich primer with film thickness < ' || p_size || ' um'
WHEN 2 THEN 'zinc dust primer, cross-cut adhesion' WHEN 3 THEN 'film thickness under 4 mils and seawater immersion' WHEN 4 THEN 'film thickness <' || p_size || ' mils' WHEN 5 THEN 'cfrp only'
WHEN 6 THEN 'salt fog > 500h and >= 1000 hours' ELSE p_name END"""


@query(f"""WITH q AS (SELECT p_partkey, lower({_QUESTION}) AS t FROM part), z AS (SELECT *, contains(t, 'zinc-rich') OR contains(t, 'zinc dust') AS zinc, contains(t, 'epoxy') AS epoxy, contains(t, 'salt spray') OR contains(t, 'salt fog') AS salt FROM q),
c AS (SELECT *, CASE WHEN salt THEN list_transform(regexp_extract_all(t, '(?:>=|>)\\s*([0-9.]+)\\s*h', 1), lambda x: CAST(x AS DOUBLE)) ELSE [] END AS h, CASE WHEN contains(t, 'thickness') THEN list_transform(regexp_extract_all(t, '<\\s*([0-9]+) um', 1), lambda x: CAST(x AS DOUBLE)) || list_transform(regexp_extract_all(t, '<\\s*([0-9]+) mil', 1), lambda x: x::DOUBLE * 25.4) ELSE [] END AS um FROM z)
SELECT p_partkey, CASE WHEN contains(t, 'cfrp') AND contains(t, 'substrate') THEN 'CFRP;carbon fiber reinforced plastic;carbon fiber reinforced composite' ELSE '' END AS hard_substrates, CASE WHEN zinc AND epoxy THEN 'epoxy' ELSE '' END AS hard_systems,
CASE WHEN zinc AND NOT epoxy THEN 'epoxy' ELSE '' END AS soft_systems, CASE WHEN zinc THEN 'zinc powder;zinc dust;zinc pigment' ELSE '' END AS hard_materials, CASE WHEN zinc THEN 'primer' ELSE '' END AS hard_coating_types,
concat_ws(';', CASE WHEN salt THEN 'salt spray;ASTM B117;ISO 9227' END, CASE WHEN contains(t, 'seawater immersion') THEN 'chemical immersion;seawater immersion' END) AS soft_tests, CASE WHEN contains(t, 'adhesion') THEN 'adhesion' ELSE '' END AS soft_properties,
len(h)::INTEGER AS hours, round(coalesce(list_sum(h), 0), 3)::DOUBLE AS hour_sum, len(um)::INTEGER AS lengths, round(coalesce(list_sum(um), 0), 3)::DOUBLE AS um_sum FROM c""")
def query_facets(t):
    """PRJ-23: hard and soft facets and numeric constraints of questions."""
    q = F.expr(_QUESTION)
    limits = intent.constraints(q)
    of = lambda unit: F.filter(limits, lambda c: c["unit"] == unit)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, c: s + c["value"]), 3)
    found = {k: F.array_join(v, ";").alias(k) for k, v in intent.facets(q).items()}
    return t.part.select("p_partkey", *found.values(), F.size(of("h")).alias("hours"), total(of("h")).alias("hour_sum"), F.size(of("um")).alias("lengths"), total(of("um")).alias("um_sum"))


_COMPARED = """CASE p_size % 5 WHEN 0 THEN 'salt spray of at least ' WHEN 1 THEN 'salt spray > ' WHEN 2 THEN 'film thickness no more than ' WHEN 3 THEN 'what is below ' ELSE 'salt-spray for ' END || p_size || CASE p_partkey % 3 WHEN 0 THEN ' hours' WHEN 1 THEN ' days' ELSE ' mils' END || ', ' || repeat('of any kind ', 5) || 'with 5x 7 h'"""


@query("""WITH b AS (SELECT p_partkey, p_size % 5 AS o, p_partkey % 3 AS u, p_size FROM part),
c AS (SELECT p_partkey, CASE WHEN u < 2 THEN 'duration_hours' ELSE 'film_thickness_um' END AS kind, CASE o WHEN 0 THEN 'ge' WHEN 1 THEN 'gt' WHEN 2 THEN 'le' WHEN 3 THEN 'lt' END AS op, p_size * CASE u WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 24.0::DOUBLE ELSE 25.4::DOUBLE END AS value,
CASE WHEN o IN (0, 1, 4) THEN 'duration_hours' WHEN o = 2 THEN 'film_thickness_um' END AS asked FROM b)
SELECT p_partkey, kind, op, value, value > 300 AS met FROM c WHERE op IS NOT NULL AND (asked IS NULL OR asked = kind)""")
def numeric_constraints(t):
    """FLT-15: what a question compares with, and whether a value of 300 fails it."""
    part = t.part.select("p_partkey", "p_size").repartition(t.spark.sparkContext.defaultParallelism)  # a small file of many rows is one task
    # the outer form, for the planner filters the other by the array's size and so works it out again
    rows = part.select("p_partkey", F.explode_outer(intent.comparisons(F.expr(_COMPARED))).alias("c")).where("c IS NOT NULL")
    met = intent.satisfies(F.array("c.value"), F.struct(F.lit("gt").alias("op"), F.lit(300.0).alias("value")))
    return rows.select("p_partkey", "c.kind", "c.op", "c.value", met.alias("met"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 24.0::DOUBLE ELSE 0 END AS hours, p_size * 25.4::DOUBLE AS film, 0::INTEGER AS lost, p_size::DOUBLE AS bare FROM part""")
def controlled_values(t):
    """FLT-16: durations beside salt spray only, thickness from fields of films only."""
    note = F.concat(F.when(F.col("p_size") % 2 == 0, "Salt_Spray test ").otherwise("water test "), "p_size", F.lit(" days"))
    mils = F.concat(F.col("p_size").cast("string"), F.lit(" mils"))
    one = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(0.0))
    return t.part.select(
        "p_partkey", one(intent.salt_durations(note)).alias("hours"), one(intent.thickness_um("sample.dry_film_thickness", mils)).alias("film"),
        F.size(intent.thickness_um("film_thickness_loss", mils)).alias("lost"), one(intent.thickness_um("dft", F.col("p_size"))).alias("bare"),
    )


def _items(t):
    null = F.lit(None).cast("string")
    status = F.when(F.col("l_partkey") % 11 == 0, "excluded").when(F.col("l_partkey") % 7 == 0, "adjacent").when(F.col("l_partkey") % 5 == 0, "related")
    return t.lineitem.select(
        (F.col("l_suppkey") % 40).alias("packet"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("s"), F.col("l_partkey") % 2).alias("source"), F.concat(F.lit("US"), F.col("l_suppkey") + 1000000, F.lit("A1")).alias("doc_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("sample"), F.col("l_linenumber"))).alias("sample_id"), F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("ctx"), F.col("l_linenumber"))).otherwise(null).alias("context_id"),
        F.concat(F.lit("O"), "l_orderkey").alias("object_id"), F.array(F.concat(F.lit("f"), F.col("l_partkey") % 20)).alias("facts_refs"), F.array(F.concat(F.lit("e"), F.col("l_partkey") % 9)).alias("evidence_refs"),
        status.alias("status"), F.when(F.col("l_partkey") % 7 == 0, F.array(F.concat(F.lit("axis"), F.col("l_partkey") % 3))).alias("unmet"),
    )


_ITEMS = """i AS (SELECT l_suppkey % 40 AS packet, l_orderkey * 100 + l_linenumber AS position, 's' || l_partkey % 2 AS source, 'US' || (l_suppkey + 1000000) || 'A1' AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'sample' || l_linenumber WHEN 1 THEN 'ctx' || l_linenumber END AS sample,
CASE l_linenumber % 3 WHEN 0 THEN 'sample_id' WHEN 1 THEN 'context_id' END AS field, 'O' || l_orderkey AS object_id, 'f' || l_partkey % 20 AS f, 'e' || l_partkey % 9 AS e, (l_partkey % 11 != 0) AND (l_partkey % 7 = 0 OR l_partkey % 5 = 0) AS near, CASE WHEN l_partkey % 7 = 0 THEN 'axis' || l_partkey % 3 END AS unmet FROM lineitem WHERE l_partkey % 11 != 0 AND l_linenumber % 3 < 2),
k AS (SELECT packet, source, doc_id, field, sample, min(position) AS first, list_sort(list(DISTINCT f)) AS fs, list_sort(list(DISTINCT e)) AS es, string_agg(DISTINCT unmet, ',' ORDER BY unmet) AS un, bool_or(near) AS near, count(DISTINCT object_id)::INTEGER AS objects FROM i GROUP BY 1, 2, 3, 4, 5),
cat AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY first, source, doc_id, field, sample) AS n FROM k)"""


@query(f"WITH {_ITEMS} SELECT packet, 'S' || n AS handle, source, doc_id, field, sample, objects, array_to_string(fs, ',') AS facts, array_to_string(es, ',') AS evidence, CASE WHEN near THEN 'adjacent' ELSE 'expanded' END AS match_scope, coalesce(un, '') AS unmet FROM cat")
def sample_catalogue(t):
    """QA-12: samples of expanded rows with handles, references and scope."""
    got = answer.sample_catalogue(_items(t))
    join = lambda c, n: F.array_join(c, ",").alias(n)
    return got.select("packet", "handle", "source", "doc_id", "field", "sample", F.size("object_ids").alias("objects"), join("facts_refs", "facts"), join("evidence_refs", "evidence"), "match_scope", join("unmet", "unmet"))


@query(f"""WITH {_ITEMS}, m AS (SELECT packet, count(*) AS n, count(*) FILTER (n > 1) > 0 AS two, max(CASE WHEN n = 1 THEN doc_id END) AS d, max(CASE WHEN n = 2 THEN doc_id END) AS d2 FROM cat GROUP BY 1)
SELECT packet, CASE packet % 8 WHEN 0 THEN 'answer_sample_identity' WHEN 1 THEN CASE WHEN two THEN 'answer_display_count' END WHEN 2 THEN 'answer_empty_claim' WHEN 3 THEN 'answer_unbound_reference' WHEN 4 THEN 'answer_missing_evidence' WHEN 5 THEN 'answer_cross_patent_claim' END AS problem FROM m""")
def answer_validation(t):
    """QA-12: the first rule that a packet's claims break. Handles count from S1, so S0 is in no catalogue, however long."""
    cat = answer.sample_catalogue(_items(t))
    case = F.col("packet") % 8
    handles = F.when(case == 1, F.array(F.lit("S1"))).when(case == 0, F.array(F.lit("S1"), F.lit("S2"), F.lit("S0"))).otherwise(F.array(F.lit("S1"), F.lit("S2")))
    asked = cat.select("packet").distinct().select("packet", F.explode(handles).alias("handle")).join(cat.select("packet", "handle", "doc_id", "facts_refs", "evidence_refs"), ["packet", "handle"], "left")
    asked = asked.where(F.col("doc_id").isNotNull() | (F.col("handle") == "S0"))
    none = F.array().cast("array<string>")
    claims = asked.select(
        "packet", "handle", F.when(case == 2, " ").when(case == 5, "as in WO2020123456A1").otherwise(F.concat(F.lit("shown in "), F.coalesce("doc_id", F.lit("")))).alias("text"),
        F.when(case == 3, F.array(F.lit("stranger"))).otherwise(F.col("facts_refs")).alias("facts_refs"), F.when(case == 4, none).otherwise(F.coalesce("evidence_refs", none)).alias("evidence_refs"),
    )
    return answer.validate_selection(cat, claims, 2)


@query("""WITH g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM g)
SELECT 1::INTEGER AS line, (SELECT count(*) FROM part) || ' parts match the filters.' AS text UNION ALL SELECT 2, 'classified: 7.' UNION ALL SELECT 3, 'Groups may overlap, so their counts do not add up.' UNION ALL SELECT 4, '| p_brand | count (parts) |' UNION ALL SELECT 5, '| --- | --- |'
UNION ALL SELECT (k + 5)::INTEGER, '| ' || p_brand || ' | ' || n || ' |' FROM r UNION ALL SELECT 1073741824, 'More groups were not returned.'""")
def aggregate_rendering(t):
    """QA-13: an aggregate's answer, line by line."""
    groups = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("count"))
    return answer.aggregate_lines(groups, ["p_brand"], "parts", t.part.count(), [("classified", 7)], has_more=True)


@query("""WITH o AS (SELECT o_custkey % 100 AS packet, o_orderkey AS position, o_orderkey FROM orders WHERE o_orderkey % 4 = 1 OR o_orderkey % 4 = 2 OR (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0)),
q AS (SELECT packet, position, 'C' || packet AS doc_id, 'O' || o_orderkey AS object_id, l_linenumber AS page, md5(CAST(l_partkey AS VARCHAR)) AS quote, row_number() OVER (PARTITION BY packet ORDER BY position, l_linenumber, md5(CAST(l_partkey AS VARCHAR))) AS number FROM o JOIN lineitem ON l_orderkey = o_orderkey)
SELECT packet, number::INTEGER AS number, doc_id, object_id, page, quote FROM q WHERE number <= 12""")
def citations(t):
    """PRJ-37: the first quotes of verified expansions, aggregate examples and field scans."""
    quotes = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("page"), F.md5(F.col("l_partkey").cast("string").cast("binary")).alias("quote")))).alias("quotes"))
    kind = F.col("o_orderkey") % 4
    packet = F.col("o_custkey") % 100
    item = F.struct(F.concat(F.lit("C"), packet).alias("doc_id"), F.concat(F.lit("O"), "o_orderkey").alias("object_id"), "quotes")
    seen = t.orders.join(quotes, "o_orderkey").select(
        packet.alias("packet"), F.col("o_orderkey").alias("position"), F.when(kind == 0, "expand").when(kind == 1, "aggregate").when(kind == 2, "field_scan").otherwise("search").alias("tool"),
        F.lit("ok").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "verified").otherwise("open").alias("gate"), F.array(item).alias("items"),
    )
    return answer.citations(seen)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def id_scan(t):
    """SRC-06: rows whose id is in a list of another table."""
    return packs.scan_by_ids(t.orders, "o_orderkey", t.lineitem.where("l_quantity > 45").select("l_orderkey")).select("o_orderkey", "o_custkey")


@query("""SELECT p_partkey, concat_ws(',', p_brand, CASE WHEN p_size % 2 = 0 AND p_type != p_brand THEN p_type END, CASE WHEN p_name NOT IN (p_brand, p_type) THEN p_name END) AS resin, CASE WHEN p_size > 25 THEN 'clay' ELSE '' END AS filler FROM part""")
def material_slots(t):
    """PRJ-02: a slot's values under all of its names."""
    raw = F.to_json(F.struct(
        F.array("p_brand").alias("resin"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("binder"), F.when(F.col("p_size") > 25, "clay").alias("fillers"),
        F.struct(F.array("p_name", "p_brand").alias("resins")).alias("formulation"),
    ))
    return t.part.select("p_partkey", F.array_join(X.material_slot(raw, "resin"), ",").alias("resin"), F.array_join(X.material_slot(raw, "filler"), ",").alias("filler"))


@query("""SELECT o_orderkey, o_custkey, 'orders' AS provenance, count(l_orderkey)::INTEGER AS facts, coalesce(sum(l_partkey), 0)::BIGINT AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def full_projection(t):
    """PRJ-04: whole rows with all their facts, read back from the JSON."""
    got = X.full_projection(t.orders, "o_orderkey", {"facts": t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")}, F.lit("orders"))
    parts = F.aggregate("facts", F.lit(0).cast("long"), lambda s, f: s + F.get_json_object(f, "$.l_partkey").cast("long"))
    return got.select("o_orderkey", F.get_json_object("raw", "$.o_custkey").cast("long").alias("o_custkey"), "provenance", F.size("facts").alias("facts"), parts.alias("parts"))


@query("""SELECT p_partkey, p_type AS resin_system, p_name || ',' || p_brand AS additives, CASE WHEN p_size % 3 > 0 THEN p_name END AS tested_substrate, CASE WHEN p_size % 4 = 0 THEN 'kept' WHEN p_size % 4 = 1 THEN 'ISO ' || p_size WHEN p_size % 4 = 2 THEN 'ASTM B' || p_size END AS standard_id,
CASE WHEN p_size % 4 = 2 THEN 'salt_ASTM_B' || p_size WHEN p_size % 4 = 3 THEN 'rub' END AS test_method, CASE WHEN p_size % 3 > 0 THEN 2 ELSE 1 END::INTEGER AS changes FROM part""")
def fact_coercion(t):
    """PRJ-19: raw facts brought to the schema, with what was changed."""
    size = F.col("p_size")
    sub = F.when(size % 3 == 0, "unknown").otherwise(F.col("p_name"))
    method = F.when(size % 4 <= 1, F.concat(F.lit("ISO_"), size)).when(size % 4 == 2, F.concat(F.lit("salt_ASTM_B"), size)).otherwise("rub")
    got = X.coerce_fact(F.array(F.lit(" "), "p_type", F.col("p_brand")), F.array("p_name", F.lit("")), sub, method, F.when(size % 4 == 0, "kept"))
    out = {k: v for k, v in got.items() if k != "schema_coercions"}
    return t.part.select("p_partkey", *((F.array_join(v, ",") if k == "additives" else v).alias(k) for k, v in out.items()), F.size(got["schema_coercions"]).alias("changes"))


@query("""SELECT doc_id AS unit_id, doc_id % 10 AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'register_layer1' ELSE 'extract_facts' END AS route, CASE WHEN doc_id % 3 = 0 THEN 'figure_chart' ELSE 'no_description' END AS reason, CASE WHEN doc_id % 3 = 0 THEN '0.85' ELSE '0.35' END AS route_confidence, 'chart' AS normalized_subject,
sha256(translate(substr(coalesce(text, ''), 1, 200), chr(10) || chr(13), '  ')) AS description_excerpt FROM documents WHERE length(text) >= 30""")
def route_audit(t):
    """QA-04: the audit log of routes."""
    kind = F.col("doc_id") % 3
    route = X.unit_route(kind == 0, F.col("text"), F.lit(1), F.when(kind == 0, "figure").otherwise("table"), F.lit("chart"), figures=["chart"], extract=[], register=[], drop=[])
    rows = t.documents.where(F.length("text") >= 30).withColumn("unit", F.col("doc_id")).withColumn("doc", F.col("doc_id") % 10)
    return X.route_log(rows, "unit", "doc", route, F.lit("chart"), F.col("text")).withColumn("description_excerpt", F.sha2("description_excerpt", 256))


@query("""WITH s AS (SELECT p_partkey AS node, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '\\w{2,}')), ['which', 'red', 'ring', 'or', 'blue', 'bolt', 'is', 'promo'])) + CASE WHEN contains('which red ring or blue bolt is promo', lower(p_name)) THEN 2 ELSE 0 END AS score FROM part)
SELECT node, score::INTEGER AS score FROM s WHERE score > 0 ORDER BY score DESC, node LIMIT 25""")
def token_recall(t):
    """GRF-05: nodes that share words with a question."""
    return resolve.token_recall(t.part, "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"), "Which red ring or blue bolt is PROMO", 25)


_BM25 = " + ".join(f"ln(1 + (n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))" for i in range(3))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS size, {', '.join(f"len(list_filter(w, lambda x: x = '{x}')) AS f{i}" for i, x in enumerate(("the", "ring", "que")))} FROM w),
s AS (SELECT count(*) AS n, avg(size) AS mean, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in range(3))} FROM c) SELECT doc_id, round({_BM25}, 6)::DOUBLE AS score FROM c, s ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(t):
    """TOP-18: chunks by BM25."""
    return R.bm25(t.documents, "doc_id", F.col("text"), ["the", "ring", "que"]).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query("""SELECT o_orderkey, o_orderkey % 2 = 1 AS missing_application, o_orderkey % 3 != 0 AS missing_resin_system, o_orderkey % 5 = 0 AS mixed_polarity, o_orderkey % 4 > 1 AS multi_table_context, o_orderkey % 7 = 0 AS unresolved_comparison,
o_orderkey % 4 > 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 10 = 0) AS ocr_or_html_missing, o_orderkey % 9 = 1 AS coverage_below_threshold, (o_orderkey % 3)::INTEGER AS low_confidence_fact_count FROM orders""")
def example_flags(t):
    """QA-02: the flags of an example's context."""
    k = F.col("o_orderkey")
    listed = lambda c: F.when(c, F.array(F.lit("x")))
    unit = F.struct(F.lit("table").alias("evidence_type"), (k % 6 != 0).alias("has_html"), F.when(k % 10 != 0, True).alias("has_image"))
    rows = t.orders.select(
        "o_orderkey", listed(k % 2 == 0).alias("applications"), F.when(k % 3 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("resin_systems"), *(listed(F.lit(True)).alias(c) for c in ("substrates", "test_methods", "test_standards")),
        (k % 5 == 0).alias("polarity_conflict"), F.slice(F.array(unit, unit, unit), 1, (k % 4).cast("int")).alias("table_units"), F.lit(False).alias("example_kind_conflict"), F.when(k % 7 == 0, "unresolved_baseline").alias("comparison_status"),
        F.when(k % 3 > 0, (k % 3).cast("int")).alias("low_confidence_facts"), F.lit(None).cast("boolean").alias("coverage_unknown"), F.array(F.lit(0.9), F.when(k % 9 == 1, 0.5)).alias("coverage_values"),
    )
    return X.example_flags(rows).select("o_orderkey", "missing_application", "missing_resin_system", "mixed_polarity", "multi_table_context", "unresolved_comparison", "ocr_or_html_missing", "coverage_below_threshold", "low_confidence_fact_count")


@query("""WITH s(source_id, position, namespace, collection_id, company) AS (VALUES ('a', 2, 'n1', 'BUILDING', 'x'), ('b', 1, 'n1', 'MACHINERY', 'x'), ('c', 3, 'n2', 'BUILDING', 'y')),
r AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'n1' END AS n, c_mktsegment AS c FROM customer), m AS (SELECT c_custkey, source_id, position FROM r LEFT JOIN s ON (n IS NULL OR n = namespace) AND c = collection_id)
SELECT c_custkey AS request_id, arg_min(source_id, position) AS source_id, count(source_id)::BIGINT AS candidates, CASE count(source_id) WHEN 0 THEN 'none' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS state FROM m GROUP BY 1""")
def source_selection(t):
    """JOIN-08: the source a request means."""
    sources = t.spark.createDataFrame([("a", 2, "n1", "BUILDING", "x"), ("b", 1, "n1", "MACHINERY", "x"), ("c", 3, "n2", "BUILDING", "y")], "source_id string, position int, namespace string, collection_id string, company string")
    asked = t.customer.select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 2 == 0, "n1").otherwise(" ").alias("namespace"), F.col("c_mktsegment").alias("collection_id"), F.lit(None).cast("string").alias("company"))
    return X.select_source(asked, sources)


@query("""WITH u AS (SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, CASE WHEN p_size > 40 THEN 'other' ELSE p_brand END FROM part WHERE p_size > 20), g AS (SELECT p_partkey, min(p_brand) AS lo, max(p_brand) AS hi, count(*)::BIGINT AS copies FROM u GROUP BY 1)
SELECT p_partkey, CASE WHEN lo = hi THEN lo END AS p_brand, copies, lo != hi AS conflict FROM g""")
def pack_union(t):
    """SET-07: packs may repeat a node, but not describe it differently."""
    again = t.part.where("p_size > 20").select("p_partkey", F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")).alias("p_brand"))
    nodes, odd = S.union_packs([t.part.select("p_partkey", "p_brand"), again], "p_partkey", ["p_brand"])
    return nodes.withColumn("conflict", F.lit(False)).unionByName(odd.withColumn("p_brand", F.lit(None).cast("string")).withColumn("conflict", F.lit(True)))


@query("""SELECT 'dangling' AS section, 'HAS_PART' AS name, count(*) FILTER (p_partkey IS NULL)::DOUBLE AS value FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey AND p_size < 40
UNION ALL SELECT 'validation', coalesce(CASE WHEN l_returnflag != 'N' THEN l_returnflag END, '(none)'), count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'proposed', 'rate', round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 4) FROM lineitem
UNION ALL SELECT 'conflicts', 'all', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1) UNION ALL SELECT 'missing_refs', 'all', count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000))""")
def kg_summary(t):
    """AGG-17: dangling edges, histogram, proposed rate, conflicts, missing references."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.lit("HAS_PART").alias("edge_type"), F.col("l_partkey").alias("dst")).distinct()
    facts = t.lineitem.withColumn("state", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    odd = S.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_partkey"))
    lost = resolve.unresolved(t.lineitem.select("l_suppkey").distinct(), t.supplier.where("s_acctbal > 1000").select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"])
    return audit.kg_summary(facts, edges, t.part.where("p_size < 40").select(F.col("p_partkey").alias("node")), odd, "state", F.col("l_discount") > 0.05, lost)


@query("""SELECT count(DISTINCT l_partkey)::BIGINT AS n, count(*)::BIGINT AS rows_read, 'complete' AS state FROM lineitem""")
def exact_distinct(t):
    """AGG-25: an exact distinct count that says whether it is complete."""
    return audit.budgeted_distinct(t.lineitem, "l_partkey")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)license') AND turn >= 1 THEN 'legal' WHEN regexp_matches(text, '(?i)abstract') THEN 'abstract' WHEN turn < 0.15 * greatest(last, 1) THEN 'abstract' WHEN turn > 0.85 * greatest(last, 1) THEN 'claims' ELSE 'description' END AS section FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)""")
def section_types(t):
    """PRJ-17: hints with windows of pages, else the relative position."""
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = t.conversations.join(last, "conv_id")
    kind = documents.section_type(F.col("turn"), F.col("last"), F.col("text"), [("legal", "(?i)license", 1, None), ("abstract", "(?i)abstract", None, None)])
    return rows.select("conv_id", "turn", kind.alias("section"))


_LIVE = "CASE lang WHEN 'en' THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 'de' THEN text || ' ' ELSE text END"


@query(f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS b FROM documents), l AS (SELECT doc_id, coalesce({_LIVE}, '') AS b FROM documents WHERE n_chars >= 100),
j AS (SELECT doc_id, c.b AS a, l.b AS b FROM c FULL JOIN l USING (doc_id))
SELECT doc_id, sha256(a) AS candidate_sha256, sha256(b) AS live_sha256, coalesce(replace(a, chr(13) || chr(10), chr(10)) = replace(b, chr(13) || chr(10), chr(10)), false) AS newlines_only FROM j WHERE a IS DISTINCT FROM b""")
def release_parity(t):
    """QA-11: the texts of a candidate against those of a live copy whose line ends, texts or rows differ."""
    live = t.documents.where("n_chars >= 100").select("doc_id", F.expr(_LIVE).alias("text"))
    return audit.inventory_differences(t.documents, live, "doc_id", "text")
