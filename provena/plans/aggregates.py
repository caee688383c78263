"""Filters and aggregates on the fixture: an order is a document, a line item a fact, a part its material."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import aggregate as A
from provena.operators import audit, filters, project
from provena.plans.registry import query

MATERIALS = "SELECT l_orderkey, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"


def facts(t):
    """Line items with their order's attributes."""
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("SELECT count(DISTINCT l_orderkey)::BIGINT AS documents, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS formulations, count(DISTINCT (lower(l_returnflag), lower(l_linestatus)))::BIGINT AS categories FROM lineitem")
def distinct_count_doc(t):
    """AGG-01."""
    return A.identity_counts(t.lineitem, documents=["l_orderkey"], formulations=["l_orderkey", "l_linenumber"], categories=[F.lower("l_returnflag"), F.lower("l_linestatus")])


_LIST = """WITH b AS (SELECT lower(p_brand) AS value, count(DISTINCT l_orderkey)::BIGINT AS doc_count, min(p_brand) AS label FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT value, doc_count, label, (SELECT count(*) FROM b)::BIGINT AS group_count FROM b ORDER BY doc_count DESC, value LIMIT {n}"""


def _brands(t):
    return t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


@query(_LIST.format(n=20))
def list_distinct_value(t):
    """AGG-02: the 20 values with most documents."""
    return A.distinct_values(_brands(t), F.col("p_brand"), F.col("l_orderkey"), 20)


@query(_LIST.replace(" ORDER BY doc_count DESC, value LIMIT {n}", ""))
def group_count_value(t):
    """AGG-03: all values and how many there are."""
    return A.distinct_values(_brands(t), F.col("p_brand"), F.col("l_orderkey"))


@query("""SELECT 'documents' AS unit, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'formulations', count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'natural_keys', count(DISTINCT (l_orderkey, l_partkey, l_suppkey)) FROM lineitem WHERE l_returnflag = 'R'""")
def count_unit_switch(t):
    """AGG-06: the unit decides what is counted."""
    got = A.identity_counts(t.lineitem.where("l_returnflag = 'R'"), documents=["l_orderkey"], formulations=["l_orderkey", "l_linenumber"], natural_keys=["l_orderkey", "l_partkey", "l_suppkey"])
    return got.selectExpr("stack(3, 'documents', documents, 'formulations', formulations, 'natural_keys', natural_keys) AS (unit, n)")


@query("""WITH f AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderpriority AS priority, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'),
b AS (SELECT year, priority, nation, count(DISTINCT o_orderkey)::BIGINT AS doc_count FROM f GROUP BY ALL)
SELECT *, (SELECT sum(doc_count) FROM b)::BIGINT AS membership, (SELECT count(*) FROM b)::BIGINT AS group_count FROM b""")
def composite_group_count(t):
    """AGG-04 within a customer segment (FLT-14)."""
    docs = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.composite_counts(docs.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation")), "o_orderkey", ["year", "priority", "nation"])


@query("""WITH f AS (SELECT o_orderkey, list(DISTINCT p_brand) AS brands, any_value(o_orderstatus) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
b AS (SELECT brand, status, count(DISTINCT o_orderkey)::BIGINT AS doc_count FROM (SELECT o_orderkey, status, unnest(brands) AS brand FROM f) GROUP BY ALL)
SELECT *, (SELECT sum(doc_count) FROM b)::BIGINT AS membership, (SELECT count(*) FROM b)::BIGINT AS group_count FROM b""")
def composite_multi_valued(t):
    """AGG-04 with a dimension of several values a document."""
    docs = _brands(t).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("brand"))
    docs = docs.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status")), "l_orderkey")
    return A.composite_counts(docs, "l_orderkey", ["brand", "status"])


@query("""SELECT coalesce(nullif(l_returnflag, 'N'), 'unspecified') AS unit, count(l_quantity)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS doc_count, count(DISTINCT o_custkey)::BIGINT AS owner_count,
min(l_quantity) AS least, max(l_quantity) AS greatest, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def numeric_distribution(t):
    """AGG-05: quantities by unit, a missing unit named."""
    return A.numeric_distribution(facts(t), F.nullif(F.col("l_returnflag"), F.lit("N")), F.col("l_quantity"), F.col("l_orderkey"), F.col("o_custkey"))


_VOTE = """v AS (SELECT l_orderkey, p_type AS category, sum(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END)::BIGINT AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
w AS (SELECT l_orderkey, category, score FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, category) = 1)"""


def _votes(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return A.vote(rows, "l_orderkey", F.col("p_type"), F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1))


@query(f"WITH {_VOTE} SELECT * FROM w")
def resin_vote(t):
    """AGG-07: category of a document by weighted vote."""
    return _votes(t)


@query(f"""WITH {_VOTE}, x AS (SELECT l_orderkey, CASE WHEN category LIKE '%TIN' THEN 'unknown' ELSE category END AS category FROM w),
c AS (SELECT category, count(DISTINCT l_orderkey)::BIGINT AS doc_count FROM x GROUP BY 1)
SELECT category, doc_count, round(doc_count * 100.0 / (SELECT sum(doc_count) FROM c), 2) AS pct_all, CASE WHEN category != 'unknown' THEN round(doc_count * 100.0 / (SELECT sum(doc_count) FROM c WHERE category != 'unknown'), 2) END AS pct_classified FROM c""")
def resin_distribution(t):
    """AGG-08: shares of all and of the classified."""
    return A.share_of(_votes(t).withColumn("category", F.when(F.col("category").endswith("TIN"), "unknown").otherwise(F.col("category"))), "l_orderkey")


@query("""WITH first AS (SELECT o_orderpriority AS bucket, o_custkey, min((o_orderkey, o_totalprice)) AS f FROM orders GROUP BY 1, 2)
SELECT bucket, o_custkey, f[1]::BIGINT AS o_orderkey, f[2]::DOUBLE AS o_totalprice, row_number() OVER (PARTITION BY bucket ORDER BY f, o_custkey)::INTEGER AS rank FROM first QUALIFY rank <= 8""")
def bounded_examples(t):
    """AGG-09: at most eight examples a bucket, one a document."""
    rows = t.orders.withColumn("bucket", F.col("o_orderpriority"))
    return A.bounded_examples(rows, "bucket", "o_custkey", ["o_orderkey", "o_totalprice"])


@query("""WITH s AS (SELECT CASE WHEN l_discount > 0.09 THEN 'ambiguous' WHEN o_orderkey IS NULL THEN 'missing_profile' WHEN l_tax = 0 THEN 'missing_source' WHEN o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%URGENT%' THEN 'mapped' ELSE 'unclassified' END AS state
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) FILTER (state = 'mapped')::BIGINT AS mapped, count(*) FILTER (state = 'missing_profile')::BIGINT AS missing_profile, count(*) FILTER (state = 'missing_source')::BIGINT AS missing_source, count(*) FILTER (state = 'ambiguous')::BIGINT AS ambiguous, count(*) FILTER (state = 'unclassified')::BIGINT AS unclassified, count(*)::BIGINT AS total, count(*) FILTER (state = 'mapped') = count(*) AS complete FROM s""")
def coverage_accounting(t):
    """AGG-10."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return A.coverage(rows, F.coalesce(F.col("o_orderpriority").contains("HIGH") | F.col("o_orderpriority").contains("URGENT"), F.lit(False)), F.col("l_tax") != 0, F.col("o_orderkey").isNotNull(), F.col("l_discount") > 0.09)


@query("SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') GROUP BY 1")
def cohort_semi(t):
    """FLT-13: rows of the cohort only."""
    members = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.cohort(t.lineitem, members, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') LIKE '%customer 00000000%' OR regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') LIKE '%customer00000000%') GROUP BY 1""")
def scope_resolution(t):
    """FLT-14: owner text to documents, then rows in scope."""
    scope = filters.resolve_scope(t.customer, "c_custkey", F.col("c_name"), ["Customer#00000000"])
    return filters.cohort(t.orders, scope.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (lower(p_name) LIKE '%widget%')::BIGINT AS long_needle, count(*) FILTER (regexp_matches(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '(^|[^a-z0-9])red($|[^a-z0-9])'))::BIGINT AS short_needle, count(*) FILTER (lower(p_brand) LIKE '%brand#1%')::BIGINT AS spaced FROM part")
def text_match(t):
    """FLT-03: long needles as substrings, short ones within boundaries, with and without spaces."""
    n = lambda c, *w: F.count(F.when(T.needle_in(F.col(c), w), 1))
    return t.part.agg(n("p_name", "Widget").alias("long_needle"), n("p_name", "RED").alias("short_needle"), n("p_brand", "brand_1").alias("spaced"))


@query(f"""WITH m AS ({MATERIALS}), d AS (SELECT l_orderkey, bool_or(p_brand IN ('Brand#1', 'Brand#2') AND p_name LIKE '%ring%') AS a, bool_or(regexp_matches(p_name, '(^|[^a-z0-9])red($|[^a-z0-9])')) AS b, bool_or(p_name LIKE '%blue%') AS c FROM m GROUP BY 1)
SELECT l_orderkey FROM d WHERE (b AND c) AND a""")
def material_groups(t):
    """FLT-07: all within one group, any among the rows of some roles in another."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("p_brand").alias("role"), F.col("p_name").alias("name"))).alias("m"))
    groups = [{"values": ["red", "blue"], "match": "all"}, {"values": ["ring"], "roles": ["brand#1", "Brand#2"]}]
    return rows.where(filters.material_groups(F.col("m"), groups)).select("l_orderkey")


@query("SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'O' GROUP BY 1 HAVING bool_or(lower(p_brand) IN ('brand#2', 'brand#3'))")
def role_presence(t):
    """FLT-05: at least one material row of a role."""
    rows = _brands(t).groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("p_brand").alias("role"), F.lit("").alias("name"))).alias("m"))
    rows = rows.where(filters.material_group(F.col("m"), roles=["Brand#2", "brand#3"]))
    return t.orders.where("o_orderstatus = 'O'").join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE lower(c_mktsegment) IN ('machinery') OR lower(c_mktsegment) IN ('household', 'building') OR lower(c_mktsegment) LIKE '%auto%' GROUP BY 1")
def family_widening(t):
    """FLT-08: a wanted family also matches its aliases and what contains it."""
    ok = filters.family_matches(F.array("c_mktsegment"), ["machinery", "auto"], {"auto": ["household", "building"]})
    return t.customer.where(ok).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 3, 5) AND event_type = 'click' GROUP BY 1""")
def json_path_filter(t):
    """FLT-01, FLT-22: exact filters on a path of open metadata."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(k.isin(1, 3, 5) & (F.col("event_type") == "click")).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 24.0 ELSE 168.0 END * (event_id % 50) AS hours FROM events)
SELECT count(*) FILTER (hours >= 240)::BIGINT AS at_least, count(*) FILTER (hours < 24)::BIGINT AS below, max(hours)::DOUBLE AS most FROM e""")
def numeric_parse(t):
    """FLT-15, FLT-16: durations in text, brought to hours and compared."""
    unit = F.when(F.col("event_id") % 3 == 0, "h").when(F.col("event_id") % 3 == 1, "days").otherwise("Weeks")
    note = F.concat(F.lit("salt spray for "), (F.col("event_id") % 50).cast("string"), F.lit(" "), unit, F.lit(", then 5x"))
    hours = t.events.select(F.explode(T.durations_hours(note)).alias("hours"))
    return hours.agg(F.count(F.when(T.compare(F.col("hours"), "ge", 240), 1)).alias("at_least"), F.count(F.when(T.compare(F.col("hours"), "lt", 24), 1)).alias("below"), F.max("hours").alias("most"))


@query("""SELECT CASE WHEN p_name LIKE '%bolt%' THEN 'reject' WHEN p_brand LIKE 'Brand#1%' THEN 'accept' WHEN regexp_matches(p_name, 'widget|econ') THEN 'accept' WHEN p_name LIKE 'small%' AND p_type LIKE 'ECON%' THEN 'accept' WHEN p_type LIKE 'ECON%' THEN 'uncertain' ELSE 'reject' END AS verdict, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def domain_gate(t):
    """FLT-19: the first rule that holds decides."""
    gate = filters.domain_gate(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_name"), against="bolt", words="widget|econ", codes=["Brand#1", "small"])
    return t.part.groupBy(gate.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'direct' WHEN l_returnflag = 'R' OR l_shipdate < TIMESTAMP '1996-01-01' THEN 'related' ELSE 'excluded' END AS state, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 100, 101) GROUP BY 1""")
def facet_guard(t):
    """FLT-20, FLT-21: candidates within scope by how well they meet hard facets."""
    rows = filters.in_scope(t.lineitem, "l_orderkey", [1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 100, 101])
    state = filters.facet_state([F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"], [F.col("l_returnflag") == "R", F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")])
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT *, 1 - (l_linenumber % 8) / 16.0::DOUBLE AS c FROM lineitem)
SELECT l_orderkey, count(*)::BIGINT AS n_facts, count(*) FILTER (l_returnflag = 'A')::BIGINT AS n_positive, count(*) FILTER (l_returnflag = 'R')::BIGINT AS n_negative, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n_unknown,
round(avg(c), 3) AS confidence_mean, min(c) AS confidence_min, count(*) FILTER (c < 0.85)::BIGINT AS n_low, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM f GROUP BY 1""")
def context_rollup(t):
    """AGG-12."""
    state = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("unknown")
    return project.context_rollup(t.lineitem, "l_orderkey", state, 1 - (F.col("l_linenumber") % 8) / 16.0, {"statuses": F.col("l_linestatus")})


#: A supplier is a context; its fields, the source of each fact and the records of values.
_RECORDS = """f AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS fact, l_orderkey AS evidence, l_returnflag, l_linestatus, l_linenumber, 1 - (l_linenumber % 8) / 16 AS c,
  CASE l_returnflag WHEN 'A' THEN 'fact_explicit' WHEN 'R' THEN 'doc_profile:terms' ELSE 'paragraph' END AS source FROM lineitem),
v AS (SELECT *, 'flag' AS field, nullif(l_returnflag, 'N') AS value FROM f UNION ALL SELECT *, 'line', CASE WHEN l_linenumber < 7 THEN l_linenumber::VARCHAR ELSE 'unknown' END FROM f UNION ALL SELECT *, 'status', l_linestatus FROM f),
g AS (SELECT l_suppkey, field, value, count(DISTINCT fact)::BIGINT AS fact_count, count(DISTINCT evidence)::BIGINT AS evidence_count, bool_or(source = 'fact_explicit') AS explicit, bool_or(source LIKE 'doc_profile%') AS profile
  FROM v WHERE value IS NOT NULL AND value NOT IN ('', 'unknown') GROUP BY 1, 2, 3),
w AS (SELECT *, 0.55 + least(0.25, 0.05 * fact_count) + least(0.15, 0.05 * evidence_count) + CASE WHEN explicit THEN 0.05 ELSE 0 END AS raw FROM g),
r AS (SELECT l_suppkey, field, value, fact_count, evidence_count, explicit, profile, CAST(round(greatest(0.0, least(0.95, CASE WHEN profile THEN least(raw, 0.8) ELSE raw END)), 3) AS DOUBLE) AS confidence,
  row_number() OVER (PARTITION BY l_suppkey, field ORDER BY fact_count DESC, value)::INTEGER AS place FROM w)"""


def _supplier_facts(t):
    source = F.when(F.col("l_returnflag") == "A", "fact_explicit").when(F.col("l_returnflag") == "R", "doc_profile:terms").otherwise("paragraph")
    rows = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact"), F.col("l_orderkey").alias("evidence"), "l_returnflag", "l_linestatus", "l_linenumber", source.alias("source"))
    fields = {
        "flag": F.array(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))), "status": F.array("l_linestatus"),
        "line": F.array(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string")).otherwise("unknown")),
    }
    return rows, project.field_records(rows, "l_suppkey", "fact", "evidence", fields, F.col("source"))


@query(f"WITH {_RECORDS} SELECT * FROM r")
def field_records(t):
    """AGG-12: the values of each field."""
    return _supplier_facts(t)[1]


@query(f"""WITH {_RECORDS},
q AS (SELECT l_suppkey, count(DISTINCT fact)::BIGINT AS fact_count, count(DISTINCT evidence)::BIGINT AS evidence_count, round(avg(c), 3) AS mean_confidence, round(min(c), 3) AS min_confidence, count(*) FILTER (c < 0.85)::BIGINT AS n_low,
  round(avg(c) FILTER (l_returnflag <> 'N'), 3) AS mean_binding, round(min(c) FILTER (l_returnflag <> 'N'), 3) AS min_binding, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) WHEN min(l_linestatus) IS NOT NULL THEN 'mixed' END AS resolution_status FROM f GROUP BY 1),
n AS (SELECT l_suppkey, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (place = 2), '') AS conflicts, count(DISTINCT field) FILTER (place = 2)::INTEGER AS conflict_count,
  max(value) FILTER (field = 'flag' AND place = 1) AS top, max(fact_count) FILTER (field = 'flag' AND place = 1) AS a, max(fact_count) FILTER (field = 'flag' AND place = 2) AS b FROM r GROUP BY 1)
SELECT q.*, coalesce(conflicts, '') AS conflicts, coalesce(conflict_count, 0) AS conflict_count, CASE WHEN b IS NULL OR a >= greatest(2, b * 2) THEN top END AS primary_flag FROM q LEFT JOIN n USING (l_suppkey)""")
def context_quality(t):
    """AGG-12: counts, confidences, conflicts and primary values."""
    rows, records = _supplier_facts(t)
    sure = 1 - (F.col("l_linenumber") % 8) / 16.0
    return project.context_quality(rows, "l_suppkey", "fact", "evidence", sure, F.when(F.col("l_returnflag") != "N", sure), F.col("l_linestatus"), records, ["flag"])


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS value, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY n DESC, value))
SELECT l_orderkey, CASE WHEN second IS NULL OR n >= greatest(2, second * 2) THEN value END AS primary_value, value AS top_value, n AS top_count, second FROM r WHERE place = 1""")
def primary_values(t):
    """AGG-13."""
    values = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return project.primary_values(values, "l_orderkey", "value", "n")


@query("""WITH c AS (SELECT o_custkey, count(*)::BIGINT AS f, count(DISTINCT o_orderpriority)::BIGINT AS e, bool_or(o_orderstatus = 'F') AS x, min(o_totalprice) < 1000 AS p FROM orders GROUP BY 1),
s AS (SELECT *, 0.55 + least(0.25, 0.05 * f) + least(0.15, 0.05 * e) + CASE WHEN x THEN 0.05 ELSE 0 END AS raw FROM c)
SELECT o_custkey, f AS facts, CAST(round(greatest(0.0, least(0.95, CASE WHEN p THEN least(raw, 0.8) ELSE raw END)), 3) AS DOUBLE) AS confidence FROM s""")
def field_confidence(t):
    """AGG-14."""
    c = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("o_orderpriority").alias("e"), F.max(F.col("o_orderstatus") == "F").alias("x"), (F.min("o_totalprice") < 1000).alias("p"))
    return c.select("o_custkey", "facts", project.field_confidence(F.col("facts"), F.col("e"), F.col("x"), F.col("p")).alias("confidence"))


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT nullif(l_returnflag, 'N')) AS kinds, min(nullif(l_returnflag, 'N')) AS one FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN kinds = 1 THEN one WHEN kinds > 1 THEN 'ambiguous' ELSE 'unknown' END AS example_kind, kinds > 1 AS conflict FROM g""")
def kind_consensus(t):
    """AGG-15."""
    return project.kind_consensus(t.lineitem, "l_orderkey", F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag")))


@query("""SELECT l_orderkey, round(min(CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN l_quantity / 100.0 * 100.0 ELSE l_quantity END), 3) AS min_coverage, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n_missing, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS bases FROM lineitem WHERE l_quantity > 1 GROUP BY 1""")
def coverage_summary(t):
    """AGG-16: shares and percents brought together."""
    pct = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 100.0).when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    return project.coverage_summary(t.lineitem.where("l_quantity > 1"), "l_orderkey", pct, F.col("l_linestatus"))


@query("""WITH n AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'positive' ELSE 'negative' END AS p, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2), b AS (SELECT l_orderkey, arg_min(p, (-n, p)) AS dominant, count(*) > 1 AS conflict FROM n GROUP BY 1)
SELECT l_orderkey, coalesce(dominant, 'unknown') AS dominant, coalesce(conflict, false) AS conflict FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN b USING (l_orderkey)""")
def dominant_polarity(t):
    """AGG-29."""
    return project.dominant_polarity(t.lineitem, "l_orderkey", F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("unknown"))


@query("""SELECT l_orderkey, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '; ' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'A'), '') AS m_a, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '; ' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'N'), '') AS m_n, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '; ' ORDER BY CAST(l_partkey AS VARCHAR)) FILTER (l_returnflag = 'R'), '') AS m_r FROM lineitem GROUP BY 1""")
def wide_pivot(t):
    """AGG-28: a column a bucket of distinct cells."""
    return project.wide(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"], F.col("l_partkey").cast("string"), "m_")


@query("""SELECT l_suppkey AS proposed, count(*)::BIGINT AS occurrences, max((l_discount, l_linenumber))[2]::INTEGER AS best_unit, list_aggregate(list_sort(list(DISTINCT l_linenumber))[1:3], 'string_agg', ',') AS units FROM lineitem GROUP BY 1""")
def merge_queue(t):
    """AGG-23."""
    return project.merge_queue(t.lineitem.withColumnRenamed("l_suppkey", "proposed"), "proposed", "l_linenumber", "l_discount", 3)


@query("""SELECT * FROM (SELECT 'o_orderstatus' AS column_name, count(*) FILTER (trim(o_orderstatus) != '')::BIGINT AS filled, count(*)::BIGINT AS total FROM orders UNION ALL SELECT 'o_orderpriority', count(*) FILTER (trim(o_orderpriority) != ''), count(*) FROM orders UNION ALL SELECT 'o_orderdate', count(o_orderdate), count(*) FROM orders)""")
def fill_profile(t):
    """AGG-19."""
    return audit.fill_profile(t.orders, ["o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("""WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)) SELECT count(*)::BIGINT AS facts, count(b.l_orderkey)::BIGINT AS broken, round((count(*) - count(b.l_orderkey)) / count(*), 4) AS rate FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN b USING (l_orderkey)""")
def trace_rate(t):
    """AGG-18: facts all of whose references exist."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("refs"))
    return audit.trace_rate(rows, "l_orderkey", "refs", t.part.where("p_size <= 45"), "p_partkey")


@query("""WITH g AS (SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(text, 'https?://') THEN 'link' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'number' WHEN regexp_matches(text, '[!?]') THEN 'mark' ELSE 'other' END AS category, count(*)::BIGINT AS n FROM documents GROUP BY 1) SELECT category, n, round(n * 100.0 / (SELECT sum(n) FROM g), 2) AS pct FROM g""")
def null_categorise(t):
    """AGG-27."""
    return audit.categorise(t.documents, F.col("text"), [("link", "https?://"), ("number", "[0-9]{4,}"), ("mark", "[!?]")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_quantity > 49 THEN 'large' END, CASE WHEN l_tax > 0.07 THEN 'tax' END) AS issues, CASE WHEN l_quantity > 49 THEN 'error' WHEN l_discount = 0 OR l_tax > 0.07 THEN 'warning' ELSE 'ok' END AS status FROM lineitem""")
def validation_gate(t):
    """QA-01, FLT-18."""
    got = audit.gate(t.lineitem, {"no_discount": F.col("l_discount") == 0, "large": F.col("l_quantity") > 49, "tax": F.col("l_tax") > 0.07}, ["large"])
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "issues", "status")


@query("SELECT role, count(*)::BIGINT AS n_input, count(*) FILTER (length(text) > 200)::BIGINT AS n_verified, count(DISTINCT conv_id) FILTER (length(text) > 200)::BIGINT AS n_samples FROM conversations GROUP BY 1")
def receipt_stats(t):
    """AGG-30, QA-06."""
    return audit.receipt(t.conversations, "role", F.length("text") > 200, F.col("conv_id"))


@query("SELECT url, count(DISTINCT md5(text))::BIGINT AS contents, count(*)::BIGINT AS n FROM (SELECT regexp_extract(url, '://([^/]+)/', 1) AS url, html AS text FROM pages) GROUP BY 1 HAVING count(DISTINCT md5(text)) > 1")
def reference_conflicts(t):
    """QA-08: one reference with several contents."""
    rows = t.pages.select(F.regexp_extract("url", "://([^/]+)/", 1).alias("url"), "html")
    return audit.reference_conflicts(rows, "url", F.col("html"))


@query("SELECT family, family_raw, count(*)::BIGINT AS n FROM (SELECT c_mktsegment AS family_raw, CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' WHEN 'MACHINERY' THEN 'INDUSTRY' ELSE c_mktsegment END AS family FROM customer) GROUP BY ALL")
def family_remap(t):
    """QA-09: remapping twice is remapping once."""
    names = {"BUILDING": "CONSTRUCTION", "MACHINERY": "INDUSTRY"}
    rows = t.customer.withColumnRenamed("c_mktsegment", "family")
    return audit.remap(audit.remap(rows, "family", names), "family", names).groupBy("family", "family_raw").agg(F.count(F.lit(1)).alias("n"))
