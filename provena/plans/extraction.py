"""Labels, routes and records on the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import extract as X
from provena.operators import resolve
from provena.plans.registry import query

_LABELS = ["Examples 1 to 3", "Comparative Example 2", "Ex1/2", "CE 4", "I7", "c 5", "Beispiel 6", "Comparative", "control"]
_IDS = ["E1-3", "C2", "E1/2", "C4", "I7", "C5", "E6", "C1", None]


def _pick(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_IDS) if v) + " END AS example_id FROM lineitem")
def example_ids(t):
    """PRJ-14."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.example_id(_pick("l_partkey", _LABELS)).alias("example_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'E3' WHEN o_custkey % 2 = 0 THEN 'C2' ELSE 'E' || (o_orderkey % 4) END AS example_id, CASE WHEN o_orderkey % 5 = 0 THEN 'explicit' WHEN o_custkey % 2 = 0 THEN 'caption' ELSE 'column_digit' END AS source FROM orders""")
def example_chain(t):
    """PRJ-15: explicit, then caption, then a bare number."""
    explicit = F.when(F.col("o_orderkey") % 5 == 0, "Example 3")
    caption = F.when(F.col("o_custkey") % 2 == 0, "Table 1: Comp. Ex. 2")
    value, source = X.example_chain([("explicit", explicit), ("caption", caption), ("column", (F.col("o_orderkey") % 4).cast("string"))])
    return t.orders.select("o_orderkey", value.alias("example_id"), source.alias("source"))


@query("""WITH u AS (SELECT p_partkey, p_partkey % 7 > 0 AS described, p_name AS description, p_size % 3 AS entities, CASE WHEN p_partkey % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, lower(p_type) AS subject FROM part)
SELECT p_partkey, CASE WHEN NOT described THEN 'extract_facts' WHEN entities = 0 AND length(description) < 30 THEN 'delete' WHEN kind = 'figure' THEN 'register_layer1' WHEN subject IN ('economy', 'promo') THEN 'extract_facts' WHEN subject = 'small' THEN 'delete' WHEN subject = 'large' THEN 'register_layer1' ELSE 'extract_facts' END AS route,
CASE WHEN NOT described THEN 'no_description' WHEN entities = 0 AND length(description) < 30 THEN 'low_information' WHEN kind = 'figure' AND subject = 'standard' THEN 'figure_standard' WHEN kind = 'figure' THEN 'figure_unknown:' || subject ELSE 'table_' || subject END AS reason,
CASE WHEN NOT described THEN 0.35 WHEN entities = 0 AND length(description) < 30 THEN 0.75 WHEN kind = 'figure' AND subject = 'standard' THEN 0.85 WHEN kind = 'figure' THEN 0.55 WHEN subject IN ('economy', 'promo') THEN 0.85 WHEN subject = 'small' THEN 0.8 WHEN subject = 'large' THEN 0.72 ELSE 0.6 END::DOUBLE AS confidence FROM u""")
def unit_route(t):
    """PRJ-16."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "figure").otherwise("table")
    r = X.unit_route(F.col("p_partkey") % 7 > 0, F.col("p_name"), F.col("p_size") % 3, kind, F.col("p_type"), figures=["standard"], extract=["economy", "promo"], register=["large"], drop=["small"])
    return t.part.select("p_partkey", r.alias("r")).select("p_partkey", "r.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS hit FROM part""")
def label_match(t):
    """PRJ-27."""
    return t.part.select("p_partkey", X.label_matches(_pick("p_partkey", ["Example-E4", "Comparative Example 4", "Coating: C4", "blank"]), _pick("p_partkey", ["E4", "C4", "c4", "E1"])).alias("hit"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'reed') THEN 'reed' WHEN contains(lower(text), 'the') THEN 'the' END AS value, CASE WHEN contains(lower(text), 'reed') THEN 0.88 WHEN contains(lower(text), 'the') THEN 0.84 END::DOUBLE AS confidence,
CASE WHEN contains(lower(text), 'reed') THEN substr(lower(text), greatest(1, strpos(lower(text), 'reed') - 10)::INT, 20) WHEN contains(lower(text), 'the') THEN substr(lower(text), greatest(1, strpos(lower(text), 'the') - 10)::INT, 20) END AS evidence FROM documents""")
def profile_rules(t):
    """PRJ-29, PRJ-36: the first rule with its confidence and the text around it."""
    r = X.by_rules(F.lower("text"), [("reed", "reed", 0.88), ("the", "the", 0.84)], 10)
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.value", "r.confidence", "r.evidence")


@query("""WITH c AS (SELECT l_orderkey, (l_linenumber - 1) % 3 AS r, l_returnflag AS f, l_partkey FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 50 = 0) THEN 'result' WHEN min(l_partkey) % 3 = 0 THEN 'formulation' WHEN min(l_partkey) % 3 = 1 THEN 'result' WHEN bool_or(f = 'A') THEN 'result' ELSE 'unknown' END AS role FROM c GROUP BY 1""")
def table_role(t):
    """PRJ-30: caption hints, then the header, then sample labels in the first column."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.max(F.col("l_partkey") % 50 == 0).alias("hint"), (F.min("l_partkey") % 3).alias("m"), F.collect_list(F.when(F.col("l_returnflag") == "A", "Example 2").otherwise("mean")).alias("col"))
    head = F.when(F.col("m") == 0, "Model paint no.").when(F.col("m") == 1, "Ref. A").otherwise("Property")
    return g.select("l_orderkey", X.table_role(head, F.lit(""), F.col("col"), F.when(F.col("hint"), "Test results of").otherwise("Table"), ["test results"]).alias("role"))


@query("""WITH c AS (SELECT conv_id, (turn // 3)::INTEGER AS r, (turn % 3)::INTEGER AS k, text FROM conversations), h AS (SELECT conv_id, k, text AS column_label FROM c WHERE r = 0 AND k > 0), l AS (SELECT conv_id, r, text AS row_label FROM c WHERE r > 0 AND k = 0)
SELECT conv_id, c.r AS "row", c.k AS "column", coalesce(row_label, '') AS row_label, coalesce(nullif(trim(column_label), ''), 'col_' || c.k) AS column_label, text FROM c LEFT JOIN l USING (conv_id, r) LEFT JOIN h USING (conv_id, k) WHERE c.r > 0 AND c.k > 0 AND trim(text) NOT IN ('', 'unknown')""")
def header_unpivot(t):
    """PRJ-21, PRJ-30: cells with their row and column labels; a conversation's turns fill a table of three columns."""
    cells = t.conversations.select("conv_id", (F.col("turn") / 3).cast("int").alias("row"), (F.col("turn") % 3).cast("int").alias("column"), "text")
    return X.unpivot(cells, "conv_id")


@query("""WITH c AS (SELECT p_partkey, 0 AS seq, p_name AS name, 'trade' AS kind, 0.9 AS confidence FROM part UNION ALL SELECT p_partkey, 1, p_type, 'generic', 0.95 FROM part)
SELECT p_partkey, seq::INTEGER AS seq, name, kind, least(confidence, CASE kind WHEN 'trade' THEN 0.85 WHEN 'generic' THEN 0.88 END)::DOUBLE AS confidence, substr(sha1(concat_ws('|', p_partkey, seq, name)), 1, 16) AS structure_id FROM c WHERE NOT regexp_matches(name, 'ring|PROMO')""")
def structure_candidates(t):
    """PRJ-31."""
    pair = lambda n, k, c: F.struct(F.col(n).alias("name"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    rows = t.part.select("p_partkey", F.array(pair("p_name", "trade", 0.9), pair("p_type", "generic", 0.95)).alias("c"))
    return X.structure_candidates(rows, "p_partkey", "c", "ring|PROMO", {"trade": 0.85, "generic": 0.88})


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE c_mktsegment END AS label, CASE WHEN c_mktsegment = 'BUILDING' THEN 'architectural,industrial' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'vehicle' ELSE c_mktsegment END AS families,
concat_ws('; ', 'name:' || c_name, CASE WHEN c_nationkey > 5 THEN 'nation:' || c_nationkey END) AS cell FROM customer""")
def record_rendering(t):
    """PRJ-03, PRJ-06 to PRJ-08, PRJ-10, PRJ-34: labels, families and cells of a record."""
    seg = F.col("c_mktsegment")
    fam = X.families(X.values_of(F.array(seg, F.concat(F.lit(" "), seg)), F.array(F.lit(" "))), {"building": ["architectural", "industrial"]}, {"automobile": "vehicle"})
    cell = X.render([("name", F.col("c_name")), ("nation", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")))], 900)
    return t.customer.select("c_custkey", X.label_of(F.when(F.col("c_acctbal") < 0, "in debt"), F.lit("unknown"), seg).alias("label"), F.array_join(fam, ",").alias("families"), cell.alias("cell"))


@query("""SELECT CASE WHEN p_name LIKE '%red ring%' THEN 'override' WHEN p_type IN ('PROMO') THEN 'canonical' WHEN p_name LIKE '%bolt%' THEN 'fastener' WHEN p_name LIKE '%blue%' THEN 'colour' ELSE 'other' END AS bucket, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def property_buckets(t):
    """PRJ-35: an override, else the canonical bucket, else keywords."""
    b = X.bucket_of(F.when(F.col("p_type") == "PROMO", "canonical"), F.col("p_name"), [("bolt", "fastener"), ("blue", "colour")], [("red ring", "override")])
    return t.part.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') LIKE '%00001%' GROUP BY 1""")
def full_predicate(t):
    """FLT-02, FLT-04, FLT-06, FLT-09 to FLT-11: and across fields, or within."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    ok = X.predicate({"priority": ["1-URGENT", "2-high"], "family": ["building", "Machinery"], "assignee": ["00001"], "axis": [" "]}, {"priority": ("equal", F.col("o_orderpriority")), "family": ("any", F.array("c_mktsegment")), "assignee": ("text", F.col("c_name")), "axis": ("any", F.array("c_mktsegment"))})
    return rows.where(ok).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_size > 10 AND (p_type = 'PROMO' OR p_name LIKE 'red%') GROUP BY 1")
def native_expression(t):
    """FLT-22: an expression over allowed columns."""
    return t.part.where(X.safe_expression("p_size > 10 AND (p_type = 'PROMO' OR p_name LIKE 'red%')", t.part.columns)).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (p_brand IN ('Brand#1', 'Brand#2', 'Brand#7'))::BIGINT AS known, 0::BIGINT AS unknown_family, count(*) FILTER (p_type NOT IN ('PROMO', 'SMALL'))::BIGINT AS valid FROM part")
def property_family(t):
    """FLT-12, FLT-23: members of families; an unknown family rejects all; stop values go."""
    members = {"a": ["Brand#1", "Brand#2"], "b": ["Brand#7"]}
    n = lambda c: F.count(F.when(c, 1))
    return t.part.agg(n(X.in_families(F.col("p_brand"), ["a", "b"], members)).alias("known"), n(X.in_families(F.col("p_brand"), ["a", "zz"], members)).alias("unknown_family"), n(F.size(X.valid_only(F.array("p_type"), ["promo", "small"])) > 0).alias("valid"))


@query("""WITH a AS (SELECT n_nationkey AS org, lower(n_name) AS k FROM nation WHERE n_nationkey % 4 != 3), d AS (SELECT o_orderkey, n_nationkey AS org FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION SELECT l_orderkey, n_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber = 1)
SELECT o_orderkey, string_agg(DISTINCT CAST(org AS VARCHAR), ',' ORDER BY CAST(org AS VARCHAR)) AS assignees FROM d GROUP BY 1 HAVING bool_and(org IN (SELECT org FROM a))""")
def org_aliases(t):
    """JOIN-15: all assignees must resolve to active organisations."""
    n = t.nation
    registry = n.select(F.col("n_nationkey").cast("string").alias("canonical_id"), F.col("n_name").alias("canonical_name"), F.array(F.concat("n_name", F.lit("."))).alias("aliases"), F.when(F.col("n_nationkey") % 4 == 3, "retired").otherwise("active").alias("status"), F.lit(2).alias("record_version"))
    registry = registry.unionAll(registry.withColumn("record_version", F.lit(1)).withColumn("status", F.lit("active")))
    names = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")
    more = t.lineitem.where("l_linenumber = 1").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("l_orderkey").alias("o_orderkey"), "n_name")
    docs = names.unionAll(more).groupBy("o_orderkey").agg(F.collect_set(F.upper("n_name")).alias("names"))
    aliases, _ = X.organisation_aliases(registry)
    return X.all_resolved(docs, "o_orderkey", "names", aliases).select("o_orderkey", F.array_join("assignees", ",").alias("assignees"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (SELECT count(DISTINCT l_suppkey) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey)::INTEGER AS n_sources FROM lineitem a WHERE l_suppkey = (SELECT min(l_suppkey) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey)""")
def source_scope(t):
    """JOIN-08: the first source that has a key, the others reported."""
    return X.first_source(t.lineitem, ["l_orderkey"], "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n_sources")


@query("""SELECT l_orderkey, list_aggregate(list_sort(list(DISTINCT l_partkey)), 'string_agg', ',') AS facts, count(DISTINCT l_partkey)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '2-HIGH' GROUP BY 1""")
def facts_by_context(t):
    """JOIN-12, JOIN-17: the facts of each context that has any."""
    facts = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("facts"), F.countDistinct("l_partkey").alias("n"))
    return facts.join(t.orders.where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 = 1 THEN 'conflict' WHEN o_orderkey % 5 = 2 THEN 'migrated' ELSE 'kept' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'h' || o_orderkey END AS hyperedge_id FROM orders""")
def id_migration(t):
    """SET-10: one id field from two."""
    h, m = F.concat(F.lit("h"), "o_orderkey"), F.col("o_orderkey") % 5
    rows = t.orders.select("o_orderkey", F.when(m == 0, "").when(m == 1, "other").when(m == 2, h).when(m == 3, h).alias("id"), F.when(m.isin(1, 3, 4), h).alias("hyperedge_id"))
    return X.migrate_id(rows, "id", "hyperedge_id")


@query("""SELECT doc_id, node FROM (SELECT doc_id, unnest([CASE WHEN contains(lower(text), 'reed') THEN 'N1' END, CASE WHEN contains(lower(text), 'nicht') THEN 'N2' END, CASE WHEN contains(lower(text), 'que') THEN 'N3' END]) AS node FROM documents) WHERE node IS NOT NULL""")
def rule_graph(t):
    """GRF-06: nodes that a text's words name."""
    return X.rule_hits(t.documents, "doc_id", F.col("text"), [("N1", "Reed"), ("N2", "nicht"), ("N3", "que")])


@query("""SELECT o_orderkey, trim(CAST(o_orderkey % 3 AS VARCHAR)) = '0' AS zero, o_orderstatus = 'P' AS missing_status, o_totalprice > 300000 AS costly FROM orders""")
def context_flags(t):
    """QA-02."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 3 == 0).alias("zero"))
    got = X.context_flags(rows, {"status": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))}, {"costly": F.col("o_totalprice") > 300000})
    return got.select("o_orderkey", "zero", "missing_status", "costly")


@query("""SELECT p_partkey, coverage, row_number() OVER (ORDER BY coalesce(coverage, 101), p_partkey)::INTEGER AS place FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL ELSE p_size * 2 END AS coverage FROM part) QUALIFY place <= 25""")
def low_coverage(t):
    """QA-03: units with the least coverage, unknown ones last; a report of 25."""
    rows = t.part.select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_size") * 2).alias("coverage"))
    top = rows.orderBy(F.coalesce("coverage", F.lit(101)), "p_partkey").limit(25)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("coverage", F.lit(101)), "p_partkey")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 1 THEN 'U_' || l_orderkey WHEN l_linenumber % 3 = 2 THEN 'kept' END AS unit FROM lineitem""")
def pointer_backfill(t):
    """QA-10: the unit of a fact from its id."""
    m = F.col("l_linenumber") % 3
    fact = F.when(m == 1, F.concat(F.lit("FACT_U_"), F.col("l_orderkey").cast("string"), F.lit("_F"), F.col("l_linenumber").cast("string"))).otherwise("x")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.pointer_from_id(fact, F.when(m == 2, "kept")).alias("unit"))


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS n, CASE WHEN c_acctbal >= 0 AND count(o_orderkey) > 0 THEN 'count' WHEN c_acctbal >= 0 THEN 'true_zero' WHEN count(o_orderkey) > 0 THEN 'at_least' ELSE 'incomplete' END AS state FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey, c_acctbal""")
def count_statements(t):
    """QA-07, AGG-25, AGG-26: a true zero is not an incomplete count."""
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("c_custkey", "n", X.count_state(F.col("n"), F.col("c_acctbal") >= 0).alias("state"))


@query("""SELECT p_partkey, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name LIKE '%widget%' AND p_brand != 'Brand#1' AND l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def role_audit(t):
    """QA-05: rows whose material has the wrong role, with the hyperedges that depend on them."""
    wrong = t.part.where(T.needle_in(F.col("p_name"), ["widget"]) & (F.col("p_brand") != "Brand#1")).select("p_partkey")
    rows = t.lineitem.where("l_returnflag = 'R'").join(wrong, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "l_orderkey").distinct()
    live = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.join(live, "l_orderkey", "left_semi").select("p_partkey", "l_orderkey")


@query("""SELECT o_orderkey, count(*)::BIGINT AS n_expanded, count(p_partkey)::BIGINT AS n_resolved FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 48) ON l_partkey = p_partkey WHERE o_orderpriority = '5-LOW' GROUP BY 1 HAVING count(*) = count(p_partkey)""")
def answer_gate(t):
    """QA-06: only items all of whose references resolve pass."""
    rows = t.orders.where("o_orderpriority = '5-LOW'").select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    lost = resolve.unresolved(rows, t.part.where("p_size < 48").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]).select("o_orderkey").distinct()
    good = rows.join(lost, "o_orderkey", "left_anti").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_expanded"))
    return good.withColumn("n_resolved", F.col("n_expanded"))
