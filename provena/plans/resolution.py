"""Id resolution, survivorship and graph queries on the fixture: orders are hyperedges, line items facts, parts evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import audit, resolve
from provena.operators import survivorship as S
from provena.plans.registry import query

FULL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _fact_parts(t):
    """Facts (order's customer, part) and edges that name some of them by id."""
    facts = t.lineitem.select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("fact_id"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("source_object"), (F.col("l_partkey") % 5).alias("context")).distinct()
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("object_id"), F.col("l_suppkey").alias("doc")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("fact_ids"), (F.min("l_partkey") % 5).alias("context"))
    return first, facts


@query("""WITH facts AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS fact_id, CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS source_object, l_partkey % 5 AS context FROM lineitem),
edges AS (SELECT l_orderkey AS object_id, l_suppkey AS doc, list(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS fact_ids, min(l_partkey) % 5 AS context FROM lineitem GROUP BY 1, 2),
direct AS (SELECT object_id, e.doc, f.fact_id, 1 AS o, 'direct' AS m FROM (SELECT object_id, doc, unnest(fact_ids) AS fact_id FROM edges) e JOIN facts f ON e.doc = f.doc AND e.fact_id = f.fact_id),
linked AS (SELECT object_id, e.doc, f.fact_id, 2, 'source_link' FROM edges e JOIN facts f ON e.doc = f.doc AND f.source_object = object_id),
bare AS (SELECT * FROM edges WHERE object_id NOT IN (SELECT object_id FROM direct UNION SELECT object_id FROM linked)),
ctx AS (SELECT object_id, b.doc, fact_id, 3, 'context' FROM bare b JOIN facts f ON b.doc = f.doc AND b.context = f.context QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY fact_id, b.doc) <= 4),
every AS (SELECT * FROM direct UNION ALL SELECT * FROM linked UNION ALL SELECT * FROM ctx)
SELECT object_id, doc, fact_id, arg_min(m, o) AS match_mode FROM every GROUP BY ALL""")
def expand_closure(t):
    """JOIN-01 to JOIN-03, JOIN-07, GRF-04: by id, by source link, else by context."""
    edges, facts = _fact_parts(t)
    # one row for each fact and link, so that the ranking by fact_id has no ties but equal ones
    return resolve.closure(edges, facts, ["doc"], "fact_id", "context", 4)


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def unresolved_ids(t):
    """JOIN-04, SET-11: references that nothing answers."""
    refs = t.lineitem.select("l_partkey").distinct()
    return resolve.unresolved(refs, t.part.where("p_size < 40").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'")
def profile_lookup(t):
    """JOIN-05: a document's profile; the small dimensions are broadcast by their size."""
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT o_orderkey, 'WO' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || 'A1' AS doc_key FROM orders""")
def doc_key_join(t):
    """JOIN-06: differently written publication numbers meet on their lookup key."""
    number = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("A1"))
    left = t.orders.select("o_orderkey", T.doc_key(F.concat(F.lit("coll::12_o"), F.lower(number))).alias("doc_key"))
    right = t.orders.select(T.doc_key(F.concat(F.lit(" wo"), F.substring(number, 1, 4), F.lit(" /"), F.substring(number, 5, 20))).alias("doc_key"))
    return left.join(right.distinct(), "doc_key", "left_semi").select("o_orderkey", "doc_key")


@query("""WITH c AS (SELECT o_orderkey AS obj, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT o_orderkey AS obj, o_custkey, o_orderpriority FROM orders WHERE o_totalprice < 170000),
u AS (SELECT o_custkey, o_orderpriority, min(obj) AS row_id FROM r GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c.obj, c.o_custkey, c.o_orderpriority, c.obj AS row_id, 'exact' AS bound_by FROM c JOIN r USING (obj)
UNION ALL SELECT c.obj, c.o_custkey, c.o_orderpriority, row_id, 'legacy' FROM c JOIN u USING (o_custkey, o_orderpriority) WHERE c.obj NOT IN (SELECT obj FROM r)""")
def cohort_binding(t):
    """JOIN-09: exact id, else a legacy key that only one row has."""
    cols = [F.col("o_orderkey").alias("obj"), "o_custkey", "o_orderpriority"]
    return resolve.bind(t.orders.where("o_orderstatus = 'P'").select(*cols), t.orders.where("o_totalprice < 170000").select(*cols), "obj", ["o_custkey", "o_orderpriority"])


@query("""SELECT DISTINCT o_orderkey, p_partkey FROM orders, part WHERE o_orderkey = p_partkey OR o_custkey = p_partkey OR o_custkey = p_size * 10""")
def or_join(t):
    """JOIN-11: an OR of equalities as a union of equi-joins."""
    left = t.orders.select("o_orderkey", "o_custkey")
    right = t.part.select("p_partkey", (F.col("p_size") * 10).cast("long").alias("tenfold"))
    return resolve.any_of(left, right, [("o_orderkey", "p_partkey"), ("o_custkey", "p_partkey"), ("o_custkey", "tenfold")], "o_orderkey", "p_partkey")


@query("""WITH a AS (SELECT lower(p_name) AS k, arg_max(p_brand, (p_retailprice, p_brand)) AS canonical_id FROM part WHERE p_size < 30 GROUP BY 1), m AS (SELECT lower(p_name) AS k, min(p_brand) AS canonical_id FROM part WHERE p_size = 50 GROUP BY 1),
n AS (SELECT lower(p_name) AS k, min(p_type) AS canonical_id FROM part GROUP BY 1), x AS (SELECT p_partkey, lower(p_name) AS k FROM part)
SELECT p_partkey, coalesce(m.canonical_id, a.canonical_id, n.canonical_id) AS canonical_id, CASE WHEN m.canonical_id IS NOT NULL THEN 'must_merge' WHEN a.canonical_id IS NOT NULL THEN 'alias' WHEN n.canonical_id IS NOT NULL THEN 'node' ELSE 'none' END AS resolved_by
FROM x LEFT JOIN m USING (k) LEFT JOIN a USING (k) LEFT JOIN n USING (k)""")
def alias_resolve(t):
    """JOIN-13: must-merge, else the most confident alias, else a node."""
    p = t.part
    must = p.where("p_size = 50").select(F.col("p_name").alias("alias_text"), F.col("p_brand").alias("canonical_id"))
    aliases = p.where("p_size < 30").select(F.upper("p_name").alias("alias_text"), F.col("p_brand").alias("canonical_id"), F.col("p_retailprice").alias("confidence"))
    nodes = p.select(F.col("p_type").alias("canonical_id"), F.col("p_name").alias("name"))
    return resolve.resolve_alias(p.select("p_partkey", F.concat(F.lit(" "), "p_name").alias("label")), "label", must, aliases, nodes).select("p_partkey", "canonical_id", "resolved_by")


@query("""WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ' AS t FROM documents), a AS (SELECT * FROM (VALUES ('the', 'C1'), ('of the', 'C1'), ('was to', 'C2'), ('reed', 'C3'), ('in a the', 'C4')) a(alias_text, canonical_id)),
h AS (SELECT doc_id, canonical_id, alias_text FROM w, a WHERE contains(t, ' ' || alias_text || ' '))
SELECT doc_id, canonical_id, arg_min(alias_text, (-length(alias_text), alias_text)) AS alias_text FROM h GROUP BY 1, 2""")
def alias_text_match(t):
    """JOIN-16: the longest alias of each canonical id in a text."""
    aliases = t.spark.createDataFrame([("the", "C1"), ("of the", "C1"), ("was to", "C2"), ("reed", "C3"), ("in a the", "C4")], "alias_text string, canonical_id string")
    # the SQL's words are of a-z only
    texts = t.documents.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text"))
    return resolve.mentions(texts, "doc_id", "text", aliases)


@query("""WITH b AS (SELECT l_orderkey, l_suppkey, min(l_partkey) AS baseline_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l_orderkey, l_suppkey, l_partkey, baseline_id FROM lineitem JOIN b USING (l_orderkey, l_suppkey) WHERE l_returnflag != 'R'""")
def comparison_pairs(t):
    """JOIN-18, GRF-02: facts with the one baseline of their scope."""
    return resolve.comparison_pairs(t.lineitem, "l_partkey", ["l_orderkey", "l_suppkey"], F.col("l_returnflag") != "R", F.col("l_returnflag") == "R")


@query("""WITH a AS (SELECT l_orderkey, min(l_returnflag) AS value, 0.95 AS c FROM lineitem WHERE l_discount = 0.05 GROUP BY 1), b AS (SELECT c_custkey, c_mktsegment AS value, 0.9 AS c FROM customer WHERE c_acctbal > 0)
SELECT o_orderkey, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'assertion' WHEN b.value IS NOT NULL THEN 'profile' END AS source, CASE WHEN a.value IS NOT NULL THEN 0.88 WHEN b.value IS NOT NULL THEN 0.8 END::DOUBLE AS confidence
FROM orders LEFT JOIN a ON o_orderkey = l_orderkey LEFT JOIN b ON o_custkey = c_custkey""")
def context_inherit(t):
    """JOIN-19: the first source with a value, its confidence capped."""
    a = t.lineitem.where("l_discount = 0.05").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("value"), F.lit(0.95).alias("confidence")).withColumnRenamed("l_orderkey", "o_orderkey")
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("value"), F.lit(0.9).alias("confidence"))
    return resolve.inherit(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", [("assertion", a, "o_orderkey", 0.88), ("profile", b, "o_custkey", 0.80)]).select("o_orderkey", "value", "source", "confidence")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS doc FROM orders), f AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey % 3) AS d, count(DISTINCT l_suppkey % 3) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN doc IS NOT NULL THEN doc WHEN n = 1 THEN d END AS doc, CASE WHEN doc IS NOT NULL THEN 'kept' WHEN n = 1 THEN 'repaired' WHEN n > 1 THEN 'conflict' ELSE 'missing' END AS state FROM r LEFT JOIN f USING (o_orderkey)""")
def doc_id_repair(t):
    """JOIN-20: a missing document from references that agree."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("doc"))
    refs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 3).alias("doc"))
    return resolve.repair_missing(rows, "o_orderkey", "doc", refs)


_RULES = [("BUILDING", "layer", "top"), ("BUILDING", "supply", "liquid"), ("MACHINERY", "layer", "base")]


@query("""WITH r(raw, axis, value) AS (VALUES ('BUILDING', 'layer', 'top'), ('BUILDING', 'supply', 'liquid'), ('MACHINERY', 'layer', 'base'))
SELECT 'mapped' AS state, axis, value, count(*)::BIGINT AS n FROM customer JOIN r ON c_mktsegment = raw GROUP BY ALL UNION ALL SELECT 'unmapped', c_mktsegment, '', count(*) FROM customer WHERE c_mktsegment NOT IN (SELECT raw FROM r) GROUP BY ALL""")
def profile_projection(t):
    """JOIN-21: axis values by exact rules; what has no rule is reported."""
    rules = t.spark.createDataFrame(_RULES, "raw string, axis string, value string")
    mapped, rest = resolve.project_axes(t.customer.select("c_custkey", F.col("c_mktsegment").alias("raw")), rules, ["raw"])
    a = mapped.groupBy(F.lit("mapped").alias("state"), "axis", "value").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(rest.groupBy(F.lit("unmapped").alias("state"), F.col("raw").alias("axis"), F.lit("").alias("value")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + ", ".join(FULL) + ") = 1")
def first_wins_dedupe(t):
    """SET-01, SET-02: the first row of a key by a total order."""
    return S.first_wins(t.lineitem, ["l_orderkey", "l_linenumber"], FULL).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, md5(concat_ws('|', l_partkey, l_suppkey)) AS raw_hash, count(*)::BIGINT AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS origins FROM lineitem GROUP BY ALL""")
def variant_dedupe(t):
    """SET-03: distinct contents of a key with their origins."""
    return S.variants(t.lineitem, ["l_orderkey", "l_linenumber"], F.concat_ws("|", "l_partkey", "l_suppkey").cast("binary"), F.col("l_returnflag"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey)::BIGINT AS variants, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def conflict_detect(t):
    """SET-04."""
    return S.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) = 1")
def ambiguity_exclusion(t):
    """SET-05: keys with one content only."""
    rows = S.without_conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_partkey"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS kind, CASE WHEN value < 50 THEN NULL ELSE value END AS amount FROM events)
SELECT user_id, arg_max(kind, event_id) FILTER (kind IS NOT NULL) AS kind, arg_max(amount, event_id) FILTER (amount IS NOT NULL) AS amount FROM e GROUP BY 1""")
def merge_last_non_null(t):
    """SET-06: for every field the latest value there is."""
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"), F.when(F.col("value") >= 50, F.col("value")).alias("amount"))
    return S.last_non_null(rows, "user_id", ["kind", "amount"], F.col("event_id"))


@query("""WITH m AS (SELECT DISTINCT least(lower(p_brand), lower(p_type)) AS a, greatest(lower(p_brand), lower(p_type)) AS b FROM part WHERE p_size < 10), f AS (SELECT DISTINCT least(lower(p_brand), lower(p_type)) AS a, greatest(lower(p_brand), lower(p_type)) AS b FROM part WHERE p_size > 46) SELECT a, b FROM m JOIN f USING (a, b)""")
def pair_conflict(t):
    """SET-09, JOIN-14: pairs both to merge and forbidden to, in either order."""
    must = t.part.where("p_size < 10").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    return S.pair_conflicts(must, t.part.where("p_size > 46").select(F.col("p_type").alias("a"), F.upper("p_brand").alias("b")))


@query("""SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus != 'F' UNION ALL SELECT o_orderkey, o_totalprice * 2, 'U' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey + 100000000, o_totalprice, 'I' FROM orders WHERE o_totalprice > 400000""")
def upsert_merge(t):
    """SNK-04, SNK-05: replaced and new rows."""
    old = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = old.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"))
    added = old.where("o_totalprice > 400000").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), "o_totalprice", F.lit("I").alias("o_orderstatus"))
    return S.upsert(old, changed.unionAll(added), ["o_orderkey"])


@query("""SELECT p_partkey, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT p_partkey, p_brand AS tag FROM part UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size > 25 UNION ALL SELECT l_partkey, l_returnflag FROM lineitem) GROUP BY 1""")
def graph_upsert(t):
    """SET-07, SET-12: the union of what all sources say of a node."""
    a = t.part.select("p_partkey", F.array("p_brand").alias("tags"))
    b = t.part.where("p_size > 25").select("p_partkey", F.array("p_type").alias("tags"))
    c = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_returnflag").alias("tags"))
    return S.union_nodes([a, b, c], "p_partkey", ["tags"]).select("p_partkey", F.array_join("tags", ",").alias("tags"))


def _edges(t):
    return resolve.edges_of(t.lineitem, "HAS_MATERIAL", F.concat(F.lit("O"), "l_orderkey"), F.concat(F.lit("P"), "l_partkey")).unionAll(resolve.edges_of(t.orders, "IN_DOC", F.concat(F.lit("O"), "o_orderkey"), F.concat(F.lit("C"), "o_custkey")))


_EDGES = "(SELECT DISTINCT 'O' || l_orderkey AS src, 'HAS_MATERIAL' AS edge_type, 'P' || l_partkey AS dst FROM lineitem UNION ALL SELECT DISTINCT 'O' || o_orderkey, 'IN_DOC', 'C' || o_custkey FROM orders)"


@query(f"SELECT src, edge_type, dst, 'EDGE_' || substr(sha1(concat_ws('|', edge_type, src, dst)), 1, 16) AS edge_id FROM {_EDGES}")
def edge_emit(t):
    """GRF-01: edges with stable ids."""
    return _edges(t)


@query(f"""SELECT src, edge_type, dst, 'dst' AS missing FROM {_EDGES} WHERE dst LIKE 'P%' AND dst NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 48)""")
def dangling_audit(t):
    """GRF-03: edges with an end that is no node."""
    o, c, p = (d.select(F.concat(F.lit(k), col).alias("node")) for k, col, d in (("O", "o_orderkey", t.orders), ("C", "c_custkey", t.customer), ("P", "p_partkey", t.part.where("p_size <= 48"))))
    return resolve.dangling(_edges(t), o.unionAll(c).unionAll(p)).select("src", "edge_type", "dst", "missing")


@query(f"""WITH s AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_name = 'red ring' AND p_size < 8 UNION ALL SELECT 'O' || o_orderkey FROM orders WHERE o_orderkey % 20 = 0)
SELECT node, dst AS other, edge_type, 'out' AS direction FROM {_EDGES} JOIN s ON src = node UNION ALL SELECT node, src, edge_type, 'in' FROM {_EDGES} JOIN s ON dst = node""")
def graph_one_hop(t):
    """GRF-05, JOIN-23: edges at the matched nodes."""
    seeds = t.part.where("p_name = 'red ring' AND p_size < 8").select(F.concat(F.lit("P"), "p_partkey").alias("node")).unionAll(t.orders.where("o_orderkey % 20 = 0").select(F.concat(F.lit("O"), "o_orderkey")))
    return resolve.one_hop(_edges(t), seeds)


@query(f"""SELECT 'dangling' AS "check", (SELECT count(*) FROM {_EDGES} WHERE dst LIKE 'P%' AND dst NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 48))::BIGINT AS n, false AS ok
UNION ALL SELECT 'conflicts', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_partkey) > 1)), false UNION ALL SELECT 'orphans', 0, true""")
def qa_summary(t):
    """AGG-17: counts of several checks."""
    return audit.qa_summary({"dangling": dangling_audit(t), "conflicts": conflict_detect(t), "orphans": resolve.unresolved(t.lineitem.select("l_orderkey").distinct(), t.orders.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])})
