"""Document structure on the fixture: lines of documents, tags of pages, turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import documents as D
from provena.plans.registry import query

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no FROM documents)"


def _lines(t):
    return D.lines(t.documents, "doc_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, line_no, sha256(line) AS etag FROM l WHERE line_no >= 2 AND line_no < 5")
def line_window(t):
    """SRC-10: a window of lines with their etags."""
    return _lines(t).where("line_no >= 2 AND line_no < 5").select("doc_id", "line_no", F.sha2("line", 256).alias("etag"))


_ZONE = "CASE WHEN starts_with(line, 'The ') THEN 'the' WHEN starts_with(line, 'Of') THEN 'of' END"


@query(f"WITH {_LINES} SELECT doc_id, line_no, coalesce(last_value({_ZONE} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'front') AS zone FROM l")
def zone_tracking(t):
    """WIN-01: the last heading seen."""
    head = F.when(F.col("line").startswith("The "), "the").when(F.col("line").startswith("Of"), "of")
    return D.zones(_lines(t), "doc_id", head).select("doc_id", "line_no", "zone")


@query(f"""WITH {_LINES} SELECT doc_id, line_no, (max((contains(line, 'the'))::INT) OVER w + max((contains(line, 'of'))::INT) OVER w + max((contains(line, '%'))::INT) OVER w)::INTEGER AS signals FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 40 FOLLOWING)""")
def anchor_window(t):
    """WIN-02: distinct signals in the lines ahead."""
    return D.signals_ahead(_lines(t), "doc_id", {k: F.col("line").contains(k) for k in ("the", "of", "%")}).select("doc_id", "line_no", "signals")


@query(f"""WITH {_LINES}, s AS (SELECT *, CASE WHEN starts_with(line, 'The ') THEN 2 ELSE 0 END + CASE WHEN length(line) < 40 THEN 1 ELSE 0 END AS s FROM l), b AS (SELECT doc_id, max((s, line_no)) AS b FROM s WHERE s > 0 GROUP BY 1), p AS (SELECT doc_id, b[2] AS start_line, b[1] AS score FROM b)
SELECT p.doc_id, start_line::INTEGER AS start_line, score::INTEGER AS score, coalesce((SELECT min(line_no) FROM l e WHERE e.doc_id = p.doc_id AND e.line_no > start_line AND starts_with(e.line, 'Th')), (SELECT max(line_no) + 1 FROM l e WHERE e.doc_id = p.doc_id))::INTEGER AS end_line FROM p""")
def section_span(t):
    """TOP-23, TOP-24: the best start and the first hard end after it."""
    line = F.col("line")
    score = F.when(line.startswith("The "), 2).otherwise(0) + F.when(F.length(line) < 40, 1).otherwise(0)
    return D.section_span(_lines(t), "doc_id", score, line.startswith("Th"))


@query(f"""WITH {_LINES}, m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last_line FROM l), k AS (SELECT * FROM m WHERE length(line) >= 30 AND NOT regexp_matches(line, '^\\s*\\d+(\\.\\d+)*\\s*\\S{{0,20}}$'))
SELECT doc_id, line_no, CASE WHEN line_no / greatest(last_line, 1) < 0.15 THEN 'abstract' WHEN line_no / greatest(last_line, 1) > 0.85 THEN 'claims' ELSE 'description' END AS section, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS seq FROM k""")
def passage_extract(t):
    """PRJ-17, PRJ-28: numbered passages by section."""
    return D.passages(_lines(t), "doc_id").select("doc_id", "line_no", "section", "seq")


@query(f"""WITH {_LINES} SELECT doc_id, line_no, 'LEDGER_' || doc_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS VARCHAR), 4, '0') AS ledger_id FROM l WHERE length(line) > 20""")
def evidence_ledger(t):
    """PRJ-26, WIN-03: sequenced evidence ids."""
    return D.ledger(_lines(t).where(F.length("line") > 20), "doc_id", ["line_no"]).select("doc_id", "line_no", "ledger_id")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, (sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS block_no FROM c""")
def continued_merge(t):
    """WIN-04: answers continue the block of their question."""
    return D.merge_continued(t.conversations, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "block_no")


@query("""WITH c AS (SELECT *, lag(CASE WHEN role = 'user' THEN turn END) OVER w AS p, lead(CASE WHEN role = 'user' THEN turn END) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, coalesce(p, n) AS owner FROM c WHERE role = 'assistant'""")
def caption_owner(t):
    """JOIN-24: the block right before, else the one right after."""
    return D.nearest_block(t.conversations, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "owner")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS body FROM pages""")
def html_strip(t):
    """Survey 2.8: text of markup."""
    return t.pages.select("page_id", T.strip_tags(F.col("html")).alias("body"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<li[^>]*>'))::INTEGER AS items, len(regexp_extract_all(html, '<p[^>]*>'))::INTEGER AS paragraphs, len(regexp_extract_all(html, '>[^<]*[0-9][^<]*<'))::INTEGER AS numeric_cells FROM pages""")
def cell_estimate(t):
    """PRJ-22: cells of a kind counted in markup."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return t.pages.select("page_id", n("<li[^>]*>").alias("items"), n("<p[^>]*>").alias("paragraphs"), n(">[^<]*[0-9][^<]*<").alias("numeric_cells"))


@query("""SELECT doc_id, CASE WHEN k = 'negative' THEN 'negative' WHEN k = 'positive' THEN 'positive' WHEN contains(lower(text), 'ther') THEN 'negative' WHEN contains(lower(text), 'the') THEN 'positive' ELSE 'unknown' END AS polarity FROM (SELECT *, CASE doc_id % 9 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'odd' END AS k FROM documents)""")
def polarity_classify(t):
    """PRJ-12: a hint wins, then negative words before positive ones."""
    hint = F.when(F.col("doc_id") % 9 == 0, "negative").when(F.col("doc_id") % 9 == 1, "positive").when(F.col("doc_id") % 9 == 2, "odd")
    return t.documents.select("doc_id", T.polarity(F.col("text"), hint, ["ther"], ["the"]).alias("polarity"))


@query("""SELECT p_partkey, 'MAT_' || regexp_replace(regexp_replace(upper(trim(p_name || ' ' || p_brand)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 'node_' || substr(sha1(lower(concat_ws('|', p_name, p_brand))), 1, 14) AS node_id FROM part""")
def stable_ids(t):
    """Survey 1.4: slugs and stable ids."""
    return t.part.select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand"), "MAT_").alias("slug"), T.stable_id("node", F.col("p_name"), F.col("p_brand")).alias("node_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown_year' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders""")
def publication_year(t):
    """PRJ-09: the first year in a date text."""
    text = F.when(F.col("o_orderkey") % 6 == 0, "n. d.").otherwise(F.concat(F.lit("published "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    return t.orders.select("o_orderkey", T.year_of(text).alias("year"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'silyl acrylate / silyl ester acrylic' WHEN 1 THEN 'silicone/polysiloxane' WHEN 2 THEN 'acrylic' WHEN 3 THEN 'epoxy' WHEN 4 THEN 'polyurethane/polyurea' WHEN 5 THEN 'polyester' WHEN 6 THEN 'fluoropolymer' WHEN 7 THEN 'unknown' ELSE CASE WHEN p_partkey % 10 = 8 THEN 'acrylic' ELSE 'mixed/other' END END AS resin FROM part""")
def resin_classify(t):
    """PRJ-11: the first class with a term in the label."""
    names = ["Silyl Acrylate copolymer", "PDMS oil", "methacrylate", "Epoxide", "polyurea", "Polyester", "PTFE", " ", "epoxy acrylate", "alkyd"]
    label = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t.part.select("p_partkey", T.resin_system(label).alias("resin"))


@query("""SELECT 'object ' || vec_id || E'\\nlabel: ' || label || E'\\ndims: ' || len(embedding) AS text, vec_id FROM embeddings""")
def text_template(t):
    """PRJ-01: labelled parts joined and cut to 3200 characters."""
    parts = F.concat_ws("\n", F.concat(F.lit("object "), "vec_id"), F.concat(F.lit("label: "), "label"), F.concat(F.lit("dims: "), F.size("embedding")))
    return t.embeddings.select("vec_id", F.substring(parts, 1, 3200).alias("text"))
