"""Labels, routes and values drawn from semi-structured records (survey PRJ, FLT-02 to FLT-12, QA-02 to QA-10)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.text import is_missing, needle_in

# How example labels are written, in order of precedence: pattern, prefix, and what the groups mean.
_NUMBERS = r"(\d+(?:\s*(?:/|,|;|-|to|and)\s*\d+)*)"
EXAMPLE_RULES = (
    (rf"(?i)\bComparative\s+Examples?\s+{_NUMBERS}\b", "C", "numbers"),
    (rf"(?i)\bComp(?:arative|\.)?\s*Ex(?:ample|\.)?\s*{_NUMBERS}\b", "C", "numbers"),
    (rf"(?i)\bCE[\s.-]*{_NUMBERS}\b", "C", "numbers"),
    (rf"(?i)\bExamples?\s+{_NUMBERS}\b", "E", "numbers"),
    (rf"(?i)\bEx\.?\s*{_NUMBERS}\b", "E", "numbers"),
    (r"\b([CEI]\d+)(?:[A-Z]\d+)?\b", "", "plain"),
    (r"(?i)\b([CEI])\s*(\d+)\b", "", "two"),
    (r"(?i)used\s*for\s*([CI]?\d+)", "", "used"),
    (r"(?i)\bVergleichsbeispiel\s+(\d+|[A-Z])\b", "C", "plain"),
    (r"(?i)\bBeispiel\s+(\d+|[A-Z])\b", "E", "plain"),
    (r"(?i)^\s*Comparative\s*$", "C", "one"),
)
#: Readings of scanned labels that are known to be wrong.
EXAMPLE_FIXES = {"11": "I1", "12": "I2", "13": "I3", "l1": "I1", "l2": "I2", "l3": "I3", "Cl": "C1", "Cl1": "C1"}


def example_id(text: Column) -> Column:
    """The example that a label names, normalised: ``Examples 24 to 32`` is E24-32, ``Ex1/2`` E1/2, ``CE 2`` C2 (PRJ-14)."""
    value = F.trim(text)
    out = None
    for pattern, prefix, how in EXAMPLE_RULES:
        got = F.regexp_extract(value, pattern, 1) if how != "one" else F.lit("1")
        if how == "numbers":
            digits = F.regexp_extract_all(got, F.lit(r"\d+"), F.lit(0))
            span = F.regexp_replace(got, r"\s+", "").rlike(r"(?i)-|\dto\d") & (F.size(digits) > 1)
            name = F.when(span & F.regexp_replace(got, r"\s+", "").contains("-"), F.concat_ws("-", digits[0], F.element_at(digits, -1))).otherwise(F.array_join(digits, "/"))
            name = F.when(got.rlike(r"(?i)\d\s+to\s+\d"), F.concat_ws("-", digits[0], F.element_at(digits, -1))).otherwise(name)
            got_id = F.concat(F.lit(prefix), name)
        elif how == "two":
            got_id = F.concat(F.upper(got), F.regexp_extract(value, pattern, 2))
        elif how == "used":  # a scanned I reads as 1
            got_id = F.when(got.rlike("^1"), F.concat(F.lit("I"), F.substring(got, 2, 1000))).otherwise(F.upper(got))
        else:
            got_id = F.concat(F.lit(prefix), got)
        out = F.when(value.rlike(pattern), got_id) if out is None else out.when(value.rlike(pattern), got_id)
    fixes = F.create_map(*[F.lit(x) for kv in EXAMPLE_FIXES.items() for x in kv])
    return F.get(F.transform(F.array(out), lambda v: F.coalesce(F.element_at(fixes, v), v)), F.lit(0))  # the rules are applied once


def example_chain(candidates: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(example, which candidate gave it): the first that names one; a bare number counts last, as E<n> (PRJ-15)."""
    given = F.array(*(F.struct(F.lit(n).alias("source"), F.trim(c).alias("label")) for n, c in candidates))
    # the rules stand in the plan once, not once a candidate, or the code made of them grows beyond what a method may hold
    named = F.transform(given, lambda r: F.struct(example_id(r["label"]).alias("example"), r["source"].alias("source")))
    digits = lambda r: F.when(r["label"].rlike(r"^\d+$"), F.concat(F.lit("E"), r["label"]))
    bare = F.transform(given, lambda r: F.struct(digits(r).alias("example"), F.concat(r["source"], F.lit("_digit")).alias("source")))
    first = F.get(F.filter(F.concat(named, bare), lambda r: r["example"].isNotNull()), F.lit(0))
    return first["example"], first["source"]


def unit_route(described: Column, description: Column, entities: Column, kind: Column, subject: Column, *, figures: Sequence[str], extract: Sequence[str], register: Sequence[str], drop: Sequence[str], least: int = 30) -> Column:
    """Route, reason and confidence of a unit by the first rule that holds (PRJ-16)."""
    say = lambda route, why, sure: F.struct(F.lit(route).alias("route"), why.alias("reason"), F.lit(sure).alias("confidence"))
    text = F.trim(F.coalesce(description, F.lit("")))
    sub = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    return (
        F.when(~F.coalesce(described, F.lit(False)), say("extract_facts", F.lit("no_description"), 0.35))
        .when((F.coalesce(entities, F.lit(0)) == 0) & (F.length(text) < least), say("delete", F.lit("low_information"), 0.75))
        .when((kind == "figure") & sub.isin(list(figures)), say("register_layer1", F.concat(F.lit("figure_"), sub), 0.85))
        .when(kind == "figure", say("register_layer1", F.concat(F.lit("figure_unknown:"), sub), 0.55))
        .when(sub.isin(list(extract)), say("extract_facts", F.concat(F.lit("table_"), sub), 0.85))
        .when(sub.isin(list(drop)), say("delete", F.concat(F.lit("table_"), sub), 0.80))
        .when(sub.isin(list(register)), say("register_layer1", F.concat(F.lit("table_"), sub), 0.72))
        .otherwise(say("extract_facts", F.concat(F.lit("table_"), F.coalesce(F.nullif(sub, F.lit("")), F.lit("inferred"))), 0.60))
    )


def label_matches(label: Column, example: Column) -> Column:
    """A row label names an example: equal, with a usual prefix, or containing it (PRJ-27)."""
    a, b = (F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "") for c in (label, example))
    ways = [b, F.concat(F.lit("example"), b), F.concat(F.lit("comparativeexample"), F.regexp_replace(b, "^c", "")), F.concat(F.lit("coating"), b), F.concat(F.lit("modelcoating"), F.regexp_replace(b, "^mc", ""))]
    return (a != "") & (b != "") & (reduce(lambda x, y: x | y, (a == w for w in ways)) | F.contains(a, b))


def by_rules(text: Column, rules: Sequence[tuple[str, str, float]], window: int = 120) -> Column:
    """(value, confidence, evidence) of the first rule (pattern, value, confidence) in the text; null if none (PRJ-29, PRJ-36)."""
    out = None
    for pattern, value, sure in rules:
        at = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)) + 1
        near = F.substring(text, F.greatest(F.lit(1), at - window), F.lit(2 * window))
        hit = F.struct(F.lit(value).alias("value"), F.lit(sure).alias("confidence"), near.alias("evidence"))
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out


def table_role(first_header: Column, unit_cell: Column, first_column: Column, caption: Column, hints: Sequence[str]) -> Column:
    """formulation / result / unknown (PRJ-30)."""
    cap = F.lower(F.coalesce(caption, F.lit("")))
    hinted = reduce(lambda a, b: a | b, (cap.contains(h) for h in hints), F.lit(False))
    head = F.lower(F.coalesce(first_header, F.lit("")))
    return F.when(hinted, "result").when(head.contains("model paint"), "formulation").when(head.rlike(r"^(model|ref|reference)\b"), "result").when(F.exists(first_column, lambda c: example_id(c).isNotNull()), "result").otherwise("unknown")


def unpivot(cells: DataFrame, table: str, header_rows: int = 1) -> DataFrame:
    """Cells (table, row, column, text) to (table, row_label, column_label, text): stacked headers joined per column (PRJ-30, PRJ-21)."""
    head = cells.where((F.col("row") < header_rows) & (F.col("column") > 0)).groupBy(table, "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ").alias("column_label"))
    label = cells.where((F.col("row") >= header_rows) & (F.col("column") == 0)).select(table, "row", F.col("text").alias("row_label"))
    body = cells.where((F.col("row") >= header_rows) & (F.col("column") > 0) & ~is_missing(F.trim("text")))
    out = body.join(label, [table, "row"], "left").join(head, [table, "column"], "left")
    fallback = F.concat(F.lit("col_"), F.col("column").cast("string"))
    return out.select(table, "row", "column", F.coalesce("row_label", F.lit("")).alias("row_label"), F.coalesce(F.nullif(F.trim("column_label"), F.lit("")), fallback).alias("column_label"), "text")


def structure_candidates(rows: DataFrame, unit: str, candidates: str, noise: str, caps: Mapping[str, float]) -> DataFrame:
    """One row a candidate (name, kind, confidence), noise out, confidence capped by kind, with a stable id (PRJ-31)."""
    flat = rows.select(unit, F.posexplode(candidates).alias("seq", "c")).select(unit, "seq", "c.*").where(~F.col("name").rlike(noise))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind"))
    return flat.withColumn("confidence", F.least("confidence", F.coalesce(cap, F.lit(1.0)))).withColumn("structure_id", F.substring(F.sha1(F.concat_ws("|", unit, "seq", "name").cast("binary")), 1, 16))


def values_of(*parts: Column) -> Column:
    """Distinct trimmed non-blank texts of several scalars and arrays, in order (PRJ-06, PRJ-08)."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*parts)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def label_of(*parts: Column) -> Column:
    """The first that is not missing (PRJ-07)."""
    return F.coalesce(*(F.when(~is_missing(F.trim(p)), F.trim(p)) for p in parts))


def families(values: Column, multi: Mapping[str, Sequence[str]], aliases: Mapping[str, str]) -> Column:
    """Family names: a value that stands for several, an alias, else itself; distinct in order (PRJ-10)."""
    table = {**{k: [v] for k, v in aliases.items()}, **{k: list(v) for k, v in multi.items()}}
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.coalesce(F.element_at(m, F.lower(v)), F.array(v)))))


def render(template: Sequence[tuple[str, Column]], cap: int, sep: str = "; ") -> Column:
    """label:value of what is there, joined and cut (PRJ-01, PRJ-03, PRJ-25, PRJ-34)."""
    return F.substring(F.concat_ws(sep, *(F.when(~is_missing(F.trim(c.cast("string"))), F.concat(F.lit(f"{k}:"), c.cast("string"))) for k, c in template)), 1, cap)


def bucket_of(canonical: Column, text: Column, rules: Sequence[tuple[str, str]], overrides: Sequence[tuple[str, str]] = ()) -> Column:
    """Bucket by override patterns, else the canonical one, else keyword patterns, else other (PRJ-35)."""
    over = reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), overrides, F.when(F.lit(False), ""))
    word = reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), rules, F.when(F.lit(False), ""))
    return F.coalesce(over, F.nullif(canonical, F.lit("")), word, F.lit("other"))


def predicate(filters: Mapping[str, Sequence[str]], columns: Mapping[str, tuple[str, Column]]) -> Column:
    """AND across fields, OR within a field (FLT-02). ``columns``: field to (text | equal | any, column).

    text is a needle match, equal compares without case, any overlaps an array without case.
    """
    out = F.lit(True)
    for name, wanted in filters.items():
        kind, col = columns[name]
        low = [w.strip().lower() for w in wanted if w.strip()]
        if not low:
            continue
        if kind == "text":
            out = out & needle_in(col, list(wanted))
        elif kind == "equal":
            out = out & F.coalesce(F.lower(col).isin(low), F.lit(False))
        else:
            out = out & F.coalesce(F.arrays_overlap(F.transform(col, F.lower), F.array(*map(F.lit, low))), F.lit(False))
    return out


_SAFE = re.compile(r"""^(?:[\w.]+|'[^']*'|\d+(?:\.\d+)?|[<>=!]+|\(|\)|,|\s|AND|OR|NOT|IN|LIKE|IS|NULL|BETWEEN)+$""", re.IGNORECASE)


def safe_expression(text: str, columns: Sequence[str]) -> Column:
    """A boolean expression over allowed columns only: no functions, no subqueries (FLT-22)."""
    words = set(re.findall(r"[A-Za-z_]\w*(?=\s*\()", re.sub(r"'[^']*'", "", text))) - {"IN", "in", "AND", "and", "OR", "or", "NOT", "not"}
    names = {w for w in re.findall(r"[A-Za-z_][\w.]*", re.sub(r"'[^']*'", "", text)) if w.upper() not in {"AND", "OR", "NOT", "IN", "LIKE", "IS", "NULL", "BETWEEN"}}
    if not _SAFE.match(text) or words or not names <= set(columns):
        raise ValueError("expression is not allowed")
    return F.expr(text)


def valid_only(values: Column, stop: Sequence[str]) -> Column:
    """Values without a stop list (FLT-23)."""
    return F.filter(values, lambda v: ~F.lower(v).isin(list(stop)))


def in_families(canonical: Column, wanted: Sequence[str], members: Mapping[str, Sequence[str]]) -> Column:
    """Canonical ids of the wanted families; an unknown family rejects all (FLT-12)."""
    if any(w not in members for w in wanted):
        return F.lit(False)
    return canonical.isin(sorted({m for w in wanted for m in members[w]}))


def organisation_aliases(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias to organisation, conflicting aliases) of the latest active records (JOIN-15).

    ``registry``: canonical_id, canonical_name, aliases array, status, record_version.
    """
    latest = registry.groupBy("canonical_id").agg(F.max_by(F.struct("canonical_name", "aliases", "status"), F.col("record_version")).alias("r"))
    flat = latest.where("r.status = 'active'").select("canonical_id", F.coalesce("r.canonical_name", "canonical_id").alias("canonical_name"), F.explode("r.aliases").alias("alias"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("alias"), r"\p{P}", ""), r"\s+", " "))
    flat = flat.withColumn("alias_key", key).where("alias_key != ''").select("alias_key", "canonical_id", "canonical_name").distinct()
    bad = flat.groupBy("alias_key").agg(F.countDistinct("canonical_id").alias("owners")).where("owners > 1")
    return flat.join(bad.select("alias_key"), "alias_key", "left_anti"), bad


def all_resolved(docs: DataFrame, doc: str, names: str, aliases: DataFrame) -> DataFrame:
    """Documents all of whose assignees resolve, with their ids; one unresolved name fails the document (JOIN-15)."""
    flat = docs.select(doc, F.explode(names).alias("n")).withColumn("alias_key", F.trim(F.regexp_replace(F.regexp_replace(F.lower("n"), r"\p{P}", ""), r"\s+", " ")))
    got = flat.join(aliases.select("alias_key", "canonical_id"), "alias_key", "left")
    return got.groupBy(doc).agg(F.array_sort(F.collect_set("canonical_id")).alias("assignees"), F.count(F.when(F.col("canonical_id").isNull(), 1)).alias("unresolved")).where("unresolved = 0").drop("unresolved")


def first_source(rows: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """Rows of the first source that has a key, and how many sources had it (JOIN-08)."""
    w = Window.partitionBy(*key)
    return rows.withColumn("__s", F.min(source).over(w)).withColumn("n_sources", F.size(F.collect_set(source).over(w))).where(F.col(source) == F.col("__s")).drop("__s")


def migrate_id(rows: DataFrame, old: str, new: str) -> DataFrame:
    """One id field from an old and a new one; state says whether they were missing or at odds (SET-10)."""
    a, b = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in (new, old))
    state = F.when(a.isNull() & b.isNull(), "missing").when(a.isNotNull() & b.isNotNull() & (a != b), "conflict").when(a.isNull(), "migrated").otherwise("kept")
    return rows.withColumn("state", state).withColumn(new, F.coalesce(a, b)).drop(old)


def rule_hits(rows: DataFrame, row_id: str, text: Column, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(row, node) for every rule (node, word) whose word the text has (GRF-06)."""
    low = F.lower(text)
    hits = F.filter(F.array(*(F.when(low.contains(w.lower()), F.lit(n)) for n, w in rules)), lambda x: x.isNotNull())
    return rows.select(row_id, F.explode(F.array_distinct(hits)).alias("node"))


def context_flags(rows: DataFrame, missing: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """A boolean for each required field that is missing and each given flag (QA-02)."""
    return rows.select("*", *(is_missing(F.trim(c.cast("string"))).alias(f"missing_{k}") for k, c in missing.items()), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))


#: Coverage below this is too low.
LEAST_COVERAGE = 0.8


def example_flags(rows: DataFrame) -> DataFrame:
    """``rows`` with the twelve flags and the count of an example's context (QA-02).

    Columns: the arrays applications, resin_systems, substrates, test_methods,
    test_standards, coverage_values and table_units (evidence_type, has_html,
    has_image), the booleans polarity_conflict, example_kind_conflict and
    coverage_unknown, comparison_status, low_confidence_facts. Null counts as empty
    or false.
    """
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    tables = lambda field: some("table_units", lambda u: (u["evidence_type"] == "table") & ~F.coalesce(u[field], F.lit(False)))
    return rows.select(
        "*",
        *(empty(f"{c}s").alias(f"missing_{c}") for c in ("application", "resin_system", "substrate", "test_method", "test_standard")),
        yes("polarity_conflict").alias("mixed_polarity"), (~empty("table_units") & (F.size("table_units") > 1)).alias("multi_table_context"), yes("example_kind_conflict").alias("kind_conflict"),
        F.coalesce(F.col("comparison_status") == "unresolved_baseline", F.lit(False)).alias("unresolved_comparison"), F.coalesce("low_confidence_facts", F.lit(0)).alias("low_confidence_fact_count"),
        (tables("has_html") | tables("has_image")).alias("ocr_or_html_missing"), yes("coverage_unknown").alias("coverage_missing"), some("coverage_values", lambda v: v < LEAST_COVERAGE).alias("coverage_below_threshold"),
    )


def select_source(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """For every request the first source that fits it, and how many did (JOIN-08).

    ``requests``: request_id, namespace, collection_id, company. ``sources``:
    source_id, position and the same three. A field that a request leaves blank fits
    all; more than one fitting source is ambiguous, and the first is kept.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    fields = ("namespace", "collection_id", "company")
    asked = requests.select("request_id", *(blank(c).alias(f"__{c}") for c in fields))
    fits = F.lit(True)
    for c in fields:
        fits = fits & (F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)))
    met = asked.join(F.broadcast(sources.select("source_id", "position", *fields)), fits, "left")  # sources of a manifest: a few
    first = F.min(F.when(F.col("source_id").isNotNull(), F.struct("position", "source_id")))["source_id"]
    got = met.groupBy("request_id").agg(first.alias("source_id"), F.count("source_id").alias("candidates"))
    return got.withColumn("state", F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "exact").otherwise("ambiguous"))


def pointer_from_id(fact: Column, unit: Column) -> Column:
    """The unit of a fact's pointer, else the one that its id names (QA-10)."""
    return F.coalesce(F.nullif(F.trim(unit), F.lit("")), F.nullif(F.regexp_extract(fact, r"(U_\w+?)_F\d+$", 1), F.lit("")))


def count_state(n: Column, complete: Column) -> Column:
    """count, at_least, true_zero or incomplete (QA-07, AGG-25)."""
    return F.when(complete & (n > 0), "count").when(complete, "true_zero").when(n > 0, "at_least").otherwise("incomplete")


def expand_query(query: str, concepts: Mapping[str, Sequence[str]], most: int = 3) -> list[str]:
    """The query and variants with the terms of its concepts that it lacks, at most ``most`` (PRJ-24)."""
    out, low = [query], query.lower()
    for name, words in concepts.items():
        if name.lower() in low:
            more = [w for w in words if w.lower() not in low]
            if more:
                out.append(f"{query} {' '.join(more)}")
    return list(dict.fromkeys(out))[:most]


def budget(request: Mapping[str, int], policy: Mapping[str, int]) -> tuple[dict[str, int], list[str]]:
    """The service's retrieval budget over the requested one, with what was changed (PRJ-32)."""
    return dict(policy), [f"{k}: {request[k]} -> {v}" for k, v in policy.items() if k in request and request[k] != v]


#: The names under which material slots come.
SLOTS = {
    "resin": ("resin", "resins", "binder", "binders"), "curing_agent": ("curing_agent", "curing_agents", "crosslinker", "crosslinkers", "hardener", "hardeners"),
    "pigment": ("pigment", "pigments"), "filler": ("filler", "fillers"), "additive": ("additive", "additives"), "solvent": ("solvent", "solvents"),
    "catalyst": ("catalyst", "catalysts"), "tackifier": ("tackifier", "tackifiers"), "plasticizer": ("plasticizer", "plasticizers"), "wax": ("wax", "waxes"),
    "antioxidant": ("antioxidant", "antioxidants"), "reactive_diluent": ("reactive_diluent", "reactive_diluents"), "monomer": ("monomer", "monomers"),
    "biocide": ("biocide", "biocides"), "photoinitiator": ("photoinitiator", "photoinitiators"), "initiator": ("initiator", "initiators"),
    "neutralizer": ("neutralizer", "neutralizers"), "polyol": ("polyol", "polyols"), "resin_precursor": ("resin_precursor", "resin_precursors"),
    "material": ("material", "materials", "material_roles"), "component": ("component", "components"),
}


def material_slot(raw: Column, slot: str) -> Column:
    """Distinct values of a slot of a raw JSON record under any of its names, at the top and then in ``formulation`` (PRJ-02)."""
    parts = []
    for place in ("$.", "$.formulation."):
        for name in SLOTS[slot]:
            v = F.get_json_object(raw, place + name)
            listed = F.from_json(v, "array<string>")
            parts.append(F.when(v.startswith("["), listed).when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def full_projection(rows: DataFrame, key: str, parts: Mapping[str, DataFrame], provenance: Column) -> DataFrame:
    """key, the whole row as JSON, an array of whole rows of every part, and where it came from: nothing is left out (PRJ-04).

    A part's rows of one key are collected, sorted as JSON; a key without rows has an empty array.
    """
    out = rows.select(key, F.to_json(F.struct("*")).alias("raw"), provenance.alias("provenance"))
    for name, part in parts.items():
        own = part.groupBy(key).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in part.columns if c != key])))).alias(name))
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def coerce_fact(resin: Column, additives: Column, substrate: Column, method: Column, standard: Column) -> dict[str, Column]:
    """A raw fact's fields as the schema wants them, and what was changed (PRJ-19).

    ``resin`` and ``additives`` are arrays: the first resin stays, the rest become
    additives. A substrate is the tested one. A standard is kept, or read from a
    method such as ``ISO_9227``; a method that is nothing else goes.
    """
    none = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    names, more = clean(resin), clean(additives)
    body = F.trim(F.coalesce(substrate, F.lit("")))
    tested = F.when(~body.isin("", "unknown"), body)
    rule = r"(?i)(?:^|_)(ISO|ASTM|DIN|GB|JIS)_?([A-Z]?[0-9]+[A-Z0-9]*)"
    named = F.when(method.rlike(rule), F.upper(F.concat_ws(" ", F.regexp_extract(method, rule, 1), F.regexp_extract(method, rule, 2))))
    only = method.rlike(r"(?i)^(ISO|ASTM|DIN|GB|JIS)_?[A-Z]?[0-9]+[A-Z0-9]*$")
    done = lambda holds, field, action: F.when(holds, F.struct(F.lit(field).alias("field"), F.lit(action).alias("action")))
    changes = F.array_compact(F.array(done(F.size(names) > 0, "resin_system", "list_first_item_to_resin_system_rest_to_additives"), done(tested.isNotNull(), "substrate", "string_to_tested_substrate")))
    return {
        "resin_system": F.try_element_at(names, F.lit(1)), "additives": F.array_distinct(F.concat(more, F.slice(names, 2, 1 << 20))), "tested_substrate": tested,
        "standard_id": F.coalesce(F.nullif(F.trim(standard), F.lit("")), named), "test_method": F.when(~F.coalesce(only, F.lit(False)), method), "schema_coercions": changes,
    }


def route_log(units: DataFrame, unit: str, doc: str, route: Column, subject: Column, description: Column) -> DataFrame:
    """Rows of the audit log of routes: confidence with two places, the first 200 characters of the description on one line (QA-04).

    ``route`` is the struct that ``unit_route`` gives. Append them with ``sinks.append_csv``.
    """
    excerpt = F.translate(F.substring(F.coalesce(description, F.lit("")), 1, 200), "\n\r", "  ")
    return units.select(
        F.col(unit).alias("unit_id"), F.col(doc).alias("doc_id"), route["route"].alias("route"), route["reason"].alias("reason"),
        F.format_string("%.2f", route["confidence"].cast("double")).alias("route_confidence"), F.coalesce(subject, F.lit("")).alias("normalized_subject"), excerpt.alias("description_excerpt"),
    )
