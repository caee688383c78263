"""Predicates and scopes over evidence rows (survey FLT)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.text import is_missing, needle_in

#: What an empty hard scope resolves to: it matches no document.
NOTHING = "__NO_MATCH__"


def cohort(rows: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that the authoritative cohort has (FLT-13)."""
    return rows.join(members.select(*on), list(on), "left_semi")


def scope_table(rows: DataFrame, doc: str, ids: DataFrame | Sequence) -> DataFrame:
    """Document ids as a table of one column ``doc``; ids may be long lists, so they never enter a plan as literals."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(doc)).distinct()
    return rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], rows.select(doc).schema)


def resolve_scope(docs: DataFrame, doc: str, text: Column, wanted: Sequence[str], explicit: DataFrame | Sequence | None = None) -> DataFrame:
    """Documents whose text matches, within explicit ids if given; empty stays empty (FLT-14)."""
    found = docs.where(needle_in(text, wanted)).select(doc).distinct()
    return found if explicit is None else found.join(scope_table(docs, doc, explicit), doc, "left_semi")


def material_group(materials: Column, values: Sequence[str] = (), roles: Sequence[str] = (), match: str = "any") -> Column:
    """A group over an array of structs (role, name): any or all values among the rows of its roles (FLT-07).

    Without values a row of the roles is enough; an empty group is false.
    """
    wanted_roles = [r.strip().lower() for r in roles if r.strip()]
    names = [v.strip() for v in values if v.strip()]
    if not names and not wanted_roles:
        return F.lit(False)
    rows = F.filter(materials, lambda m: F.lower(F.trim(m["role"])).isin(wanted_roles)) if wanted_roles else materials
    if not names:
        return F.size(rows) > 0
    one = lambda group: F.exists(rows, lambda m: needle_in(m["name"], group))
    if match == "all":
        out = F.lit(True)
        for v in names:
            out = out & one([v])
        return out
    return one(names)


def material_groups(materials: Column, groups: Sequence[Mapping]) -> Column:
    """All groups hold (FLT-07)."""
    out = F.lit(True)
    for g in groups:
        out = out & material_group(materials, g.get("values", ()), g.get("roles", ()), g.get("match", "any"))
    return out


def family_matches(actual: Column, wanted: Sequence[str], wide: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Arrays overlap; a wanted name in ``wide`` also matches its aliases and any value that contains it (FLT-08)."""
    low = F.transform(actual, F.lower)
    names = [w.lower() for w in wanted]
    out = F.arrays_overlap(low, F.array(*map(F.lit, names)))
    for w in names:
        if wide and w in wide:
            aliases = [a.lower() for a in wide[w]]
            out = out | F.arrays_overlap(low, F.array(*map(F.lit, aliases))) | F.exists(low, _holds(w))
    return out


def _holds(word: str):
    return lambda v: v.contains(word)


def domain_gate(title: Column, abstract: Column, primary: Column, secondary: Column, *, against: str, words: str, codes: Sequence[str]) -> Column:
    """accept / uncertain / reject by the first rule that holds; uncertain passes further on (FLT-19)."""
    starts = lambda c: c.rlike("^(?:" + "|".join(codes) + ")")
    has = lambda c, p: F.coalesce(c.rlike("(?i)" + p), F.lit(False))
    return (
        F.when(has(title, against), "reject").when(F.coalesce(starts(primary), F.lit(False)), "accept").when(has(title, words), "accept")
        .when(F.coalesce(starts(secondary), F.lit(False)) & has(abstract, words), "accept").when(has(abstract, words), "uncertain")
        .when(primary.isNull() | (primary == ""), "uncertain").otherwise("reject")
    )


def in_scope(rows: DataFrame, doc: str, scope: DataFrame | Sequence, object_doc: str | None = None) -> DataFrame:
    """Rows whose document, and the one in their qualified id if they have it, lie in scope (FLT-20)."""
    ids = scope_table(rows, doc, scope)
    out = rows.join(ids, doc, "left_semi")
    if object_doc is None:
        return out
    inside = ids.withColumnRenamed(doc, "__scope")
    # a row without one lies in scope by its document, which keeps the join an equi-join
    return out.join(inside, F.coalesce(object_doc, doc) == F.col("__scope"), "left_semi")


def facet_state(hard: Sequence[Column], related: Sequence[Column]) -> Column:
    """direct if all hard facets hold, related if a related one does, else excluded (FLT-21)."""
    every = F.lit(True)
    for h in hard:
        every = every & h
    some = F.lit(False)
    for r in related:
        some = some | r
    return F.when(every, "direct").when(some, "related").otherwise("excluded")


def is_noise(cell: Column, text: Column, value: Column) -> Column:
    """Cell, text and number are all empty (FLT-17)."""
    return is_missing(F.trim(cell)) & is_missing(F.trim(text)) & value.isNull()


@dataclass(frozen=True)
class Receipt:
    """What a filter request came to (FLT-24)."""

    requested: Mapping
    effective: dict[str, list[str]]
    unsupported: list[str]
    adjustments: list[str] = field(default_factory=list)


FIELDS = (
    "doc_ids", "properties", "polarity", "example_kind", "qa_policy", "application_family", "coating_families", "applications", "substrates", "test_methods",
    "test_standards", "material_roles", "materials", "material_groups", "material_canonical_ids", "resin_systems", "assignees", "publication_year", "property_families", "property_canonical_ids_soft",
)


def normalise_request(request: Mapping, aliases: Mapping[str, Mapping[str, str]] | None = None, moves: Mapping[str, Mapping[str, str]] | None = None) -> Receipt:
    """Trim, list, alias and deduplicate the values of a request; unknown fields are reported.

    ``aliases`` maps field to value to canonical value; ``moves`` maps field to
    value to the field where it belongs. Applying the result again changes nothing.
    """
    effective: dict[str, list] = {}
    unsupported, adjustments = [], []
    for name in sorted(request):
        if name not in FIELDS:
            unsupported.append(name)
            continue
        raw = request[name]
        for v in raw if isinstance(raw, (list, tuple)) else [raw]:
            if isinstance(v, Mapping):
                group = {k: list(dict.fromkeys(v[k])) if isinstance(v[k], (list, tuple)) else v[k] for k in sorted(v)}
                if group not in effective.setdefault(name, []):
                    effective[name].append(group)
                continue
            value = str(v if v is not None else "").strip()
            if not value:
                continue
            named = (aliases or {}).get(name, {}).get(value.lower(), value)
            to = (moves or {}).get(name, {}).get(named.lower(), name)
            if named != value:
                adjustments.append(f"{name}: {value} -> {named}")
            if to != name:
                adjustments.append(f"{named}: {name} -> {to}")
            if named not in effective.setdefault(to, []):
                effective[to].append(named)
    return Receipt(dict(request), {k: effective[k] for k in sorted(effective) if effective[k]}, unsupported, adjustments)
