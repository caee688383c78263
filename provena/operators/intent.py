"""What a question asks for: facets, numeric constraints, measured values (survey PRJ-23, FLT-15, FLT-16)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions.text import HOURS, MICROMETRES, durations_hours, factor

# The words that name facets, comparisons and contexts.
CFRP = ("cfrp", "pa-cf", "carbon fiber reinforced", "carbon fibre reinforced", "carbon-fiber reinforced", "carbon-fibre reinforced", "碳纤维复合", "碳纤维增强")
SUBSTRATE = ("substrate", "base material", "as substrate", "for substrate", "为基底", "为基材", "作为基底", "作为基材", "基底", "基材", "底材")
ZINC_PRIMER = ("环氧富锌", "富锌", "锌粉", "富锌底漆", "富锌底涂", "zinc-rich", "zinc rich", "zinc dust", "zinc powder", "zinc pigment")
EPOXY = ("epoxy", "环氧")
SALT_TEST = ("salt spray", "salt fog", "astm b117", "iso 9227", "盐雾", "盐霧")
ADHESION = ("adhesion", "cross-cut", "cross cut", "pull-off", "pull off", "附着")
IMMERSION = ("chemical immersion", "chemical resistance immersion", "seawater immersion", "化学性浸泡", "耐化学性浸泡", "海水浸泡", "挂板海水")
THICKNESS_WORDS = ("film thickness", "dft", "thickness", "膜厚")
SALT_QUERY = ("salt spray", "salt fog", "neutral salt spray", "nss", "aass", "astm b117", "iso 9227", "jis k5600", "盐雾")
SALT_TEXT = (*SALT_QUERY, "salt_spray", "salt_fog", "corrosion_resistance_salt", "corrosion resistance salt")
THICKNESS_QUERY = ("film thickness", "dry film thickness", "coating thickness", "dft", "膜厚")
MORE = (">=", ">", "超过", "大于", "高于", "以上", "不少于", "at least", "more than", "over", "greater than", "above")
LESS = ("<=", "<", "小于", "低于", "少于", "以下", "不超过", "less than", "under", "below", "no more than")
OR_EQUAL = {"le": ("<=", "不超过", "no more than"), "ge": (">=", "不少于", "at least")}
THICKNESS_PATHS = ("film_thickness", "film thickness", "dry_film_thickness", "dry film thickness", "coating_thickness", "coating thickness", "dft", "膜厚")
NO_THICKNESS = ("loss", "change", "rate", "polish", "polishing", "erosion", "wear", "abrasion")
_LENGTHS = "µm|μm|um|mm|inch(?:es)?|in|microns?|micrometers?|millimeters?|mils?|微米"
_TIMES = "hours?|hrs?|hr|h|days?|d|weeks?|wks?|wk|小时|天|周"
THICKNESS = rf"(?i)(?<![A-Za-z0-9.])(\d+(?:\.\d+)?)\s*({_LENGTHS})(?![A-Za-z0-9])"
MEASURE = rf"(?i)(\d+(?:\.\d+)?)\s*({_LENGTHS}|{_TIMES})(?![A-Za-z0-9])"
WINDOW = 36

#: Facets: where they go, groups of words of which each must occur, words that must not, and the values they give.
FACETS = (
    ("hard_substrates", (CFRP, SUBSTRATE), (), ("CFRP", "carbon fiber reinforced plastic", "carbon fiber reinforced composite")),
    ("hard_systems", (ZINC_PRIMER, EPOXY), (), ("epoxy",)),
    ("soft_systems", (ZINC_PRIMER,), EPOXY, ("epoxy",)),
    ("hard_materials", (ZINC_PRIMER,), (), ("zinc powder", "zinc dust", "zinc pigment")),
    ("hard_coating_types", (ZINC_PRIMER,), (), ("primer",)),
    ("soft_tests", (SALT_TEST,), (), ("salt spray", "ASTM B117", "ISO 9227")),
    ("soft_properties", (ADHESION,), (), ("adhesion",)),
    ("soft_tests", (IMMERSION,), (), ("chemical immersion", "seawater immersion")),
)
#: Constraints: the words of the comparison, its sign, the units, their factor, what is constrained and the words that tell so.
CONSTRAINTS = (
    ("超过|大于|高于|>=|>", ">", "小时|hours|hour|hrs|hr|h", 1.0, "salt_spray_duration", "h", SALT_TEST[:-1]),
    ("小于|低于|少于|<=|<", "<", "μm|um|microns|micron|微米", 1.0, "film_thickness", "um", THICKNESS_WORDS),
    ("小于|低于|少于|<=|<", "<", "mils|mil", 25.4, "film_thickness", "um", THICKNESS_WORDS),
)


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def facets(question: Column) -> dict[str, Column]:
    """Arrays of values by facet; each value once, in the order of the rules (PRJ-23)."""
    low = F.lower(F.coalesce(question, F.lit("")))
    found: dict[str, list[Column]] = {}
    for name, groups, never, values in FACETS:
        holds = ~has_any(low, never) if never else F.lit(True)
        for words in groups:
            holds = holds & has_any(low, words)
        found.setdefault(name, []).append(F.when(holds, F.array(*map(F.lit, values))).otherwise(F.array().cast("array<string>")))
    return {name: F.array_distinct(F.concat(*parts)) for name, parts in found.items()}


def _limit(kind: str, op: str, scale: float, unit: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(op).alias("op"), (v.cast("double") * scale).alias("value"), F.lit(unit).alias("unit"))


def constraints(question: Column) -> Column:
    """Array of (kind, op, value, unit) that the question sets as hard limits (PRJ-23)."""
    low = F.lower(F.coalesce(question, F.lit("")))
    parts = []
    for words, op, units, scale, kind, unit, context in CONSTRAINTS:
        values = F.regexp_extract_all(low, F.lit(rf"(?:{words})\s*(\d+(?:\.\d+)?)\s*(?:{units})"), F.lit(1))
        values = F.when(has_any(low, context), values).otherwise(F.array().cast("array<string>"))
        parts.append(F.transform(values, _limit(kind, op, scale, unit)))
    return F.array_distinct(F.concat(*parts))


def kind_of_unit(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low.isin(*HOURS), "duration_hours").when(low.isin(*MICROMETRES), "film_thickness_um")


def comparisons(question: Column) -> Column:
    """Array of (kind, op, value) of the measures that a question compares with (FLT-15).

    The operator is told by words within WINDOW characters before and after a
    measure; a measure without one, or of another kind than the question's, goes.
    Values are hours or micrometres.
    """
    scale = lambda u: F.coalesce(factor(u, HOURS), factor(u, MICROMETRES))

    def sign(near: Column) -> Column:
        less, more = (F.when(has_any(near, OR_EQUAL[a]), a).otherwise(b) for a, b in (("le", "lt"), ("ge", "gt")))
        return F.when(has_any(near, LESS), less).when(has_any(near, MORE), more)

    def split(text: Column) -> Column:
        part = lambda k: F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?){MEASURE}"), F.lit(k))
        asked = F.when(has_any(text, SALT_QUERY), "duration_hours").when(has_any(text, THICKNESS_QUERY), "film_thickness_um")
        return F.struct(text.alias("text"), asked.alias("asked"), part(0).alias("upto"), part(1).alias("gaps"), part(2).alias("values"), part(3).alias("units"))

    def read(s: Column) -> Column:
        text, asked = s["text"], s["asked"]

        def at(gap: Column, i: Column) -> Column:
            """The operator beside the i-th measure, which ends where its stretch of text ends, and begins behind the gap."""
            start = F.aggregate(F.slice(s["upto"], F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)) + F.length(gap)
            around = lambda n: F.concat(F.substr(text, F.greatest(n - WINDOW, F.lit(0)) + 1, F.least(n, F.lit(WINDOW))), F.lit(" "), F.substr(text, n + F.length(F.get(s["upto"], i)) - F.length(gap) + 1, F.lit(WINDOW)))
            return once(once(start, around), sign)

        rows = F.arrays_zip(s["values"].alias("value"), s["units"].alias("unit"), F.transform(s["gaps"], at).alias("op"))
        found = F.transform(rows, lambda r: F.struct(kind_of_unit(r["unit"]).alias("kind"), r["op"].alias("op"), (r["value"].cast("double") * scale(r["unit"])).alias("value")))
        return F.filter(found, lambda r: r["op"].isNotNull() & r["kind"].isNotNull() & (asked.isNull() | (r["kind"] == asked)))

    return once(once(F.translate(F.lower(F.coalesce(question, F.lit(""))), "_-", "  "), split), read)


def salt_durations(text: Column) -> Column:
    """Durations in hours, of texts that speak of salt spray only (FLT-16)."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  ")
    return F.when(has_any(low, SALT_TEXT), durations_hours(text)).otherwise(F.array().cast("array<double>"))


def thickness_um(path: str, value: Column) -> Column:
    """Micrometres that a field holds, if its path speaks of a film's thickness and not of its loss or change (FLT-16)."""
    import re

    low = path.lower().replace("_", " ").replace("-", " ")
    if set(re.split("[^a-z0-9]+", low)) & set(NO_THICKNESS) or not any(m in low for m in THICKNESS_PATHS):
        return F.array().cast("array<double>")
    text = F.coalesce(value.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract_all(text, F.lit(THICKNESS), F.lit(k))
    measured = F.zip_with(part(1), part(2), lambda v, u: v.cast("double") * factor(u, MICROMETRES))
    bare = F.when(F.trim(text).rlike(r"^\d+(\.\d+)?$"), F.array(F.trim(text).cast("double"))).otherwise(F.array().cast("array<double>"))
    last = [x for x in re.split("[^a-z0-9]+", low) if x][-1]
    return measured if last in ("value", "amount") else F.concat(measured, bare)


def satisfies(values: Column, wanted: Column) -> Column:
    """Whether any value meets a comparison (op, value) (FLT-15)."""
    op, limit = wanted["op"], wanted["value"]
    return F.exists(values, lambda v: F.when(op == "gt", v > limit).when(op == "ge", v >= limit).when(op == "lt", v < limit).otherwise(v <= limit))
