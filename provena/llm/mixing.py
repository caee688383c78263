"""Mixing sources to target weights by iterative proportional fitting, DataFrame operations only.

Documents are summed into cells of (source, lang, topic). The cells' token
weights are raked: scaled in turn so that each marginal meets its target, until
all marginals agree. A document is kept with a probability of its cell's ratio
of raked to natural tokens times one rate for all cells, 1 at most. The rate is
set by cells of material mass: it is the largest at which the cells that would
need more than all their documents hold no more than CLIPPED of the raked
tokens. Those are kept whole, so that a few rare documents do not thin the whole
corpus; the others meet the targets in expectation. With a token budget the rate
is no larger than the budget allows. The rate is a column of the result, and so
is ``gap``, the largest distance of a marginal's share from its target.

Topics are a column of the input if one is named. Else a topic is the surface
feature in which a text stands out most: features are shares of digits,
capitals, marks and line feeds and the length of words, each measured in standard
deviations from its mean over all documents; a text that stands out in none by
one deviation is ``plain``.

Targets that no weights of the cells can meet together (a source that must be
larger than its only language, say) make the fitting go round in a cycle; it
ends when a whole round leaves all weights where they were, and ``gap`` tells
what is missing. The number of rounds has no bound.

Defined results: a null or empty text has no tokens and takes its cell's
probability; a null source, language or topic is a category of its own,
``(none)``; repeated rows are drawn alike, by id; a category without tokens
keeps ratio 1; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.operators.skew import salted_join
from provena.runtime import materialise

DIMS = ("source", "lang", "topic")
#: Targets that are not given temper the natural shares: share ** TEMPER, normalised.
TEMPER = 0.85
#: Rounds end at this gap, or when a round moves a smaller part of all tokens than SETTLED.
TOLERANCE, SETTLED = 1e-6, 1e-6
SEED = 17
#: Cells kept whole though they should be repeated hold this part of the raked tokens at most.
CLIPPED = 0.01
#: Ratios are summed up in steps of this factor, so that the number of sums has a bound.
STEP = 1.01
FEATURES = ("numeric", "capital", "marked", "lined", "wordy")
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Words of the text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _counts(text: Column) -> dict[str, Column]:
    """What topics are told by, each counted once in a text."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "n_tokens": token_count(text), "size": F.length(text), "digits": count("[0-9]"), "capitals": count("[A-Z]"),
        "marks": count("[!?;:(){}\\[\\]$%&*+=|/<>@#^~_-]"), "lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))),
    }


def _topic(rows: DataFrame) -> DataFrame:
    """``topic`` by the features of ``rows``, set against their means over all rows."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    values = (share("digits", "size"), share("capitals", "size"), share("marks", "size"), share("lines", "size"), share("size", "n_tokens"))
    rows = rows.withColumns(dict(zip(FEATURES, values, strict=True)))
    norms = rows.agg(*(f(c).alias(f"{c}_{k}") for c in FEATURES for k, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    far = {c: F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_dev") > 0, F.col(f"{c}_dev")), F.lit(0.0)) for c in FEATURES}
    top = F.greatest(*far.values())
    topic = F.when(top < 1, F.lit("plain"))
    for c, z in far.items():
        topic = topic.when(z == top, F.lit(c))
    return rows.crossJoin(F.broadcast(norms)).withColumn("topic", topic)  # one row of norms


def with_cells(docs: DataFrame, topic_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    keys = [named(c).alias(c) for c in DIMS[:2]]
    if topic_col:
        return docs.select("doc_id", *keys, named(topic_col).alias("topic"), token_count(text).alias("n_tokens"))
    counts = docs.select("doc_id", *keys, *(x.alias(c) for c, x in _counts(text).items()))
    return _topic(materialise(counts, "mix-counts")).select("doc_id", *DIMS, "n_tokens")  # the texts are read once


def _targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None) -> DataFrame:
    """One row per category: its target share of all tokens."""
    natural = cells.groupBy(dim).agg(F.sum("tokens").alias("natural"))
    if given is None:
        raw = natural.select(dim, F.pow("natural", F.lit(TEMPER)).alias("raw"))
    else:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, raw double")
        raw = natural.join(named, dim, "left").select(dim, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select(dim, F.coalesce(F.try_divide("raw", "total"), F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> tuple[DataFrame, float]:
    """Cells with ``weight``, tokens scaled until every marginal meets its target, and the gap that is left.

    ``cells`` has the three dimensions and ``tokens``. All steps are keyed
    aggregates and joins over the cells, each written as a table so that plans
    start anew; the driver sees two numbers a round.
    """
    cells = materialise(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells")
    full = cells.where("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0] or 0.0
    goal = {d: materialise(_targets(full, d, (targets or {}).get(d)), f"target-{d}") for d in DIMS}
    state = full.withColumn("weight", F.col("tokens"))
    gap = 0.0
    while total:
        off = {}
        before = state.withColumn("before", F.col("weight"))
        for k, d in enumerate(DIMS):
            now = before.groupBy(d).agg(F.sum("weight").alias("now"))
            scale = now.join(goal[d], d).select(d, F.coalesce(F.try_divide(F.col("share") * F.lit(total), "now"), F.lit(0.0)).alias("scale"), F.abs(F.col("now") / F.lit(total) - F.col("share")).alias("off"))
            before = before.join(scale.hint("merge"), d).withColumn("weight", F.col("weight") * F.col("scale"))  # no broadcast a step
            off[d] = F.col("off") if not k else F.greatest("gap", "off")
            before = materialise(before.select(*DIMS, "tokens", "weight", "before", off[d].alias("gap")), "raked")
        state = before.select(*DIMS, "tokens", "weight")
        gap, moved = before.agg(F.max("gap"), F.sum(F.abs(F.col("weight") - F.col("before"))) / F.lit(total)).first()
        if gap < TOLERANCE or moved < SETTLED:
            break
    empty = cells.where("tokens <= 0").withColumn("weight", F.lit(0.0))
    return state.unionByName(empty.select(*DIMS, "tokens", "weight")), gap


def sampling_rate(raked: DataFrame, budget: float | None = None) -> DataFrame:
    """One row, ``rate``: what ratios are multiplied by to give probabilities.

    ``raked`` has ``ratio`` and ``weight`` of all cells. From the largest ratio
    down, the first step at which more than CLIPPED of the weight is reached is
    given the probability 1. A budget of tokens lowers the rate to what meets it.
    A table without weight has the rate 1.
    """
    steps = raked.where("weight > 0").groupBy(F.floor(F.log("ratio") / math.log(STEP)).alias("step")).agg(F.max("ratio").alias("top"), F.sum("weight").alias("weight"))
    # the steps are few, however many cells there are: the logarithms of doubles have a bound
    reached = steps.withColumn("reached", F.sum("weight").over(Window.orderBy(F.desc("step"))))
    total = steps.agg(F.sum("weight").alias("total"))
    top = reached.crossJoin(F.broadcast(total)).where(F.col("reached") > F.lit(CLIPPED) * F.col("total")).agg(F.max("top").alias("top"), F.max("total").alias("total"))
    rate = F.lit(1.0) / F.col("top")
    if budget is not None:
        rate = F.least(rate, F.lit(float(budget)) / F.col("total"))
    return top.select(F.coalesce(rate, F.lit(1.0)).alias("rate"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = SEED, topic_col: str | None = None, budget: float | None = None) -> DataFrame:
    """One row per document: its cell, tokens, ratio, probability, the rate and gap of all and whether it is kept."""
    rows = materialise(with_cells(docs, topic_col), "mix-cells")
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    raked, gap = rake(cells, targets)
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))
    raked = materialise(raked.select(*DIMS, "ratio", "weight"), "ratios")
    cells = raked.crossJoin(F.broadcast(sampling_rate(raked, budget))).select(F.struct(*DIMS).alias("cell"), "ratio", "rate", F.least(F.lit(1.0), F.col("ratio") * F.col("rate")).alias("probability"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    decided = salted_join(rows.select("doc_id", F.struct(*DIMS).alias("cell"), "n_tokens"), cells, "cell", "doc_id")  # a cell can hold a third of all rows
    return decided.select("doc_id", "cell.*", "n_tokens", "ratio", "probability", "rate", F.lit(gap).alias("gap"), (draw < F.col("probability")).alias("kept"))


def keep_mixed(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are drawn, with the columns of ``docs``; rows that share an id share the draw."""
    kept = mix(docs, **kw).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked ratio and draw, targets tempered from natural shares."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
