"""Scans of id lists, unit folders, SQL seeds and page layouts (survey SRC-06 to SRC-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_by_ids(rows: DataFrame, key: str, ids: DataFrame | Sequence) -> DataFrame:
    """Rows whose key is among the ids, each row once however often an id is asked for (SRC-06).

    The ids are a table: a semi-join, which is broadcast while it is small and
    prunes the scan at run time where the table is partitioned by the key.
    """
    if not isinstance(ids, DataFrame):
        ids = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], rows.select(key).schema)
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_units(spark: SparkSession, root: str) -> DataFrame:
    """One evidence record a unit folder ``data/units/U_*``, from its side files (SRC-07).

    A unit has ``meta.json``; a unit without it, or whose meta is no JSON, is no
    record. The caption file goes before the caption in meta; a missing document is
    read from the unit's name (the part before ``_U``, ``_T`` or ``_F`` and digits).
    A unit routed to ``register_layer1`` is context only. ``files`` keeps the raw
    text of all side files.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(f"{root}/data/units", wholetext=True)
    path = F.col("_metadata.file_path")
    files = files.select(F.regexp_extract(path, r"/(U_[^/]+)/[^/]+$", 1).alias("folder"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("body")).where("folder != ''")
    units = files.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("name", "body"))).alias("files"))
    at = lambda name, field: F.get_json_object(F.col("files")[name], f"$.{field}")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    unit = F.coalesce(filled(at("meta.json", "unit_id")), F.col("folder"))
    doc = F.coalesce(filled(at("meta.json", "doc_id")), F.regexp_extract(F.col("folder"), r"^U_(.+?)_[UTF]\d+$", 1))
    strings = lambda name, field: F.from_json(at(name, field), "array<string>")
    return units.where(F.get_json_object(F.col("files")["meta.json"], "$").startswith("{")).select(
        unit.alias("unit_id"), doc.alias("doc_id"), at("meta.json", "unit_type").alias("evidence_type"), at("meta.json", "page").cast("int").alias("page"),
        F.coalesce(filled(F.col("files")["caption.txt"]), at("meta.json", "caption_footnote_text")).alias("caption"),
        at("vlm_description.json", "description").alias("description"), F.coalesce(strings("vlm_description.json", "identified_entities"), F.array().cast("array<string>")).alias("entities"),
        at("route_decision.json", "route").alias("route"), F.coalesce(at("route_decision.json", "route") == "register_layer1", F.lit(False)).alias("context_only"),
        F.coalesce(F.size(F.from_json(at("matched_paragraphs.json", "matches"), "array<string>")), F.lit(0)).alias("paragraphs"), "files",
    )


#: A quoted value of a tuple, and a tuple; a quote inside is doubled.
_VALUE = r"'(?:[^']|'')*'|[^',()\s][^',()]*"
_TUPLE = rf"\(\s*(?:{_VALUE})\s*(?:,\s*(?:{_VALUE})\s*)*\)"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, row, values) of all tuples of ``INSERT INTO table (...) VALUES (...), (...)`` in SQL files (SRC-08).

    Rows are numbered from 1 within their statement's order in the file; values are
    texts without quotes, NULL is null, and comments go.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"(?m)--[^\n]*$", "").alias("sql"))
    statement = rf"(?is)INSERT\s+INTO\s+[\w.\"]+\s*(?:\([^)]*\))?\s*VALUES\s*{_TUPLE}(?:\s*,\s*{_TUPLE})*"
    found = text.select("file", F.posexplode(F.regexp_extract_all("sql", F.lit(statement), F.lit(0))).alias("statement", "s"))
    table = F.regexp_replace(F.regexp_extract("s", r"(?is)INSERT\s+INTO\s+([\w.\"]+)", 1), '"', "")
    body = F.regexp_replace("s", r"(?is)^INSERT\s+INTO\s+[\w.\"]+\s*(?:\([^)]*\))?\s*VALUES\s*", "")
    rows = found.select("file", "statement", table.alias("table"), F.posexplode(F.regexp_extract_all(body, F.lit(_TUPLE), F.lit(0))).alias("row", "tuple"))
    plain = lambda v: F.when(F.upper(v) == "NULL", F.lit(None)).when(v.startswith("'"), F.regexp_replace(F.regexp_replace(v, "^'|'$", ""), "''", "'")).otherwise(v)
    inner = F.regexp_replace("tuple", r"^\(|\)$", "")
    values = F.transform(F.regexp_extract_all(inner, F.lit(_VALUE), F.lit(0)), lambda v: plain(F.trim(v)))
    return rows.select("file", "statement", "table", (F.col("row") + 1).alias("row"), values.alias("values"))


def seed_nodes(seeds: DataFrame, table: str) -> DataFrame:
    """canonical_id, node_type, name of a seed table's tuples; the first tuple of an id wins."""
    rows = seeds.where(F.col("table") == table).select("file", "statement", "row", *(F.col("values")[k].alias(c) for k, c in enumerate(("canonical_id", "node_type", "name"))))
    first = F.min(F.struct("file", "statement", "row", "node_type", "name"))
    return rows.groupBy("canonical_id").agg(first.alias("f")).select("canonical_id", "f.node_type", "f.name")


BLOCK = "type string, text string, content string, page_idx int, bbox array<double>"
PAGES = f"struct<page_num: int, page_size: struct<w: double, h: double>, blocks: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BLOCK.split(', '))}>>>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, type, text, page, bbox) of layout files in either dialect (SRC-09).

    A list of blocks is taken as it is; a list of pages with pixel boxes is brought
    to boxes of 0 to 1000, halves rounded to even. Blocks keep their reading order.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    inner = F.coalesce(F.get_json_object("raw", "$.pages"), F.col("raw"))
    text = text.select("file", inner.alias("raw"), (F.get_json_object(inner, "$[0].blocks").isNotNull()).alias("paged"))
    flat = text.where("NOT paged").select("file", F.posexplode(F.from_json("raw", f"array<struct<{BLOCK.replace(' ', ': ').replace(',:', ',')}>>")).alias("block", "b"))
    one = flat.select("file", F.lit(0).alias("page_no"), "block", "b.type", F.coalesce("b.text", "b.content").alias("text"), F.col("b.page_idx").alias("page"), F.transform("b.bbox", lambda v: v.cast("int")).alias("bbox"))
    pages = text.where("paged").select("file", F.posexplode(F.from_json("raw", f"array<{PAGES}>")).alias("page_no", "p"))
    blocks = pages.select("file", "page_no", "p.page_num", "p.page_size", F.posexplode("p.blocks").alias("block", "b"))

    def scaled(v: Column, k: Column) -> Column:
        side = F.when(k % 2 == 0, F.col("page_size.w")).otherwise(F.col("page_size.h"))
        return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * (1000 / side)))).cast("int")

    two = blocks.select("file", "page_no", "block", "b.type", F.coalesce("b.content", "b.text").alias("text"), F.col("page_num").alias("page"), F.transform("b.bbox", scaled).alias("bbox"))
    return one.unionByName(two)
