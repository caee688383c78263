"""Readers with provenance (survey SRC)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provena.functions.text import clean_json
from provena.runtime import ship

#: The record files of a source folder and their kinds.
FILES = {"hyperedges.jsonl": "hyperedge", "facts.jsonl": "fact", "evidence_units.jsonl": "evidence", "patents.jsonl": "patent", "patent_profiles.jsonl": "profile"}


def doc_hint(path: Column) -> Column:
    """The document that a path names: patents/<doc>/kg_pack/..., else the parent folder (SRC-03)."""
    packed = F.regexp_extract(path, r"patents/([^/]+)/kg_pack/", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(packed != "", packed).otherwise(parent)


def read_jsonl(spark: SparkSession, folder: str, source_id: str = "", names: Sequence[str] = tuple(FILES)) -> DataFrame:
    """Lines of the known files below a folder: source, kind, file, record number from 1, document hint, raw (SRC-01).

    Blank lines are skipped but counted, and a byte order mark is dropped. Lines of
    a file are numbered within their split, then by its offset, so that one large
    file is still read by many tasks.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    rows = rows.where(F.col("name").isin(list(names)))
    part = Window.partitionBy("file", "block")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = rows.withColumn("rn", F.row_number().over(part.orderBy("pos"))).join(sizes, ["file", "block"])
    kinds = F.create_map(*[F.lit(x) for kv in FILES.items() for x in kv])
    raw = F.regexp_replace(F.col("value"), "^﻿", "")
    out = rows.select(F.lit(source_id).alias("source_id"), kinds[F.col("name")].alias("kind"), "file", (F.col("before") + F.col("rn")).alias("record_number"), doc_hint(F.col("file")).alias("doc_hint"), raw.alias("raw"))
    return out.where(F.trim("raw") != "")


def parse(rows: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed columns, rows that are no JSON of the schema), permissively (PRJ-20).

    Code fences and trailing commas are cleaned first; a line that still does not
    parse, or whose fields do not fit the schema, is bad and keeps its raw text.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = kind.add("__bad", "string") if "__bad" not in kind.names else kind
    parsed = rows.withColumn("r", F.from_json(clean_json(F.col("raw")), wide, {"columnNameOfCorruptRecord": "__bad"}))
    good = F.col("r").isNotNull() & F.col("r.__bad").isNull()
    return parsed.where(good).select(*rows.columns, *(F.col("r")[c].alias(c) for c in kind.names if c != "__bad")), parsed.where(~good).drop("r")


def _unzip(batches):
    import io
    import zipfile

    import pyarrow as pa

    for batch in batches:
        for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(body)) as z:
                for name in sorted(n for n in z.namelist() if n.rsplit("/", 1)[-1] in FILES):
                    with z.open(name) as f:
                        numbers, lines = [], []
                        for k, line in enumerate(f, 1):
                            text = line.decode("utf-8-sig" if k == 1 else "utf-8", "replace").rstrip("\r\n")
                            if text.strip():
                                numbers.append(k)
                                lines.append(text)
                            if len(lines) == 2000:
                                yield _zip_rows(pa, path, name, numbers, lines)
                                numbers, lines = [], []
                        yield _zip_rows(pa, path, name, numbers, lines)


def _zip_rows(pa, path, name, numbers, lines):
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([f"{path}!{name}"] * n, pa.string()), pa.array([FILES[name.rsplit("/", 1)[-1]]] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["file", "kind", "record_number", "raw"])


def read_zip(spark: SparkSession, path: str, source_id: str = "") -> DataFrame:
    """Lines of the known files in ZIP archives, members in order of name (SRC-02)."""
    ship(spark)
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_unzip, "file string, kind string, record_number long, raw string")
    return rows.select(F.lit(source_id).alias("source_id"), "kind", "file", "record_number", doc_hint(F.regexp_replace("file", "!", "/")).alias("doc_hint"), "raw")


def load_manifest(spark: SparkSession, path: str) -> Mapping:
    """A manifest of sources, checked (SRC-04): schema 1 or 2, unique source ids, counts that are no less than 0."""
    text = spark.read.text(path, wholetext=True).first()
    manifest = json.loads(text[0]) if text else {}
    if manifest.get("schema_version") not in (1, 2):
        raise ValueError("schema_version must be 1 or 2")
    sources = manifest.get("sources") or []
    ids = [s.get("source_id") for s in sources]
    if not sources or None in ids or len(set(ids)) != len(ids):
        raise ValueError("sources need unique source ids")
    if manifest["schema_version"] == 2 and not manifest.get("collection_id"):
        raise ValueError("schema 2 needs a collection_id")
    for s in sources:
        if not s.get("root") or int(s.get("expected_hyperedges", 0)) < 0:
            raise ValueError(f"source {s['source_id']} is not valid")
    return manifest


def read_manifest(spark: SparkSession, manifest: Mapping) -> DataFrame:
    """All sources of a manifest, with collection and source."""
    out = None
    for s in manifest["sources"]:
        one = (read_zip if s["root"].endswith(".zip") else read_jsonl)(spark, s["root"], s["source_id"])
        one = one.withColumn("collection_id", F.lit(manifest.get("collection_id", "")))
        out = one if out is None else out.unionByName(one)
    return out


def expect_counts(rows: DataFrame, manifest: Mapping) -> DataFrame:
    """Sources whose hyperedges are not as many as declared (SRC-05): empty if all is well."""
    declared = [(s["source_id"], int(s["expected_hyperedges"])) for s in manifest["sources"] if "expected_hyperedges" in s]
    want = rows.sparkSession.createDataFrame(declared, "source_id string, expected long")
    have = rows.where("kind = 'hyperedge'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n != expected")


def flatten_json(rows: DataFrame, raw: str, keep: Sequence[str]) -> DataFrame:
    """(keep, path, text) of all scalars of open JSON; null, blank, 0 and false are dropped (PRJ-05)."""
    import pyarrow as pa

    ship(rows.sparkSession)
    rows = rows.select(*keep, raw)

    def run(batches):
        for batch in batches:
            index, paths, texts = [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    stack = [("", json.loads(text))] if text else []
                except ValueError:
                    stack = []
                found = []
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, dict):
                        stack += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
                    elif isinstance(v, list):
                        stack += [(f"{path}[{k}]", x) for k, x in reversed(list(enumerate(v)))]
                    elif v:
                        found.append((path, v if isinstance(v, str) else str(v)))
                index += [i] * len(found)
                paths += [p for p, _ in found]
                texts += [t for _, t in found]
            own = batch.select(list(range(len(keep)))).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=[*keep, "path", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, path string, text string")
