"""Secret scans over an incremental blob ledger.

Every historical version of a text is a blob named by its SHA-256. The ledger
holds one row per (blob, rule version) that has been scanned, with what was
found. A run scans only the pairs that the ledger lacks and joins the findings
back to all documents (paths) that carry the blob, so copies and re-runs cost a
hash and a join.

Defined results: a null text is the empty blob; ties and repeated rows share a
blob and each row gets the findings; an empty table gives no rows; columns of
the input other than the id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators.skew import salted_join
from provena.runtime import materialise, scratch_path, ship


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters, found leftmost and without overlap."""

    kind: str
    pattern: str
    group: int
    least: int
    ignore_case: bool = False
    #: Text that any match must contain, for a cheap first look.
    needle: str = ""


#: The rules that every scan has, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, needle="AKIA"),
    # runs of 16 or more are exactly the runs of [0-9a-f]+ that the length test keeps
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds of credentials with a fixed shape.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, needle="PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, needle="eyJ"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{3,64}@", 0, 10, needle="://"),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0))) for r in rules]


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, kind:start:end) of all findings, in code points, sorted."""
    found = []
    for rank, (rule, pattern) in enumerate(compiled):
        if rule.needle and rule.needle not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    found.sort()
    return found


FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def _scan(rules: tuple[Rule, ...], n_base: int):
    def scan(batches):
        compiled = _compiled(rules)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = find_spans(text or "", compiled)
                counts = [sum(x[1] == k for x in found) for k in range(3)]
                rows.append((*counts, ",".join(x[2] for x in found if x[1] < n_base), ",".join(x[2] for x in found)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["blob", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    return scan


class BlobLedger:
    """The ledger at ``path``: Parquet runs, one folder per rule version and run; ``compact`` makes one of many."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        if tuple(r.kind for r in rules[:3]) != ("assign", "access", "hex"):
            raise ValueError("rules must begin with the base rules")
        ship(spark)
        self.spark, self.rules, self.version = spark, rules, rule_version(rules)
        self.path = path or scratch_path(spark, "ledger")
        self.runs = f"{self.path}/rules={self.version}"

    def _folders(self) -> list:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.runs)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted((s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else [])

    def findings(self) -> DataFrame | None:
        """What the ledger holds for this rule version; None before the first run."""
        # runs are named one by one: Spark takes two reads of one folder for the same, whatever was added between them
        found = self._folders()
        return self.spark.read.schema(FOUND).parquet(*found) if found else None

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Scan the unseen blobs of ``docs``; return id, blob and findings of every row."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        versions = docs.select(F.col(id_col).alias("__id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
        paths = materialise(versions.select("__id", "blob"), "paths")
        # one text of each blob: every task forwards a blob once, then one is taken for good
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.findings()
        if seen is not None:
            blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
        blobs.mapInArrow(_scan(self.rules, len(BASE_RULES)), FOUND).write.parquet(scratch_path_in(self.runs))
        # the empty and the clean blobs are most; only blobs with findings travel through the join
        hits = self.findings().where(F.col("spans") != "").dropDuplicates(["blob"])
        back = salted_join(paths, hits, "blob", "__id", "left")
        none = F.lit(0).cast("long")
        return back.select(
            F.col("__id").alias(id_col),
            "blob",
            *(F.coalesce(c, none).alias(c) for c in ("n_assign", "n_access", "n_hex")),
            *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")),
        )


    def compact(self) -> None:
        """All runs of this rule version as one, sorted by blob; the old ones go once the new one is there."""
        old = self._folders()
        self.findings().dropDuplicates(["blob"]).repartitionByRange("blob").sortWithinPartitions("blob").write.parquet(scratch_path_in(self.runs))
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.runs).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for p in old:
            fs.delete(hadoop.Path(p), True)


def scratch_path_in(folder: str) -> str:
    return f"{folder}/run-{uuid.uuid4().hex[:12]}"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document.

    The smaller half of the ids is the first load of an empty ledger; of the rest
    only blobs that the ledger lacks are scanned.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    first = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(True))
    ledger = BlobLedger(spark)
    found = ledger.scan(docs.where(first)).unionAll(ledger.scan(docs.where(~first)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    """The scan in DuckDB: places of matches are the lengths of what lies between them, summed up."""
    each = []
    for rank, r in enumerate(RULES):
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", r.pattern.split(")", 1)[0]) + ")" + r.pattern.split(")", 1)[1] if r.ignore_case else r.pattern
        pattern = pattern.replace("'", "''")
        each.append(
            f"SELECT doc_id, {rank} AS kind, '{r.kind}' AS name, {r.least} AS least, regexp_extract_all(t, '{pattern}') AS found, "
            f"regexp_extract_all(t, '{pattern}', {r.group}) AS part, regexp_split_to_array(t, '{pattern}') AS gaps FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
p AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
s AS (SELECT doc_id, kind, name, length(part[i]) >= least AS good, length(found[i]) AS n,
        (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b FROM p),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(name || ':' || b || ':' || (b + n), ',' ORDER BY b, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || b || ':' || (b + n), ',' ORDER BY b, kind) AS spans
      FROM s WHERE good GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP1_SQL = _sql()
