"""Session helpers: the shared scratch folder, plan size estimates, materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset and all runs on one machine (tests, laptops) a local one is made and
    set for the session. A cluster without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="provena-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_count(spark: SparkSession) -> int:
    """How many scratch paths this application has; ``release`` takes what came after."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete this application's scratch tables from the ``since``-th on, but for the last ``keep``.

    Call it once results that read them are stored.
    """
    paths = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep]
    paths[since : len(paths) - keep] = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in gone:
        at = hadoop.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Stored bytes of what ``df`` reads: the sizes of its leaves, where they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)  # a plan without statistics says 2**63 - 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The ids as long; other types are refused, for a cast would make them null."""
    kind = docs.select(docs[id_col]).dtypes[0][1]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must be of an integer type, not {kind}")
    return docs[id_col].cast("long")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="provena-code-")  # the driver's own: its file server hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder) / "provena.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)
