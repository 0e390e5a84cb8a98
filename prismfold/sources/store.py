"""Derived tables that are built once for some input files and read by many requests."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LAYOUT = "2"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder serves a local master (tests) only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="prismfold-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table that a caller writes."""
    return f"{shared_root(spark)}/prismfold-{name}-{uuid.uuid4().hex}"


def signature(spark: SparkSession, inputs: list[str]) -> str:
    """Changes with the names, sizes, numbers and times of the input files or folders."""
    seen = [LAYOUT]
    for name in inputs:
        path, fs = _fs(spark, name)
        summary = fs.getContentSummary(path)
        seen += [name, summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()]
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:20]


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table as it was built for these inputs, or a new build. Builds stand beside each other, complete ones are marked
    by Spark's success file; two sessions that build at once both end with the same one. by: a column whose values are folders of their own."""
    base = f"{shared_root(spark)}/prismfold-store/{name}-{signature(spark, inputs)}"

    def complete() -> str | None:
        path, fs = _fs(spark, base)
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return next((f"{base}/{n}" for n in names if fs.exists(_fs(spark, f"{base}/{n}/_SUCCESS")[0])), None)

    if complete() is None:
        out = build().write
        (out.partitionBy(by) if by else out).parquet(f"{base}/{uuid.uuid4().hex}")
    return spark.read.parquet(complete())
