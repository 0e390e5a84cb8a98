"""Versioned Parquet snapshots, taken over in whole."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


class SnapshotMismatch(ValueError):
    """The snapshot is of another version; it must be built anew."""


class SnapshotMissing(FileNotFoundError):
    """There is no snapshot yet."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _builds(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete builds, oldest first: a build counts once its version file is in place."""
    root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in names if n.startswith("build-") and fs.exists(_fs(spark, f"{path}/{n}/version/_SUCCESS")[0]))


def write(docs: DataFrame, path: str, version: str = VERSION) -> None:
    """Write a new build beside the last one. Readers take the newest complete build, so there is one at any moment;
    the one before stays for readers that have begun, older ones go."""
    spark = docs.sparkSession
    build = f"{path}/build-{time.time_ns():020d}"
    docs.write.parquet(f"{build}/data")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{build}/version")
    for old in _builds(spark, path)[:-2]:
        where, fs = _fs(spark, f"{path}/{old}")
        fs.delete(where, True)


def read(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    builds = _builds(spark, path)
    if not builds:
        raise SnapshotMissing(path)
    found = spark.read.schema("version string").json(f"{path}/{builds[-1]}/version").first()
    if found is None or found.version != version:
        raise SnapshotMismatch(f"{path}: version {found and found.version}, wanted {version}")
    return spark.read.parquet(f"{path}/{builds[-1]}/data")


def cached(spark: SparkSession, path: str | None, build: Callable[[], DataFrame]) -> DataFrame:
    """The snapshot as it is, or, where there is none of this version, a fresh build that is written back. Other failures are raised."""
    if path is None:
        return build()
    try:
        return read(spark, path)
    except (SnapshotMissing, SnapshotMismatch):
        write(build(), path)
        return read(spark, path)


# Snapshots in buckets: a change rewrites the buckets of the changed keys only.

BUCKET = "bucket"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_bucketed(docs: DataFrame, path: str, key: str, buckets: int = 64, version: str = VERSION) -> None:
    """A new snapshot dealt to buckets by a hash of the key (one folder each); an existing one is replaced."""
    dealt = docs.withColumn(BUCKET, _bucket(key, buckets))
    dealt.repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data")
    about = docs.sparkSession.createDataFrame([(version, key, buckets)], "version string, key string, buckets int")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def _about(spark: SparkSession, path: str, version: str):
    where, fs = _fs(spark, f"{path}/about/_SUCCESS")
    if not fs.exists(where):
        raise SnapshotMissing(path)
    found = spark.read.schema("version string, key string, buckets int").json(f"{path}/about").first()
    if found is None or found.version != version:
        raise SnapshotMismatch(f"{path}: version {found and found.version}, wanted {version}")
    return found


def _dealt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{path}/data")


def read_bucketed(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    _about(spark, path, version)
    return _dealt(spark, path).drop(BUCKET)


def update_bucketed(spark: SparkSession, path: str, changed: DataFrame | None = None, gone: DataFrame | None = None, version: str = VERSION) -> list[int]:
    """Put changed documents in the place of those with their keys, drop the keys in gone (rows with the key column), and rewrite the
    buckets of both alone; the numbers of these buckets. Further columns of changed documents are added, missing ones are null.

    Spark replaces each touched bucket's files when the job ends; a reader that has begun to read those fails and starts
    anew, others notice nothing. Of changed rows that share a key all are kept. With nothing to do nothing is written.
    """
    about = _about(spark, path, version)
    bucket = _bucket(about.key, about.buckets)
    current = _dealt(spark, path)
    new = None if changed is None else changed.withColumn(BUCKET, bucket)
    keys = [x.select(about.key) for x in (changed, gone) if x is not None]
    if not keys:
        return []
    out = keys[0] if len(keys) == 1 else keys[0].unionAll(keys[1])
    touched = sorted(r[0] for r in out.select(bucket.alias("b")).where(F.col(about.key).isNotNull()).distinct().collect())  # buckets at most
    if not touched:
        return []
    left = current.where(F.col(BUCKET).isin(*touched)).join(out.distinct(), about.key, "left_anti").select(*current.columns)
    rows = left if new is None else left.unionByName(new, allowMissingColumns=True)
    # a bucket that loses its last row is not written, so its folder goes by hand; both frames may read this snapshot, so before it changes
    kept = touched if gone is None else [r[0] for r in rows.select(BUCKET).distinct().collect()]
    rows.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/data")
    for b in set(touched) - set(kept):
        where, fs = _fs(spark, f"{path}/data/{BUCKET}={b}")
        fs.delete(where, True)
    return touched
