"""Continuous intake of product files: an extension beyond batch rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import snapshot
from ..sources.ingest import PATTERN


def upsert(current: DataFrame | None, arrived: DataFrame, key: str = "path", order: str = "mtime") -> DataFrame:
    """current and arrived rows, the latest of each key."""
    both = arrived if current is None else current.unionByName(arrived, allowMissingColumns=True)
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return both.withColumn("__rank", latest).where("__rank = 1").drop("__rank")


def watch(spark: SparkSession, root: str, target: str, checkpoint: str, transform=None, buckets: int | None = None) -> StreamingQuery:
    """Files that appear under root are transformed and merged into the snapshot at target, batch by batch. With buckets the
    snapshot is one in buckets by path, and a batch rewrites those of its own files only."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).load(root)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("mtime", F.unix_timestamp("modificationTime")).drop("modificationTime")
        rows = transform(rows) if transform else rows.drop("content")
        if buckets:
            rows = upsert(None, rows)
            try:
                snapshot.update_bucketed(spark, target, rows)
            except snapshot.SnapshotMissing:
                snapshot.write_bucketed(rows, target, "path", buckets)
            return
        try:
            current = snapshot.read(spark, target)
        except snapshot.SnapshotMissing:  # the first batch; any other failure stops the query before anything is replaced
            current = None
        snapshot.write(upsert(current, rows), target)

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
