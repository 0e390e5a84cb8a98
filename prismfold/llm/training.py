"""Bounded, repeatable samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .families import having, members


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most bound labelled rows, the same ones at every run.

    keep is a condition on the column doc_id. Rows without an id or label are left out; of rows that
    share an id the largest label counts. Rows are taken in the order of a hash of their ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(keep).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = shared.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = shared.ids_and_texts(docs, "doc_id", "text")
    there = having(texts, "doc_id", members(chosen, "doc_id"))
    return there.join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
