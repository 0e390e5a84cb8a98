"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Between
stages rows are written as Parquet in the shared folder and read again. All but the last stage return
the columns of documents.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.llm import decontam, line_dedup, merge_dropout, ngram_join, shared, toxicity
from prismfold.llm.families import having, members
from prismfold.llm.training import crc_fold

TOXIC_AT = 0.7


_LEFT: dict[tuple[int, str], shared.Space] = {}


def stage(f):
    """What a stage leaves in the shared folder for its result goes when the next one starts: that has its input stored."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.modest(spark)
        key = (threading.get_ident(), sf_dir)
        if key in _LEFT:
            _LEFT.pop(key).close()
        own = shared.Space()
        if f is not encoded.__wrapped__:  # the last one leaves nothing but its result
            _LEFT[key] = own
        with shared.space(own):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows whose toxicity is TOXIC_AT or more go. Labels of the table labels, fold as in op2."""
    machine = toxicity.train(docs, shared.table(spark, sf_dir, "labels"), crc_fold(F.col("doc_id"), 3) != 1)
    return toxicity.keep_civil(docs, machine, threshold=TOXIC_AT)


@stage
def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeated lines of any length go, but for the first; n_chars follows the text.

    Rows that lose lines and keep no other than white space go too: nothing of them is unique.
    """
    out = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*docs.columns)


@stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 with five words and similarity 0.8: the row with the smallest doc_id of each group stays.

    Texts without words and rows without id are in no group and stay; of rows that share a doc_id
    that stays, all stay.
    """
    groups = ngram_join.ngram_jaccard_join(docs, width=5, percent=80)
    goes = shared.written(groups.where("doc_id <> component_id").select("doc_id").distinct())
    some = members(goes, "doc_id")  # most rows are surely none of these and need no shuffle
    doubtful = having(docs, "doc_id", some).join(goes, "doc_id", "left_anti").select(*docs.columns)
    return having(docs, "doc_id", some, others=True).unionAll(doubtful)


@stage
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that hold a benchmark item's question and answer go."""
    return decontam.without_leaks(docs, shared.table(spark, sf_dir, "benchmark"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the kept documents with their piece ids (merge-dropout 0.1)."""
    return merge_dropout.encode(docs)


STAGES = [
    ("toxicity", civil),
    ("line dedup", first_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding", encoded),
]

#: no SQL: models, MinHash families and merges have none; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES[:-1]):
        with shared.space():
            kept = shared.lasting(f.__wrapped__(spark, docs, sf_dir))
        if k:
            shared.forget(docs)
        docs = kept
    return encoded(spark, docs, sf_dir)
