"""Text search over blocks of documents: a stored side table of trigrams names the blocks that can hold a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_folded
from ..plans.spec import Registry, Spec
from . import predicates

BLOCK = "block"
#: behind each text, so that every letter starts a trigram and shorter needles are the beginning of one
PAD = "\0\0"


def blocked(docs: DataFrame, blocks: int, *order: str) -> DataFrame:
    """docs in ranges of order with the range's number, to be written in folders by block. Documents with like texts
    belong in one range: it then holds few different trigrams."""
    return docs.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id()).sortWithinPartitions(*order)


def grams(text: Column) -> Column:
    """The different trigrams of a folded text, in one pass over it; null for null."""
    every = F.regexp_extract_all(F.concat(ascii_folded(text), F.lit(PAD)), F.lit("(?s)(?=(...))"), F.lit(1))
    return F.array_distinct(every)


def postings(table: DataFrame, parts: int) -> DataFrame:
    """(described, locale, gram, block), each once and sorted by gram: a request's trigrams reach few row groups. described
    tells texts of a locale from names and keywords. A frequent trigram spreads over the ranges by its blocks."""
    names = F.concat(F.array("manufacturer", "product"), F.coalesce("keywords", F.array().cast("array<string>")))
    described = F.transform("descriptions", lambda d: F.struct(F.lit(True).alias("described"), d["locale"].alias("locale"), d["text"].alias("text")))
    plain = F.transform(names, lambda t: F.struct(F.lit(False).alias("described"), F.lit(None).cast("string").alias("locale"), t.alias("text")))
    texts = table.select(BLOCK, F.explode(F.concat(F.coalesce(described, F.array().cast("array<struct<described:boolean,locale:string,text:string>>")), plain)).alias("t"))
    rows = texts.select("t.described", "t.locale", F.explode(grams(F.col("t.text"))).alias("gram"), BLOCK)
    return rows.distinct().repartitionByRange(parts, "gram", BLOCK).sortWithinPartitions("gram", BLOCK)


def blocks_with(index: DataFrame, needle: str, locale: str | None = None) -> DataFrame:
    """(block): every block that holds all trigrams of the needle in one kind and locale of texts, so every block with a
    match, and maybe others. Needles of one or two letters are beginnings of trigrams."""
    folded = needle.lower()
    if locale is not None:
        index = index.where(~F.col("described") | (F.col("locale") == locale))
    if len(folded) < 3:
        return index.where(F.col("gram").startswith(folded)).select(BLOCK).distinct()
    asked = sorted({folded[k : k + 3] for k in range(len(folded) - 2)})
    held = index.where(F.col("gram").isin(*asked)).groupBy("described", "locale", BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == len(asked)).select(BLOCK).distinct()


def matching(table: DataFrame, index: DataFrame, spec: Spec, registry: Registry) -> DataFrame:
    """As predicates.matching, over the blocks that can hold the spec's text; Spark prunes the other folders when it runs.
    The broadcast has a row a block at most. Without a text, or with an empty one, all blocks are read."""
    needle = spec.get("text")
    if needle:
        table = table.join(F.broadcast(blocks_with(index, needle, spec.get("locale"))), BLOCK, "left_semi")
    return predicates.matching(table, spec, registry).drop(BLOCK)


def pruning(table: DataFrame, index: DataFrame, needle: str, locale: str | None = None) -> DataFrame:
    """One row: blocks of the table, those that a request for the needle reads, and those it skips."""
    held = blocks_with(index, needle, locale).withColumn("held", F.lit(True)) if needle else table.select(BLOCK).distinct().withColumn("held", F.lit(True))
    seen = table.select(BLOCK).distinct().join(held, BLOCK, "left")
    return seen.agg(F.count(F.lit(1)).alias("blocks"), F.count("held").alias("read")).withColumn("skipped", F.col("blocks") - F.col("read"))
