"""Facet counts on bitmaps: one stored bitmap of documents for each facet's value, one bitmap of matching documents for each
relaxed field at request time; a count is an AND and a bit count.

A bitmap holds 32,768 documents by their numbers, 4 KB. The index is built once from the documents and has
(values in use) rows a 32,768 documents; it suits facets of some hundred values, as catalogues have.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Registry, Spec
from .counts import facet_values, tagged_value
from .flat import NUMBER, conditions, with_text

PART = "part"
_SCHEMA = "facet string, value string, count long"


def by_part(rows: DataFrame, wanted: Column) -> DataFrame:
    """Wanted rows dealt by their bitmap's number: a task then makes whole bitmaps, and what is shuffled are numbers, as many as
    rows. Bitmaps made before the shuffle would be one a task for every part: tasks times documents."""
    return rows.where(wanted).withColumn(PART, F.bitmap_bucket_number(NUMBER)).repartition(PART)


def facet_index(docs: DataFrame, registry: Registry, names: Iterable[str] | None = None) -> DataFrame:
    """(facet, value, part, docs) of numbered documents: the bitmap of those that have the value. Documents with a part are dealt already."""
    names = [f.name for f in registry.facets] if names is None else list(names)
    tagged = [F.transform(facet_values(registry.facet(n), registry), tagged_value(n)) for n in names]
    values = F.concat(*tagged).alias("f")
    of_part = docs.select(PART, NUMBER, values) if PART in docs.columns else by_part(docs.select(NUMBER, values), F.size("f") > 0)
    rows = of_part.select("part", NUMBER, F.explode("f").alias("f"))
    return rows.groupBy("f.facet", "f.value", "part").agg(F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias("docs"))


def matching_bitmaps(flat: DataFrame, spec: Spec, registry: Registry, relaxed: Iterable[str], docs: DataFrame | None = None) -> DataFrame:
    """(relaxed, part, docs): for each name the documents with a variant that meets all conditions but that field's; the empty
    name relaxes nothing. Conditions that every one of them keeps filter the scan; numbers of hits are shuffled."""
    relaxed = sorted(set(relaxed))
    every = conditions(spec, registry)
    always = [n for n in every if n not in relaxed]
    flat = reduce(DataFrame.where, [every.pop(n) for n in always], with_text(flat, spec, registry, docs))
    met = lambda name: reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for n, c in every.items() if n != name], F.lit(True))
    sets = F.array_compact(F.array(*[F.when(met(name), F.lit(name)) for name in relaxed]))
    rows = by_part(flat.select(NUMBER, sets.alias("sets")), F.size("sets") > 0).select("part", NUMBER, F.explode("sets").alias("relaxed"))
    return rows.groupBy("relaxed", "part").agg(F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias("docs"))


def facet_counts(index: DataFrame, flat: DataFrame, spec: Spec, registry: Registry, names: Iterable[str], docs: DataFrame | None = None, skip_text_only: bool = False) -> DataFrame:
    """(facet, value, count) as counts.facet_counts gives it, without a nested document. A text in the spec is looked for in docs."""
    names = list(names)
    if not names or (skip_text_only and spec.is_text_only()):
        return index.sparkSession.createDataFrame([], _SCHEMA)
    of = {n: registry.facet(n).relaxes if spec.get(registry.facet(n).relaxes) is not None else "" for n in names}
    if any(registry.field(r).kind == "text" for r in of.values() if r):
        raise ValueError("no facet relaxes the text")
    found = matching_bitmaps(flat, spec, registry, of.values(), docs).withColumnRenamed("docs", "found")
    relaxed = reduce(lambda c, n: c.when(F.col("facet") == n, F.lit(of[n])), names[1:], F.when(F.col("facet") == names[0], F.lit(of[names[0]])))
    both = index.where(F.col("facet").isin(*names)).withColumn("relaxed", relaxed).join(found, ["relaxed", "part"])
    both = both.select("facet", "value", "part", F.explode(F.array("docs", "found")).alias("bits")).groupBy("facet", "value", "part").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return both.groupBy("facet", "value").agg(F.sum("n").cast("long").alias("count")).where("count > 0")
