"""Facet counts that relax the counted field, numeric bounds, suggestions: one scan each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Facet, Registry, Spec
from .predicates import at, doc_scope, document_matches, variant_scope

UNSPECIFIED = "(unspecified)"
SUGGEST, SUGGEST_MOST = 10, 30


def facet_values(facet: Facet, registry: Registry) -> Column:
    """A document's distinct values of a facet, as strings: over all its variants, not only matching ones."""
    variants = F.col(registry.variants)
    if facet.source == "doc":
        x = F.col(facet.path).cast("string")
        return F.when(x.isNotNull() & (x != ""), F.array(x)).otherwise(F.array().cast("array<string>"))
    if facet.source == "doc_array":
        values = F.col(facet.path).cast("array<string>")
    elif facet.source == "variant":
        values = F.transform(variants, lambda v: at(v, facet.path).cast("string"))
    elif facet.source == "variant_array":
        values = F.flatten(F.transform(variants, lambda v: F.coalesce(at(v, facet.path).cast("array<string>"), F.array().cast("array<string>"))))
    elif facet.source == "presence":
        is_flag = next(f for f in registry.fields if f.name == facet.relaxes)
        has = (lambda v: at(v, facet.path).isNotNull()) if is_flag.present else (lambda v: F.coalesce(at(v, facet.path), F.lit(False)))
        values = F.array(F.when(F.exists(variants, has), F.lit("present")), F.when(F.exists(variants, lambda v: ~has(v)), F.lit("missing")))
    else:
        values = F.transform(variants, lambda v: F.coalesce(at(v, facet.path).cast("string"), F.when(at(v, facet.flag), F.lit(UNSPECIFIED))))
    return F.coalesce(F.array_distinct(F.array_compact(values)), F.array().cast("array<string>"))


def tagged_value(name: str):
    return lambda x: F.struct(F.lit(name).alias("facet"), x.alias("value"))


def facet_counts(docs: DataFrame, spec: Spec, registry: Registry, names: Iterable[str], skip_text_only: bool = False) -> DataFrame:
    """(facet, value, count) by documents: each facet with its own field cleared. All facets share one scan and one shuffle."""
    names = list(names)
    if not names or (skip_text_only and spec.is_text_only()):
        return docs.sparkSession.createDataFrame([], "facet string, value string, count long")
    parts = []
    for name in names:
        f = registry.facet(name)
        mask = document_matches(spec.without(f.relaxes), registry)
        parts.append(F.when(mask, F.transform(facet_values(f, registry), tagged_value(name))))
    every = F.flatten(F.array_compact(F.array(*parts)))
    return docs.select(F.explode(every).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("count"))


def facet_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy("facet", F.desc("count"), "value")


def range_bounds(docs: DataFrame, spec: Spec, registry: Registry, axes: Iterable[str]) -> DataFrame:
    """One row of <axis>_min and <axis>_max: each axis with its own condition cleared, over finite values of matching variants."""
    flat = docs.select("*", F.explode(registry.variants).alias("v"))
    out = []
    for name in axes:
        f = registry.field(name)
        relaxed = spec.without(name)
        x = at(F.col("v"), f.path)
        mask = doc_scope(relaxed, registry) & variant_scope(relaxed, registry)(F.col("v"))
        if f.type in ("float", "double"):
            mask &= ~F.isnan(x) & (F.abs(x) < float("inf"))
        if f.gate:
            mask &= at(F.col("v"), f.gate[0]) == F.lit(f.gate[1])
        out += [F.min(F.when(mask, x)).alias(f"{name}_min"), F.max(F.when(mask, x)).alias(f"{name}_max")]
    return flat.agg(*out)


def with_names(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Counts of coded facets by name. dictionary has facet, id and name (a closed table of a few hundred rows): ids that
    it lacks drop out, facets that it does not know stay as they are, counts of ids of one name add up."""
    names = dictionary.select(F.col("facet").alias("__facet"), F.col("id").cast("string").alias("__id"), F.col("name").alias("__name"))
    coded = names.select(F.col("__facet").alias("__coded")).distinct()
    out = counts.join(F.broadcast(names), (F.col("facet") == F.col("__facet")) & (F.col("value") == F.col("__id")), "left")
    out = out.join(F.broadcast(coded), F.col("facet") == F.col("__coded"), "left").where(F.col("__coded").isNull() | F.col("__name").isNotNull() | (F.col("value") == UNSPECIFIED))
    return out.groupBy("facet", F.coalesce("__name", "value").alias("value")).agg(F.sum("count").alias("count"))


def suggestion_table(docs: DataFrame, registry: Registry, names: Iterable[str], dictionary: DataFrame | None = None) -> DataFrame:
    """Unfiltered counts of the facets that suggestions draw from, coded ones by name."""
    counts = facet_counts(docs, Spec(), registry, names)
    return (counts if dictionary is None else with_names(counts, dictionary)).withColumn("folded", F.lower("value"))


def suggest_facets(table: DataFrame, prefix: str, limit: int = SUGGEST, tenant: str | None = None) -> DataFrame:
    """Values that start with the text, then values that hold it, each by count; a tenant's filter comes after the limit."""
    want = prefix.strip().lower()
    if len(want.encode()) < 2 or limit <= 0:
        return table.select("facet", "value", "count").limit(0)
    found = table.where(F.col("folded").contains(want)).withColumn("tier", F.when(F.col("folded").startswith(want), 0).otherwise(1))
    top = found.orderBy("tier", F.desc("count"), "value", "facet").limit(min(limit, SUGGEST_MOST)).select("facet", "value", "count")
    return top if tenant is None else top.where((F.col("facet") != "manufacturer") | (F.lower("value") == tenant.lower()))


def application_rollup(counts: DataFrame, top: str, mid: str, leaf: str, seen: str | None = None) -> DataFrame:
    """Leaf counts summed to mid and top levels; a document with several leaves counts in each. seen is a column with the
    leaves' places: each node then has its first one (column seen), and rows come in that order, parents before their children."""
    if seen is None:
        return counts.rollup(top, mid, leaf).agg(F.sum("count").alias("count"))
    out = counts.rollup(top, mid, leaf).agg(F.sum("count").alias("count"), F.min(seen).alias("seen"), F.grouping_id().alias("__level"))
    return out.orderBy("seen", F.desc("__level")).drop("__level")
