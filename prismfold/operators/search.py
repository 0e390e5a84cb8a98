"""Variant-grain search, paging, totals and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_key, ascii_folded, described, slug
from ..plans.spec import Registry, Spec
from .predicates import at, in_scope, variant_scope

DEFAULT_LIMIT = 50
SUGGEST_ARTICLES, SUGGEST_ARTICLES_MOST = 20, 50


def search(docs: DataFrame, spec: Spec, registry: Registry, *keep: str) -> DataFrame:
    """(doc_id, variant_ix): every matching variant of documents in scope; all variants if none is asked for."""
    hits = in_scope(docs, spec, registry).select(registry.doc_id, *keep, F.posexplode(registry.variants).alias("variant_ix", "v"))
    if spec.has_variant_predicate(registry):
        hits = hits.where(variant_scope(spec, registry)(F.col("v")))
    return hits.select(registry.doc_id, *keep, "variant_ix")


def page(hits: DataFrame, *order: str | Column, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return hits.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def corpus_stats(docs: DataFrame, registry: Registry) -> DataFrame:
    """One row: documents and variants."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size(registry.variants)), F.lit(0)).cast("long").alias("variants"))


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total"))


#: ids of one request that are pushed to the scan as a list; more are joined
PUSHED_IDS = 1000


def _of_ids(docs: DataFrame, doc_id: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """docs without most that a small request cannot mean: the ids of a request (a few rows by nature) as a filter."""
    few = ids.select(id_col).limit(PUSHED_IDS + 1).collect()
    known = {r[0] for r in few if r[0] is not None}
    return docs if len(few) > PUSHED_IDS else docs.where(F.col(doc_id).isin(*sorted(known))) if known else docs.limit(0)


def _of_tenant(docs: DataFrame, tenant: str | None) -> DataFrame:
    """A tenant sees its own documents only, whatever the case of A to Z."""
    return docs if tenant is None else docs.where(ascii_folded(F.col("manufacturer")) == ascii_folded(F.lit(tenant)))


def documents_by_id(docs: DataFrame, ids: DataFrame, aliases: DataFrame | None = None, doc_id: str = "doc_id", tenant: str | None = None) -> DataFrame:
    """ids has pos and id: documents in that order, unknown ids dropped, repeats kept, aliases followed to families."""
    docs = _of_tenant(docs, tenant)
    wanted = ids.select("pos", F.col("id").alias("__id"))
    if aliases is not None:
        wanted = wanted.join(aliases.select(F.col("source_id").alias("__id"), "family_id"), "__id", "left").select("pos", F.coalesce("family_id", "__id").alias("__id"))
    return wanted.join(_of_ids(docs, doc_id, wanted, "__id"), F.col("__id") == F.col(doc_id)).drop("__id").orderBy("pos")


def variants_by_id(docs: DataFrame, refs: DataFrame, registry: Registry, tenant: str | None = None) -> DataFrame:
    """refs has pos, id and ix: one row per reference with its variant v, those out of range dropped, in order."""
    docs = _of_ids(_of_tenant(docs, tenant), registry.doc_id, refs)
    found = refs.select("pos", F.col("id").alias("__id"), "ix").join(docs, F.col("__id") == F.col(registry.doc_id)).drop("__id")
    return found.where((F.col("ix") >= 0) & (F.col("ix") < F.size(registry.variants))).withColumn("v", F.element_at(registry.variants, F.col("ix") + 1)).orderBy("pos")


def _sku() -> Column:
    return F.coalesce(F.when(F.col("product_code") != "", F.col("product_code")), F.col("gtin"))


def coded_names(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """df with the ids of some columns replaced by names; each dictionary is a small closed table (id, name), unknown ids give null."""
    for column, table in dictionaries.items():
        coded = table.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
        df = df.join(F.broadcast(coded), F.col(column) == F.col("__id"), "left").withColumn(column, F.col("__name")).drop("__id", "__name")
    return df


def slim(found: DataFrame, *keep: str) -> DataFrame:
    """The row that result lists show of a found variant (column v, as variants_by_id gives it): sku, names, the main
    figures, the mounting in one text (null where neither part is known), the English snippet, flags. keep names further columns."""
    v = F.col("v")
    cut, truncated = described(F.col("descriptions"))
    unknown = (v["mounting_place"] == "Unknown") & (v["mounting_type"] == "Unknown")
    figures = [v["photometry"][n].alias(n) for n in ("flux_lm", "power_w", "efficacy_lm_w", "cct_k", "cri_ra")]
    mounting = F.when(~unknown, F.concat(v["mounting_place"], F.lit(" · "), v["mounting_type"]))
    return found.select("doc_id", "manufacturer", "product", _sku().alias("sku"), v["name"].alias("variant"), *figures, mounting.alias("mounting"), cut.alias("snippet"), truncated.alias("truncated"), v["has_3d"].alias("has_3d"), v["photometry"].isNotNull().alias("has_photometry"), *keep)


def hit_rows(docs: DataFrame) -> DataFrame:
    """One row a document: sku, sorted keywords, and a line of the rounded figures of the first variant with photometry, unknown ones left out."""
    first = F.try_element_at(F.filter("variants", lambda v: v["photometry"].isNotNull()), F.lit(1))["photometry"]
    figure = lambda name, unit: F.concat(F.round(first[name]).cast("long").cast("string"), F.lit(unit))
    line = F.concat_ws(" · ", figure("flux_lm", " lm"), figure("power_w", " W"), figure("cct_k", " K"))
    return docs.select("doc_id", "manufacturer", "product", _sku().alias("sku"), F.array_sort("keywords").alias("keywords"), line.alias("figures"))


def source_of_variant(docs: DataFrame) -> DataFrame:
    """Each variant's own source: that of its family member, else the document's."""
    v = docs.select("doc_id", "source", "source_paths", F.posexplode("variants").alias("variant_ix", "v"))
    return v.select("doc_id", "variant_ix", F.coalesce(F.try_element_at("source_paths", F.col("v.source_index") + 1), F.col("source")).alias("source"))


def articles(docs: DataFrame, *columns: str, keep: tuple[str, ...] = (), doc_id: str = "doc_id") -> DataFrame:
    """The side table of identifiers: key (normalised), original, doc_id; sorted by key for prefix ranges."""
    rows = docs.select(doc_id, *keep, F.explode(F.array(*columns)).alias("original")).withColumn("key", article_key(F.col("original")))
    return rows.where("key <> ''").dropDuplicates(["key", "original", doc_id])


def lookup_article(table: DataFrame, text: str, doc_id: str = "doc_id", tenant: str | None = None) -> DataFrame:
    """Documents with the identifier in any spelling; none for a text without letters or digits. A tenant needs the column manufacturer (keep)."""
    return _of_tenant(table, tenant).where((F.col("key") == article_key(F.lit(text))) & (F.col("key") != "")).dropDuplicates(["key", doc_id])


def suggest_articles(table: DataFrame, prefix: str, *order: str, limit: int = SUGGEST_ARTICLES, tenant: str | None = None) -> DataFrame:
    """Identifiers by normalised prefix of three bytes or more, in key order."""
    table = _of_tenant(table, tenant)
    key = "".join(c for c in prefix if c.isalnum()).lower()
    if len(key.encode()) < 3:
        return table.limit(0)
    return table.where(F.col("key").startswith(key)).orderBy("key", *order).limit(min(limit, SUGGEST_ARTICLES_MOST))


SPAN = "span"


def article_index(table: DataFrame, parts: int) -> DataFrame:
    """The side table in ranges of its keys, sorted, with the range's number; to be written in folders by span (article_bounds
    has each one's first and last key). Equal keys are told apart by originals, so no range grows with a key."""
    order = ["key", "original"]
    return table.repartitionByRange(parts, *order).withColumn(SPAN, F.spark_partition_id()).sortWithinPartitions(*order)


def article_bounds(index: DataFrame) -> DataFrame:
    """(span, low, high): one row a range."""
    return index.groupBy(SPAN).agg(F.min("key").alias("low"), F.max("key").alias("high"))


def _within(index: DataFrame, bounds: DataFrame, low: Column, high: Column) -> DataFrame:
    """The ranges that can hold keys from low to high; Spark prunes the other folders when it runs."""
    spans = bounds.where((F.col("high") >= low) & (F.col("low") <= high)).select(SPAN)
    return index.join(F.broadcast(spans), SPAN).drop(SPAN)


def lookup_indexed(index: DataFrame, bounds: DataFrame, text: str, doc_id: str = "doc_id", tenant: str | None = None) -> DataFrame:
    """As lookup_article, from the ranges that can hold the key."""
    key = article_key(F.lit(text))
    return lookup_article(_within(index, bounds, key, key), text, doc_id, tenant)


def suggest_indexed(index: DataFrame, bounds: DataFrame, prefix: str, *order: str, limit: int = SUGGEST_ARTICLES, tenant: str | None = None) -> DataFrame:
    """As suggest_articles, from the ranges that can hold keys with the prefix."""
    low = "".join(c for c in prefix if c.isalnum()).lower()
    return suggest_articles(_within(index, bounds, F.lit(low), F.lit(low + chr(0x10FFFF))), prefix, *order, limit=limit, tenant=tenant)


#: names that a slug rule cannot reach (fixed values)
SLUG_NAMES = {"als": "A.L.S.", "a-l-s": "A.L.S.", "nobile": "nobilé"}


def resolve_slug(names: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """names has name and ord: the canonical name of a slug, by the first document where any rule holds.

    Rules: the slug is the folded name, its first word, or a fixed one of the name. strict prefers whole
    matches over the other rules, wherever they stand.
    """
    needle = text.strip().lower()
    want = " ".join(needle.replace("-", " ").replace("_", " ").split())
    if not want:
        return names.select("name").limit(0)
    folded = slug(F.col("name"))
    whole = folded == want
    first = slug(F.element_at(F.split(F.trim("name"), r"\s+"), 1)) == want
    fixed = F.col("name") == F.lit(SLUG_NAMES.get(needle, "\0"))
    ranked = names.where(whole | first | fixed).withColumn("tier", F.when(whole, 0).otherwise(1))
    return ranked.orderBy(*(["tier"] if strict else []), "ord").limit(1).select("name")
