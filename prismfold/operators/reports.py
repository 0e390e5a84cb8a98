"""Corpus reports: repeats, sizes, manufacturers, top lists, intake summaries, archive contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, **columns: Column) -> DataFrame:
    """One row: for each named column its occurrences, distinct values and the reduction in percent."""
    out = []
    for name, c in columns.items():
        n, d = F.count(c), F.count_distinct(c)
        out += [n.alias(f"{name}_n"), d.alias(f"{name}_distinct"), (100 * (n - d) / F.greatest(n, F.lit(1))).alias(f"{name}_reduction")]
    return df.agg(*out)


def field_sizes(df: DataFrame, **columns: Column) -> DataFrame:
    """One row: logical bytes of each column in sum, and on the average of all rows."""
    out = []
    for name, c in columns.items():
        size = F.coalesce(F.octet_length(c), F.lit(0))
        out += [F.sum(size).alias(f"{name}_bytes"), F.avg(size).alias(f"{name}_avg")]
    return df.agg(F.count(F.lit(1)).alias("n"), *out)


def manufacturers(df: DataFrame, column: str) -> DataFrame:
    """Names by count and name, with the slug of the first word and the number of distinct names."""
    counts = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("n_names"))
    first = F.lower(F.element_at(F.split("name", " "), 1))
    return counts.withColumn("slug", first).crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "name")


def top_values(df: DataFrame, *columns: str, limit: int) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(limit)


def top_per_facet(counts: DataFrame, shown: int = 10) -> DataFrame:
    """The first values of each facet with the number of values not shown."""
    from pyspark.sql import Window

    w = Window.partitionBy("facet").orderBy(F.desc("count"), "value")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("n_values", F.count(F.lit(1)).over(Window.partitionBy("facet")))
    return ranked.where(F.col("rank") <= shown).select("facet", "value", "count", "rank", F.greatest(F.col("n_values") - shown, F.lit(0)).alias("remainder"))


def largest_files(listing: DataFrame, limit: int) -> DataFrame:
    return listing.orderBy(F.desc("length"), "path").limit(limit)


def intake_summary(docs: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """Files, failures, variants, share with photometry, documents with applications, warnings."""
    has = F.aggregate(F.transform("variants", lambda v: v["photometry"].isNotNull().cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    body = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("variants")), F.lit(0)).alias("variants"), F.coalesce(F.sum(has), F.lit(0)).alias("with_photometry"), F.coalesce(F.sum((F.size("applications") > 0).cast("long")), F.lit(0)).alias("with_applications"))
    return body.crossJoin(errors.agg(F.count(F.lit(1)).alias("failures"))).crossJoin(warnings.agg(F.count(F.lit(1)).alias("warnings"))).withColumn("photometry_percent", 100 * F.col("with_photometry") / F.greatest("variants", F.lit(1)))


def intake_by_manufacturer(docs: DataFrame) -> DataFrame:
    """One row a manufacturer, most documents first: documents, variants, how many of them have photometry and their percentage,
    documents with applications, warnings, and the slug of the name's first word. Partial sums only; files that failed have no manufacturer."""
    has = F.size(F.filter("variants", lambda v: v["photometry"].isNotNull()))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    sums = docs.groupBy("manufacturer").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(size("variants")).cast("long").alias("variants"), F.sum(F.greatest(has, F.lit(0))).cast("long").alias("with_photometry"), F.count_if(size("applications") > 0).alias("with_applications"), F.sum(size("warnings")).cast("long").alias("warnings")
    )
    slug = F.lower(F.coalesce(F.try_element_at(F.split(F.trim("manufacturer"), r"\s+"), F.lit(1)), F.lit("")))
    return sums.select("manufacturer", slug.alias("slug"), "docs", "variants", "with_photometry", (100 * F.col("with_photometry") / F.greatest("variants", F.lit(1))).alias("photometry_percent"), "with_applications", "warnings").orderBy(F.desc("docs"), "manufacturer")


def warning_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("warnings").alias("w")).groupBy(F.col("w.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def archive_categories(entries: DataFrame) -> DataFrame:
    """entries has name, size, packed: bytes by kind of entry, with ratios."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("ldt", "ies", "eul"), "photometry").when(ext.isin("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"), "image").when(ext.isin("l3d", "obj", "gltf", "glb", "stl", "3ds", "m3d", "r3d"), "geometry").when(ext == "xml", "xml").when(ext.isin("pdf", "txt", "md", "html", "htm"), "document").otherwise("other")
    sums = entries.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("packed").alias("packed"))
    return sums.withColumn("ratio", F.col("packed") / F.greatest("bytes", F.lit(1)))


def projected(categories: DataFrame, sampled: int, files: int) -> DataFrame:
    """Categories with their bytes projected from the sampled archives to a corpus of so many files."""
    scale = F.lit(files / max(1, sampled))
    return categories.withColumn("projected_bytes", F.round(F.col("bytes") * scale).cast("long")).withColumn("projected_packed", F.round(F.col("packed") * scale).cast("long"))


def variant_sizes(docs: DataFrame) -> DataFrame:
    """One row: documents, variants, the share of variants with photometry and variants a document."""
    has = F.size(F.filter("variants", lambda v: v["photometry"].isNotNull()))
    sums = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("variants")), F.lit(0)).cast("long").alias("variants"), F.coalesce(F.sum(has), F.lit(0)).cast("long").alias("with_photometry"))
    return sums.withColumn("photometry_share", F.col("with_photometry") / F.greatest("variants", F.lit(1))).withColumn("variants_a_doc", F.col("variants") / F.greatest("docs", F.lit(1)))
