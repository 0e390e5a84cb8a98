"""Families: documents with the same manufacturer and product become one, all variants kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNION = ("applications", "labels", "adjustability", "keywords", "descriptions")
FIRST = ("ip_code", "safety_class", "ik_rating", "product_form", "gtin", "product_code")


def family_id(manufacturer: Column, product: Column) -> Column:
    """Null keys count as empty texts."""
    return F.sha2(F.concat(F.lit("family:"), F.coalesce(manufacturer, F.lit("")), F.lit(":"), F.coalesce(product, F.lit(""))), 256)


def fold(docs: DataFrame, id_col: str = "doc_id", keys: tuple[str, str] = ("manufacturer", "product"), union: tuple[str, ...] = UNION, first: tuple[str, ...] = FIRST, variants: str | None = "variants", meta: str | None = "file_meta", source: str | None = "source", nameless: bool = True) -> DataFrame:
    """One row per exact key pair; rows of a family are taken in the order of their ids.

    A document alone in its family passes unchanged (source_paths filled if empty). Sets are sorted distinct
    unions, scalars the first non-null, sizes add up, the latest time counts; variants are concatenated,
    numbered from 0 and carry their member's place. members lists the source ids. A family is one row, made in one
    task: where many documents have neither key, nameless=False leaves each of those by itself.
    """
    alone = F.col("n") == 1
    own = [c for c in docs.columns if c not in keys]
    member = F.struct(F.col(id_col).alias("id"), F.struct(*own).alias("d"))
    blank = F.lit(True)
    for k in keys:
        blank = blank & (F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "")
    apart = [] if nameless else [F.when(blank, F.col(id_col)).alias("__apart")]
    g = docs.groupBy(*keys, *apart).agg(F.array_sort(F.collect_list(member)).alias("m"), F.count(F.lit(1)).alias("n"))
    each = lambda name: F.transform("m", lambda x: x["d"][name])
    single = lambda name: F.element_at("m", 1)["d"][name]
    out = [F.when(alone, single(id_col)).otherwise(family_id(*(F.col(k).cast("string") for k in keys))).alias(id_col), *keys]
    for name in own:
        if name == id_col:
            continue
        if name in union:
            merged = F.array_sort(F.array_distinct(F.flatten(F.array_compact(each(name)))))
        elif name in first:
            merged = F.try_element_at(F.array_compact(each(name)), F.lit(1))
        elif name == variants:
            placed = F.flatten(F.transform("m", lambda x, i: F.transform(x["d"][variants], lambda v: v.withField("source_index", i.cast("int")))))
            merged = F.transform(placed, lambda v, i: v.withField("id", i.cast("int")))
        elif name == meta:
            metas = F.array_compact(each(name))
            total = F.aggregate(F.array_compact(F.transform(metas, lambda x: x["size_bytes"])), F.lit(0).cast("long"), lambda a, x: a + x)
            version = F.try_element_at(F.array_compact(F.transform(metas, lambda x: x["format_version"])), F.lit(1))
            merged = F.struct(total.alias("size_bytes"), F.array_max(F.transform(metas, lambda x: x["mtime_epoch_s"])).alias("mtime_epoch_s"), version.alias("format_version"))
        elif name == "source_paths" and source:
            paths = each(source)
            out.append(F.when(alone & (F.size(single(name)) > 0), single(name)).otherwise(paths).alias(name))
            continue
        else:
            merged = single(name)
        out.append(F.when(alone, single(name)).otherwise(merged).alias(name))
    return g.select(*out, F.transform("m", lambda x: x["id"]).alias("members"))


def aliases(folded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(source_id, family_id): every member, singletons to themselves; the smallest family of a repeated source id."""
    return folded.select(F.explode("members").alias("source_id"), F.col(id_col).alias("family_id")).groupBy("source_id").agg(F.min("family_id").alias("family_id"))


def fold_stats(docs: DataFrame, folded: DataFrame, variants: str = "variants") -> DataFrame:
    count = lambda df, tag: df.agg(F.count(F.lit(1)).alias(f"docs_{tag}"), F.coalesce(F.sum(F.size(variants)), F.lit(0)).alias(f"variants_{tag}"))
    return count(docs, "in").crossJoin(count(folded, "out")).crossJoin(folded.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("aliases")))


# Families of any size: the same result as three flat tables, with no row or task that grows with a family's members.

MEMBER, OFFSET = "member_ix", "variant_offset"


def placed(docs: DataFrame, parts: int, id_col: str = "doc_id", keys: tuple[str, str] = ("manufacturer", "product")) -> DataFrame:
    """docs in ranges of (keys, id) with the range's number as column part. To be stored (store.stored): the tables below read it
    several times and need the same ranges. A family with most of the documents lies in many ranges. Null keys become empty texts."""
    docs = docs.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    order = [*keys, id_col]
    return docs.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)


def members(stored: DataFrame, id_col: str = "doc_id", keys: tuple[str, str] = ("manufacturer", "product"), variants: str | None = "variants") -> DataFrame:
    """The placed documents with their family's id and size, their place in it and the number of variants before theirs.

    Places come in two steps: totals of each range of a family (a few rows), summed over its ranges, and a running sum
    inside each range.
    """
    size = F.coalesce(F.size(variants), F.lit(0)) if variants else F.lit(0)
    rows = stored.withColumn("__size", F.greatest(size, F.lit(0)).cast("long"))
    totals = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__v"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "part", F.sum("__n").over(whole).alias("family_size"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__v0"))
    inside = Window.partitionBy(*keys, "part").orderBy(id_col)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__rank", F.row_number().over(inside) - 1).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    # ranges and totals meet by null-safe keys; a range has one row of totals a family
    totals = totals.toDF(*[f"__{k}" for k in keys], "__part", *totals.columns[len(keys) + 1 :])
    same = F.col("part") == F.col("__part")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    out = rows.join(totals, same).drop("__part", *[f"__{k}" for k in keys])
    single = F.col("family_size") == 1
    return out.select(
        "*", F.when(single, F.col(id_col).cast("string")).otherwise(family_id(*(F.col(k).cast("string") for k in keys))).alias("family_id"), (F.col("__n0") + F.col("__rank")).alias(MEMBER), (F.col("__v0") + F.col("__before")).alias(OFFSET)
    ).drop("__size", "__n0", "__v0", "__rank", "__before")


def family_variants(of_members: DataFrame, variants: str = "variants") -> DataFrame:
    """(family_id, id, source_index, v): a family's variants numbered from 0 by a running offset; those of a document
    alone in its family keep their own numbers."""
    rows = of_members.select("family_id", "family_size", MEMBER, OFFSET, F.posexplode(variants).alias("__ix", "v"))
    single = F.col("family_size") == 1
    fields = [f.name for f in of_members.schema[variants].dataType.elementType.fields]
    own = lambda name, other: F.when(single, F.col("v")[name]).otherwise(other) if name in fields else other
    return rows.select("family_id", own("id", F.col(OFFSET) + F.col("__ix")).cast("long").alias("id"), own("source_index", F.col(MEMBER)).cast("long").alias("source_index"), "v")


def families(of_members: DataFrame, id_col: str = "doc_id", keys: tuple[str, str] = ("manufacturer", "product"), union: tuple[str, ...] = UNION, first: tuple[str, ...] = FIRST, variants: str | None = "variants", meta: str | None = "file_meta") -> DataFrame:
    """One row a family: id, keys, members, variants, sorted unions of sets, first scalars by id, sums of sizes.

    Scalars, sums and times are partial aggregates, merged a task at a time before the shuffle. Values of sets are made
    distinct by (family, value) first, so a family's set is gathered from its different values, not from its members.
    """
    at = lambda value: F.min(F.when(value.isNotNull(), F.struct(F.col(MEMBER).alias("__at"), value.alias("x"))))["x"]
    out = [F.count(F.lit(1)).alias("n_members")]
    if variants:
        out.append(F.sum(F.greatest(F.coalesce(F.size(variants), F.lit(0)), F.lit(0))).cast("long").alias("n_variants"))
    out += [at(F.col(c)).alias(c) for c in first if c in of_members.columns]
    if meta and meta in of_members.columns:
        m = F.col(meta)
        out.append(F.struct(F.coalesce(F.sum(m["size_bytes"]), F.lit(0)).cast("long").alias("size_bytes"), F.max(m["mtime_epoch_s"]).alias("mtime_epoch_s"), at(m["format_version"]).alias("format_version")).alias(meta))
    rest = [c for c in of_members.columns if c not in {*keys, *union, *first, variants, meta, id_col, "part", "family_id", "family_size", MEMBER, OFFSET, "source", "source_paths"}]
    out += [F.min_by(c, MEMBER).alias(c) for c in rest]
    head = of_members.groupBy("family_id", *keys).agg(*out)
    for c in (u for u in union if u in of_members.columns):
        values = of_members.select("family_id", F.explode(c).alias("x")).distinct()
        head = head.join(values.groupBy("family_id").agg(F.array_sort(F.collect_list("x")).alias(c)), "family_id", "left")
        head = head.withColumn(c, F.coalesce(c, F.array().cast(of_members.schema[c].dataType)))
    return head
