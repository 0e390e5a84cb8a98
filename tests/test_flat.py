"""The stored variant table and facet bitmaps against the nested path."""

import random

import pytest
from catalogue_docs import doc, frame, variant
from pyspark.sql import functions as F

from prismfold.operators import bitmaps, counts, flat, search
from prismfold.operators.predicates import matching
from prismfold.plans import bridge, catalogue
from prismfold.plans.luminaires import LUMINAIRES as L
from prismfold.plans.spec import Spec
from prismfold.sources import store


def corpus(spark, n=60):
    rng = random.Random(4)
    docs = []
    for k in range(n):
        variants = [
            variant(i, rng.choice([None, 1000.0, 2000.0, 3000.0]), 10.0, rng.choice([3000, 4000, 5000]), mounting_type=rng.choice(["Recessed", "Pendant"]), recessed_depth_mm=rng.choice([None, 10, 60]), has_3d=rng.random() < 0.3, lamp_type=rng.choice([None, 1, 2]), control_gear_interfaces=rng.sample([1, 2, 3], rng.randint(0, 2)), has_emergency_lighting=rng.random() < 0.3, emergency_lighting_type=rng.choice([None, 1, 2]))
            for i in range(rng.randint(0, 4))
        ]
        docs.append(doc(f"d{k}", rng.choice(["Acme", "Beta", ""]), rng.choice(["Bay", "Spot"]), variants=variants, ip_code=rng.choice([None, 1, 2]), labels=rng.sample([0, 1], rng.randint(0, 2)), applications=rng.sample([5, 6, 7], rng.randint(0, 3)), safety_class=rng.choice([None, 1]), ik_rating=rng.choice([None, 8]), product_form=rng.choice([1, 2]), adjustability=rng.choice([[], [3]])))
    return flat.numbered(frame(spark, *docs), L, shards=5).cache()


SPECS = [
    {}, {"manufacturer": ["Acme"]}, {"flux": (900.0, 2100.0)}, {"flux": (900.0, 2100.0), "cct": (3500, 6000), "manufacturer": ["Acme", "Beta"]}, {"recessed_depth": (0, 20)}, {"has_3d": True, "flux": (900.0, 1100.0)}, {"has_photometry": False}, {"control_gear": [1, 3], "cri_min": 80}, {"applications": [5], "ip_code": [1]},
    {"text": "bay", "lamp_type": [1]}, {"has_emergency": True, "emergency_type": [2], "mounting_type": ["Recessed"]}, {"manufacturer": ["Nobody"]},
]


def test_flat_equals_nested(spark):
    docs = corpus(spark)
    table, index = flat.flat_table(docs, L).cache(), bitmaps.facet_index(docs, L).cache()
    assert docs.select(flat.NUMBER).distinct().count() == docs.count() == docs.where("doc_no between 1 and 5 * 60").count()
    names, axes = [f.name for f in L.facets], ["flux", "cct", "recessed_depth"]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for values in SPECS:
        spec = Spec.of(**values)
        assert rows(flat.search(table, spec, L, docs)) == rows(search.search(docs, spec, L)), values
        found = flat.matching(table, spec, L, docs)
        assert rows(found.select("doc_id")) == rows(matching(docs, spec, L).select("doc_id")), values
        assert rows(flat.documents_of(docs, found).select("doc_id")) == rows(found.select("doc_id"))
        assert rows(bitmaps.facet_counts(index, table, spec, L, names, docs)) == rows(counts.facet_counts(docs, spec, L, names)), values
        assert flat.range_bounds(table, spec, L, axes, docs).first() == counts.range_bounds(docs, spec, L, axes).first(), values
    assert bitmaps.facet_counts(index, table, Spec.of(text="x"), L, names, skip_text_only=True).count() == 0
    with pytest.raises(ValueError):
        flat.search(table, Spec.of(text="x"), L)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "3000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_stored_table(spark, sf):
    """The scan gets variant conditions and reads their columns only; nothing is shuffled but hits."""
    got = plan(catalogue.queries()["q_search_doc_variant"](spark, sf))
    for part in ("In(d_o_orderpriority, [1-URGENT,2-HIGH])", "GreaterThanOrEqual(v_l_quantity,10.0)", "LessThanOrEqual(v_l_quantity,20.0)", "v_l_linestatus"):
        assert part in got, part
    assert "Exchange" not in got and "v_l_tax" not in got and "variants" not in got
    facets = plan(catalogue.queries()["q_facets_onepass"](spark, sf))
    assert "variants" not in facets and "collect_list" not in facets and "GreaterThanOrEqual(v_l_quantity,5.0)" in facets


def test_row_groups_are_pruned(spark, sf, tmp_path):
    """Clustered by a filter column, a request reads part of the rows."""
    docs, lines, _ = bridge.stored_orders(spark, sf)
    where = str(tmp_path / "c")
    flat.clustered(lines, "v_l_quantity", parts=8).write.parquet(where)
    spans = spark.read.parquet(where).groupBy(F.input_file_name().alias("f")).agg(F.min("v_l_quantity").alias("lo"), F.max("v_l_quantity").alias("hi")).collect()
    assert len(spans) == 8 and sum(s.lo <= 10 and s.hi >= 10 for s in spans) <= 2
    assert docs.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_store_follows_its_inputs(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id + 1 as x")

    spark.range(3).write.parquet(source)
    assert store.stored(spark, "t", [source], build).count() == 3 == store.stored(spark, "t", [source], build).count() and len(calls) == 1
    spark.range(3, 8).write.mode("append").parquet(source)
    assert store.stored(spark, "t", [source], build).count() == 8 and len(calls) == 2


def test_article_index_reads_few_files(spark, tmp_path):
    """Look-ups in the stored key index read the folders of their range; results are those of the whole table."""
    rows = [(k, f"Art-{k * 7919 % 3000:04d}") for k in range(3000)] + [(9000 + k, "SAME 1") for k in range(50)] + [(9999, "Ünï 77")]
    table = search.articles(spark.createDataFrame(rows, "doc_id long, gtin string"), "gtin")
    where = str(tmp_path / "ix")
    search.article_index(table, 12).write.partitionBy(search.SPAN).parquet(where)
    index = spark.read.parquet(where)
    bounds = search.article_bounds(index).cache()
    assert bounds.count() == 12

    def files_read(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        return max(x.metrics().apply("numFiles").value() for x in scans if x.nodeName().startswith("Scan parquet")) if any(x.nodeName().startswith("Scan parquet") for x in scans) else 0

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for text in ("art 0042", "same-1", "ÜNÏ77", "nowhere", ""):
            found = search.lookup_indexed(index, bounds, text)
            assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in search.lookup_article(table, text).collect()), text
            assert files_read(found) <= 2, text
        for prefix in ("art004", "ART-1", "sam", "ünï", "ar"):
            got = search.suggest_indexed(index, bounds, prefix, "doc_id", limit=20)
            assert [tuple(r) for r in got.select("key", "doc_id").collect()] == [tuple(r) for r in search.suggest_articles(table, prefix, "doc_id", limit=20).select("key", "doc_id").collect()], prefix
        assert files_read(search.suggest_indexed(index, bounds, "art004", "doc_id")) <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
