from functools import reduce

import pytest
from catalogue_docs import SAMPLE, doc, frame, photometry, variant
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfold.operators import counts, search
from prismfold.operators.predicates import document_matches
from prismfold.plans.luminaires import LUMINAIRES as L
from prismfold.plans.spec import Spec


def naive_facet_counts(docs, spec, names):
    """The same by one scan for each facet."""
    frames = [docs.where(document_matches(spec.without(L.facet(n).relaxes), L)).select(F.lit(n).alias("facet"), F.explode(counts.facet_values(L.facet(n), L)).alias("value")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count")) for n in names]
    return reduce(DataFrame.unionAll, frames)

CASES = [
    ({}, True), ({"applications": [10, 200]}, True), ({"applications": [199, 200]}, False), ({"labels": [0], "applications": [200]}, False), ({"flux": (10000.0, 10000.0)}, True), ({"flux": (15000.0, 20000.0)}, True), ({"flux": (50000.0, 60000.0)}, False),
    ({"cri_min": 80}, True), ({"cri_min": 95}, False), ({"manufacturer": ["LEDVANCE"]}, True), ({"manufacturer": ["Other"]}, False), ({"text": "Hallen", "locale": "de"}, True), ({"text": "Hallen", "locale": "en"}, False), ({"text": "not present", "locale": "de"}, False), ({"text": "Bay"}, True),
    ({"text": "ledvance"}, True), ({"applications": [10], "flux": (50000.0, 60000.0)}, False), ({"flux": (0.0, 12000.0), "cct": (4500, 6000)}, False), ({"manufacturer": []}, True), ({"ip_code": [25]}, True), ({"has_photometry": False}, False), ({"mounting_place": ["Wall"]}, False),
]


def test_filter_cases(spark):
    df = frame(spark, SAMPLE)
    got = df.select(*[document_matches(Spec.of(**v), L).alias(f"c{k}") for k, (v, _) in enumerate(CASES)]).first()
    assert [bool(x) for x in got] == [want for _, want in CASES]


def test_nulls_never_match(spark):
    bare = doc("bare", variants=[variant(0, mounting_place="Wall"), variant(1, 100.0, 10.0, None)])
    nan = doc("nan", variants=[variant(0)])
    df = frame(spark, bare, nan)
    nan_flux = df.withColumn("variants", F.transform("variants", lambda v: v.withField("photometry", F.coalesce(v["photometry"], F.lit(None)))))
    assert nan_flux.where(document_matches(Spec.of(cct=(3000, 4500)), L)).count() == 0
    assert {r.doc_id for r in df.where(document_matches(Spec.of(mounting_place=["Wall"]), L)).collect()} == {"bare"}
    assert df.where(document_matches(Spec.of(has_photometry=False), L)).count() == 2
    assert df.where(document_matches(Spec.of(has_photometry=True), L)).count() == 1


def test_depth_needs_recessed(spark):
    docs = [doc(n, variants=[variant(0, mounting_type=t, recessed_depth_mm=d)]) for n, t, d in (("a", "SurfaceMounted", 15), ("b", "Recessed", 15), ("c", "Recessed", 60))]
    df = frame(spark, *docs)
    assert [r.doc_id for r in df.where(document_matches(Spec.of(recessed_depth=(0, 20)), L)).collect()] == ["b"]
    bounds = counts.range_bounds(df, Spec(), L, ["recessed_depth", "flux"]).first()
    assert (bounds.recessed_depth_min, bounds.recessed_depth_max, bounds.flux_min) == (15, 60, None)


def test_search_pages_and_flags_are_not_correlated(spark):
    docs = [doc(f"d{k}") for k in range(5)] + [doc("none", variants=[]), doc("mixed", variants=[variant(0, has_3d=True), variant(1, 1500.0, 15.0, 4000)])]
    df = frame(spark, *docs)
    hits = search.search(df, Spec.of(flux=(1000.0, 2000.0)), L)
    assert search.total(hits).first().total == 6
    assert [r.doc_id for r in search.page(hits, "doc_id", "variant_ix", offset=2, limit=2).collect()] == ["d2", "d3"]
    both = search.search(df, Spec.of(has_3d=True), L).collect()
    assert {(r.doc_id, r.variant_ix) for r in both} == {("mixed", 0), ("mixed", 1)}


def test_facets_relax_their_own_field(spark):
    df = frame(spark, doc("1", "Acme", ip_code=0), doc("2", "Acme", ip_code=1), doc("3", "Beta", ip_code=0), doc("4", "Beta", ip_code=1, variants=[variant(0)]))
    spec = Spec.of(manufacturer=["Acme"], ip_code=[0])
    names = ["manufacturer", "ip_code", "has_photometry"]
    got = {(r.facet, r.value): r["count"] for r in counts.facet_counts(df, spec, L, names).collect()}
    assert got == {("manufacturer", "Acme"): 1, ("manufacturer", "Beta"): 1, ("ip_code", "0"): 1, ("ip_code", "1"): 1, ("has_photometry", "present"): 1}
    naive = {(r.facet, r.value): r["count"] for r in naive_facet_counts(df, spec, names).collect()}
    assert naive == got
    assert counts.facet_counts(df, Spec.of(text="x"), L, names, skip_text_only=True).count() == 0
    assert counts.facet_counts(df, Spec(), L, []).count() == 0


def test_every_facet(spark):
    v = [variant(0, 1500.0, 15.0, 4000, lamp_type=3, control_gear_interfaces=[1, 2], has_emergency_lighting=True), variant(1, control_gear_interfaces=[2], emergency_lighting_type=4, has_emergency_lighting=True)]
    df = frame(spark, doc("1", "", variants=v, labels=[1], ik_rating=8))
    got = {(r.facet, r.value) for r in counts.facet_counts(df, Spec(), L, [f.name for f in L.facets]).collect()}
    assert got == {("labels", "1"), ("ik_rating", "8"), ("mounting_place", "Ceiling"), ("mounting_type", "SurfaceMounted"), ("light_distribution", "0"), ("has_photometry", "present"), ("has_photometry", "missing"), ("has_3d", "missing"), ("has_emergency", "present"), ("lamp_type", "3"), ("control_gear", "1"), ("control_gear", "2"), ("emergency_type", "4"), ("emergency_type", "(unspecified)")}


def test_bounds_relax_their_own_axis(spark):
    df = frame(spark, *[doc(str(f), m, variants=[variant(0, f, 10.0, 3000)]) for f, m in ((1000.0, "Acme"), (3000.0, "Acme"), (5000.0, "Beta"))])
    got = counts.range_bounds(df, Spec.of(flux=(1500.0, 2000.0), manufacturer=["Acme"]), L, ["flux", "cct"]).first()
    assert (got.flux_min, got.flux_max, got.cct_min) == (1000.0, 3000.0, None)


def test_articles(spark):
    df = frame(spark, doc("1", gtin="ART-1234"), doc("2", product_code="SHARED"), doc("3", gtin="shared"), doc("4", gtin=" - . / "))
    table = search.articles(df, "gtin", "product_code")
    for text in ("art1234", "ART 1234", "art.1234"):
        assert [r.doc_id for r in search.lookup_article(table, text).collect()] == ["1"]
    assert {r.doc_id for r in search.lookup_article(table, "Shared").collect()} == {"2", "3"}
    assert search.lookup_article(table, " - . / ").count() == 0 and search.lookup_article(table, "nope").count() == 0
    assert search.suggest_articles(table, "ar", "doc_id").count() == 0
    assert [r.original for r in search.suggest_articles(table, "art", "doc_id").collect()] == ["ART-1234"]
    assert search.suggest_articles(table, "sha", "doc_id", limit=1).count() == 1


def test_suggestions(spark):
    df = frame(spark, doc("1", "AEC Illuminazione"), doc("2", "AEC Illuminazione"), doc("3", "ERCO"), doc("4", "The AEC"))
    table = counts.suggestion_table(df, L, ["manufacturer"])
    assert [(r.value, r["count"]) for r in counts.suggest_facets(table, "aec").collect()] == [("AEC Illuminazione", 2), ("The AEC", 1)]
    assert counts.suggest_facets(table, "a").count() == 0 and counts.suggest_facets(table, "").count() == 0
    assert counts.suggest_facets(table, "aec", limit=1, tenant="erco").count() == 0


@pytest.mark.parametrize(("slug", "name"), [("philips", "Philips"), ("PHILIPS", "Philips"), ("aec-illuminazione", "AEC Illuminazione"), ("aec", "AEC Illuminazione"), ("lena", "Lena Lighting S.A."), ("als", "A.L.S."), ("a-l-s", "A.L.S."), ("nobile", "nobilé"), ("iguzzini", "iGuzzini"), ("3f-filippi", "3F Filippi"), ("unknown", None), ("  ", None)])
def test_slugs(spark, slug, name):
    names = spark.createDataFrame([(n, k) for k, n in enumerate(("Philips", "ERCO", "AEC Illuminazione", "Lena Lighting S.A.", "A.L.S.", "nobilé", "iGuzzini", "3F Filippi"))], "name string, ord int")
    got = search.resolve_slug(names, slug).first()
    assert (got and got.name) == name


def test_lookups(spark):
    df = frame(spark, doc("a", variants=[variant(0), variant(1)]), doc("b"))
    ids = spark.createDataFrame([(0, "b"), (1, "zzz"), (2, "old"), (3, "b")], "pos int, id string")
    aliases = spark.createDataFrame([("old", "a")], "source_id string, family_id string")
    assert [r.doc_id for r in search.documents_by_id(df, ids, aliases).collect()] == ["b", "a", "b"]
    refs = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 0), (3, "x", 0)], "pos int, id string, ix int")
    assert [(r.doc_id, r.v.id) for r in search.variants_by_id(df, refs, L).collect()] == [("a", 1), ("b", 0)]
    assert search.source_of_variant(df).count() == 3
    assert photometry(10.0, 2.0, 3000)["efficacy_lm_w"] == 5


def test_conditions_reach_the_scan(spark, sf):
    from prismfold.plans import catalogue

    def scans(name):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        return [x for x in plan.split("\n") if "PushedFilters" in x]

    assert any("In(o_orderpriority, [1-URGENT,2-HIGH])" in x for x in scans("q_search_nested"))
    assert any("In(l_orderkey, [2,3,32,7,999999999])" in x for x in scans("q_batch_lookup"))
