"""Scalar functions, mining, specs and folding against fixed expectations."""

import math
import random
import re

import pytest
from catalogue_docs import doc, frame, variant
from pyspark.sql import functions as F

from prismfold.functions import mining, photometry, text
from prismfold.operators import fold
from prismfold.plans import spec as S
from prismfold.plans.luminaires import LUMINAIRES as L
from prismfold.plans.spec import Spec

IPS = ("IP44", "IP54", "IP65")
IKS = ("IK08", "IK10", "IK10+")


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()


@pytest.mark.parametrize(("name", "want"), [
    ("DL SQUARE MAXI C/EW 2x42° 15W 930 SL-10 EM1/3h + White Optic IP54 | Battery", (None, 15.0, 42.0, "IP54", 3000, 90, True, "Square")), ("BARIS 52 LED Z 1143mm 1900lm 840 IP44 I cl. PRM Anoda CO 16W NO DIFFUSER", (1900.0, 16.0, None, "IP44", 4000, 80, False, None)),
    ("MADERA 3 LED 480x480mm 3100lm 830 IP44 OPAL WHITE (26W)", (3100.0, 26.0, None, "IP44", 3000, 80, False, None)), ("Some Luminaire IP99 weird", (None, None, None, None, None, None, False, None)), ("SlimBlend Rectangular, suspended", (None, None, None, None, None, None, False, "Square")),
    ("", (None, None, None, None, None, None, False, None)), ("LED panel 4000K 30W", (None, 30.0, None, None, 4000, None, False, None)), ("Spot 10x60° 20W", (None, 20.0, 10.0, None, None, None, False, None)), ("Rail 2x18W 1.900lm", (1.0, 36.0, None, None, None, None, False, None)), ("X 812 4000K", (None, None, None, None, None, None, False, None)),
])
def test_mining(spark, name, want):
    x = F.col("x")
    assert tuple(one(spark, name, mining.flux(x), mining.power(x), mining.beam(x), mining.ip_code(x, IPS), mining.cct(x), mining.cri_checked(x), mining.emergency(x), mining.form(x))) == want


def test_mined_words(spark):
    x = F.col("x")
    assert one(spark, "IK10+ x", mining.ik_rating(x, IKS))[0] == "IK10"
    assert set(one(spark, "Light 22W 1500lm IP65 4000K", mining.keywords(x, IPS, IKS))[0]) == {"22W", "1500lm", "IP65", "4000K"}
    table = mining.probes(["Interior: Office: Office Desks", "Exterior: Streets", "Exterior: Other"])
    assert ("office desks", 0) == table[0] and ("street", 1) in table and not any(t == "other" for t, _ in table)
    assert one(spark, "UrbanPro Street LED", mining.applications(x, table))[0] == [1]
    assert mining.singular("galleries") == "gallery" and mining.singular("class") is None and mining.taxonomy("A: B") == ("A", None, "B")


@pytest.mark.parametrize(("value", "want"), [("830", (3000, 80)), ("/940", (4000, 90)), ("930K", (3000, 90)), ("899", (9900, 80)), ("720", None), ("812", None), ("Ra 80, 4000K", None)])
def test_din(spark, value, want):
    got = one(spark, value, photometry.din_code(F.col("x")))[0]
    assert (got and tuple(got)) == want


def test_photometry_texts(spark):
    x = F.col("x")
    assert [one(spark, v, photometry.kelvin(x))[0] for v in ("4000K", "color 6500 K", "xx 99 yy")] == [4000, 6500, None]
    assert [one(spark, v, photometry.rendering(x))[0] for v in ("Ra80", "RA95", "ra 90", "foo")] == [80, 95, None, None]
    assert [tuple(spark.createDataFrame([p], "a string, b string").select(photometry.colour(F.col("a"), F.col("b")).alias("c")).first().c) for p in (("830", "Ra80"), ("4000K", "Ra80"), ("LED", ""))] == [(3000, 80), (4000, 80), (None, None)]
    assert [one(spark, v, photometry.symmetry_of(x), kind="int")[0] for v in (0, 4, 7, 10, 12, 14, None)] == ["Rotational", "Axial", "Asymmetric", "Diffuse", "Rotational", "Unknown", "Unknown"]


def test_sanitising(spark):
    df = frame(spark, doc("a", variants=[variant(0, 100.0, 0.01, 3000), variant(1, 3000.0, 30.0, 3000)]))
    df = df.select(F.explode("variants.photometry").alias("p")).select(photometry.sanitized(F.col("p").withField("beam_deg", F.lit(1045.0).cast("float"))).alias("p"))
    a, b = sorted((r.p for r in df.collect()), key=lambda p: p.flux_lm)
    assert (a.flux_lm, a.efficacy_lm_w, a.beam_deg, b.efficacy_lm_w) == (100.0, None, None, 100.0)
    assert [one(spark, v, photometry.capped(F.col("x"), 10.0), kind="double")[0] for v in (float("nan"), -5.0, math.inf, 3.0)] == [None, None, None, 3.0]
    assert [one(spark, v, photometry.sane_depth(F.col("x")), kind="int")[0] for v in (800000, 50)] == [None, 50]


@pytest.mark.parametrize(("name", "key"), [("A.L.S.", "als"), ("a.l.s", "als"), ("A L S", "als"), ("Lena Lighting S.A.", "lena lighting"), ("Acme GmbH", "acme"), ("Foo Bar AG", "foo bar"), ("Bar Ltd.", "bar"), ("RUCO LiChT", "ruco licht"), ("  ", "")])
def test_manufacturer_key(spark, name, key):
    assert one(spark, name, text.manufacturer_key(F.col("x")))[0] == key


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, "ÉCLAT Bar", text.folded_contains(x, "bar"), text.folded_contains(x, "éclat"))[:] == (True, False)
    assert one(spark, "  a b \t", text.unicode_trim(x))[0] == "a b"
    assert one(spark, "a" * 201, *text.snippet(x))[:] == ("a" * 200 + "…", True)
    assert one(spark, "A" * 64, text.hex_id(x))[0] == "a" * 64 and one(spark, "z" * 64, text.hex_id(x))[0] is None
    assert one(spark, "a b/c d.x", text.percent_path(x))[0] == "a%20b/c%20d.x"
    assert one(spark, "a b/c.x", text.viewer_link("https://v/?f=", F.lit("https://h"), x))[0] == "https://v/?f=https%3A%2F%2Fh%2Fa%2520b%2Fc.x"


def test_spec_codec():
    spec = Spec.of(text="led office", flux=(1500.0, 2000.0), applications=[10, 12, 14], mounting_place=["Ceiling", "Wall"], mounting_type=["Recessed"], has_photometry=True, has_3d=False, cri_min=80, manufacturer=["ERCO", "Zumtobel"])
    pairs = S.to_query_pairs(spec, L)
    assert dict(pairs) == {"text": "led office", "flux": "1500-2000", "app": "10,12,14", "mp": "Ceiling,Wall", "mt": "Recessed", "phot": "1", "m3d": "0", "cri": "80", "mfr": "ERCO,Zumtobel"}
    assert S.from_query_pairs(pairs, L) == spec == S.from_query_string(S.to_query_string(spec, L), L) == S.from_json(S.to_json(spec), L)
    assert S.from_query_pairs([("nope", "1"), ("flux", "not-a-range"), ("flux", "9-1"), ("app", "1,x,1"), ("phot", "maybe")], L) == Spec.of(applications=[1])
    assert S.from_json({"geometry": ["Wall"], "zzz": 1}, L) == Spec.of(mounting_place=["Wall"])
    assert Spec.of(text="") == Spec() and Spec.of(text="a", locale="de").is_text_only() and not Spec.of(text="a", ip_code=[1]).is_text_only() and not Spec().is_text_only()


def test_spec_algebra():
    assert Spec().toggled("ip_code", 3).toggled("ip_code", 3) == Spec()
    assert Spec.of(emergency_type=[1]).toggled_emergency("(unspecified)") == Spec.of(has_emergency=True)
    assert Spec.of(text="x", manufacturer=["A"]).applied("manufacturer", "A") == Spec()
    assert Spec.of(ip_code=[1, 2], flux=(1.0, 2.0)).chips() == [("flux", (1.0, 2.0)), ("ip_code", 1), ("ip_code", 2)]
    assert Spec.of(ip_code=[1, 2]).without_chip("ip_code", 1) == Spec.of(ip_code=[2])
    assert S.slider(0, 10, (0, 10), "low") is None and S.slider(8, 5, (0, 10), "low") == (5, 5)
    assert S.one_sided(None, 5.0) == (-math.inf, 5.0) and S.one_sided(3, None, 65535) == (3, 65535)
    assert S.from_cli(L, {"ip_code": {"IP65": 4}}, ip_code=["IP65", "IP99"], flux="100:")[0] == Spec.of(ip_code=[4], flux=(100.0, math.inf))


def test_fold(spark):
    a = doc("b1", "ERCO", "X", applications=[10, 20], gtin=None, descriptions=[{"locale": "en", "text": "t"}])
    b = doc("a1", "ERCO", "X", applications=[20, 30], gtin="g", descriptions=[{"locale": "en", "text": "t"}])
    df = frame(spark, a, b, doc("c", "erco", "X", ip_code=3), doc("d", "ERCO", "Y"))
    f = fold.fold(df)
    rows = {(r.manufacturer, r["product"]): r for r in f.collect()}
    x = rows["ERCO", "X"]
    assert len(rows) == 3 and x.applications == [10, 20, 30] and x.gtin == "g" and len(x.descriptions) == 1 and x.file_meta.size_bytes == 2000
    assert [(v.id, v.source_index) for v in x.variants] == [(0, 0), (1, 1)] and [p.value for p in x.source_paths] == ["a1.x", "b1.x"] and x.source.value == "a1.x"
    assert rows["erco", "X"].doc_id == "c" and rows["erco", "X"].ip_code == 3
    assert {r.source_id: r.family_id for r in fold.aliases(f).collect()} == {"a1": x.doc_id, "b1": x.doc_id, "c": "c", "d": "d"}
    assert tuple(fold.fold_stats(df, f).first()) == (4, 4, 3, 4, 4)


def test_fold_nameless(spark):
    rows = [(1, "", " "), (2, None, ""), (3, "", " "), (4, "A", "p"), (5, "A", "p")]
    df = spark.createDataFrame(rows, "doc_id long, manufacturer string, product string").selectExpr("cast(doc_id as string) as doc_id", "manufacturer", "product", "array(named_struct('id', 0, 'source_index', 0)) as variants")
    sizes = lambda **kw: sorted(len(r.members) for r in fold.fold(df, meta=None, source=None, **kw).collect())
    assert sizes() == [1, 2, 2] and sizes(nameless=False) == [1, 1, 1, 2]


def test_glyphs(spark):
    rows = spark.range(-1, 17).select("id", photometry.glyph(F.col("id")).alias("g")).select("id", "g", photometry.glyph_path(F.col("g.c0")).alias("path")).collect()
    g = {r.id: r.g for r in rows}
    assert g[-1] is None and g[15] is None and all(len(g[k].c0) == 37 == len(g[k].c90) for k in range(15))
    assert g[0].c0[3] == math.exp(-0.5 * (15 / 12) ** 2) and not g[0].both and g[4].both and g[6].both
    assert g[9].c0[18] == 1 and g[9].c0[19] == 0 and g[12].c0[0] == 0 and g[12].c0[36] == 1
    assert abs(g[13].c0[36] - 0.6) < 1e-9 and g[14].c0 == [1.0] * 37  # scaled to the largest
    path = {r.id: r.path for r in rows}[10]
    assert path.startswith("M32.00 60.00 L34.44 59.89") and path.endswith("L32.00 60.00 Z") and path.count("L") == 73


def test_a_thousand_applications(spark):
    """Words meet a broadcast table; the same as one pattern a probe."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6))) for _ in range(700)] + ["äöü", "ab-cd", "c++x", "x_1y"]
    leaves = [f"Top: {' '.join(rng.sample(words, rng.randint(1, 3)))}{rng.choice(['', 's', ' (note)', '/zones'])}" for _ in range(1000)]
    table = mining.probes(leaves)
    names = [None, "", "äöü", "xäöü", "Straße ÄÖÜ!"] + [" ".join(rng.choice(words).title() + rng.choice(["", "s", "-", ".", "_"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    names += [" ".join(rng.choice(leaves)[5:].split()[:2]) + "x" * (k % 2) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    got = {r.k: r.applications for r in mining.applications_joined(df, "k", "name", table).collect()}
    small = [t for t in table if any(t[0].split()[0] in (n or "").lower() for n in names)]  # others cannot stand anywhere
    want = {}
    for k, name in enumerate(names):
        low = (name or "").lower()
        ids = [i for text, i in small if re.search("(?<![A-Za-z0-9_])" + re.escape(text) + "(?![A-Za-z0-9_])", low)]
        if ids:
            want[k] = list(dict.fromkeys(ids))
    assert got == want and len(want) > 60
    few = df.limit(20)
    by_pattern = {r.k: r.a for r in few.select("k", mining.applications(F.col("name"), small[:150]).alias("a")).collect() if r.a}
    assert by_pattern == {r.k: r.applications for r in mining.applications_joined(few, "k", "name", small[:150]).collect()}
    assert mining.applications_joined(df, "k", "name", []).count() == 0
    plan = mining.applications_joined(df, "k", "name", [t for t in table if t[0].isascii()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("Exchange hashpartitioning") == 1
