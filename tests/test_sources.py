import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from prismfold.operators import reports
from prismfold.sources import ingest, snapshot
from prismfold.streaming import intake

XML = """<Root><Header><Manufacturer>ACME </Manufacturer>{uid}<FormatVersion major="1" minor="0" pre-release="3"/></Header>
<GeneralDefinitions><Files><File id="l" contentType="ldc/eulumdat">a.ldt</File><File id="i" contentType="image/png">p.png</File></Files></GeneralDefinitions>
<ProductDefinitions><ProductMetaData><Name><Locale language="en">Test Product</Locale></Name><ProductNumber><Locale language="en">N-1</Locale></ProductNumber><Description><Locale language="en-US">no</Locale><Locale language="de">Leuchte</Locale></Description></ProductMetaData>
<Variants><Variant id="v1"><Name><Locale language="en">Spot 22W 1500lm IP65 840</Locale></Name><Mountings><Ceiling><Recessed recessedDepth="50"/></Ceiling></Mountings></Variant><Variant id="v2"/></Variants></ProductDefinitions></Root>"""


def ldt():
    lines = ["maker", "1", "1", "1", "0", "5", "22.5"] + ["x"] * 14 + ["100", "80", "1", "0", "1"] + ["1", "LED", "3000", "830", "80", "30"] + ["0"] * 10 + ["0"] + ["0", "22.5", "45", "67.5", "90"] + ["100", "80", "40", "10", "0"]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    os.makedirs(root / "sub")
    for name, uid in (("a.gldf", "<UniqueGldfId>u-1</UniqueGldfId>"), ("sub/b.GLDF", "")):
        with zipfile.ZipFile(root / name, "w") as z:
            z.writestr("product.xml", XML.format(uid=uid))
            z.writestr("ldc/a.ldt", ldt())
    (root / "bad.gldf").write_bytes(b"no archive")
    (root / "other.txt").write_text("x")
    return str(root)


def test_documents(spark, corpus):
    files = ingest.listing(spark, corpus, content=True)
    assert {r.relative for r in files.select("relative").collect()} == {"a.gldf", "sub/b.GLDF", "bad.gldf"}
    assert ingest.products(files).where("error is not null").count() == 1
    docs = {os.path.basename(r.path): r for r in ingest.documents(files, {"ip_code": ("IP20", "IP65")}).collect()}
    a = docs["a.gldf"]
    assert (a.manufacturer, a["product"], a.product_code, a.file_meta.format_version) == ("ACME", "Test Product", "N-1", "1.0.-rc.3")
    assert a.doc_id != docs["b.GLDF"].doc_id and len(a.variants) == 2
    v = a.variants[0]
    assert (v.mounting_place, v.mounting_type, v.recessed_depth_mm) == ("Ceiling", "Recessed", 50)
    assert (v.photometry.flux_lm, v.photometry.power_w, v.photometry.cct_k, v.photometry.efficacy_lm_w) == (3000.0, 30.0, 3000, 100.0)
    assert "1500lm" in a.keywords and {d.locale for d in a.descriptions} == {"de", "en"}
    assert {w.kind for w in docs["b.GLDF"].warnings} == {"DocIdUnavailable"}
    assert ingest.inspect(ingest.products(files)).where("manufacturer is not null").first().ldc == 1


MARKED = XML.replace('<Variant id="v1">', """<Variant id="v1"><DescriptiveAttributes><Marketing><Applications><Application>Indoor: Office</Application><Application>Nowhere</Application></Applications><Labels><Label>CE</Label></Labels></Marketing><Mechanical><ProductForm>Oval</ProductForm><Adjustabilities><Adjustability>Tilt</Adjustability></Adjustabilities></Mechanical></DescriptiveAttributes>""").replace('<Variant id="v2"/>', """<Variant id="v2"><Name><Locale language="en">round school spot IK08</Locale></Name><DescriptiveAttributes><Marketing><Labels><Label>ENEC</Label></Labels></Marketing><Electrical><IngressProtectionIPCode>IP20</IngressProtectionIPCode><ElectricalSafetyClass>II</ElectricalSafetyClass></Electrical></DescriptiveAttributes></Variant>""")
TABLES = {"applications": ("Indoor: Office", "Indoor: School rooms"), "labels": ("ENEC", "CE"), "adjustability": ("Tilt",), "ip_code": ("IP20", "IP65"), "ik_rating": ("IK08",), "product_form": ("Round", "Square"), "safety_class": ("I", "II")}


def test_typed_and_mined(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.gldf", "w") as z:
        z.writestr("product.xml", MARKED.format(uid=""))
    d = ingest.documents(ingest.listing(spark, str(tmp_path), content=True), TABLES).first()
    # typed Office of v1 and the word school mined of v2; labels of both variants
    assert (d.applications, d.labels, d.adjustability) == ([0, 1], [0, 1], [0])
    # v1 has a mined IP65 and comes first; the form Oval is unknown, so the mined one of v2 counts
    assert (d.ip_code, d.ik_rating, d.product_form, d.safety_class) == (1, 0, 0, 1)
    assert {"Indoor: Office", "CE", "ENEC", "Tilt", "IP20", "II"} <= set(d.keywords) and "Oval" not in d.keywords
    assert sorted((w.kind, w.detail) for w in d.warnings) == [("DocIdUnavailable", ""), ("NonCanonicalEnumValue", "v1 Application Nowhere"), ("NonCanonicalEnumValue", "v1 ProductForm Oval"), ("PhotometryMissing", "v1"), ("PhotometryMissing", "v2")]


def test_rebuild_and_json(spark, corpus, tmp_path):
    files = ingest.listing(spark, corpus, content=True)
    docs = ingest.documents(files)
    snapshot.write(docs.withColumn("product", F.lit("kept")), str(tmp_path / "s"))
    old = snapshot.read(spark, str(tmp_path / "s"))
    changed = files.withColumn("mtime", F.when(F.col("relative") == "a.gldf", F.col("mtime") + 1).otherwise(F.col("mtime")))
    got = {r.source.value: r["product"] for r in ingest.rebuilt(changed, old, ingest.documents).collect()}
    assert got == {"a.gldf": "Test Product", "sub/b.GLDF": "kept"}
    assert '"manufacturer":"ACME"' in ingest.as_json(docs).first().json
    assert ingest.copy_sample(files, str(tmp_path / "copy")).agg(F.sum("copied")).first()[0] == files.agg(F.sum("length")).first()[0]
    assert os.path.exists(tmp_path / "copy" / "sub" / "b.GLDF")
    x = spark.createDataFrame([("a.JPG", None), ("b", "png"), ("c", "image/gif")], "n string, t string")
    assert [r.m for r in x.select(ingest.picture(F.col("n"), F.col("t"), F.lit(b"x"))["mime"].alias("m")).collect()] == ["image/jpeg", "image/png", "image/gif"]


def test_samples_and_manifest(spark, corpus, tmp_path):
    files = ingest.listing(spark, corpus, content=True)
    assert ingest.sample(files, 2, 42).count() == 2 and ingest.sample(files, 99).count() == 3
    assert [r.path for r in ingest.sample(files, 2, 42).collect()] == [r.path for r in ingest.sample(files, 2, 42).collect()]
    with pytest.raises(ValueError):
        ingest.sample(files, 0)
    target = str(tmp_path / "m")
    ingest.manifest(files, target)
    assert spark.read.json(target).count() == 3
    with pytest.raises(FileExistsError):
        ingest.manifest(files, target)
    assert reports.largest_files(files, 1).count() == 1


@pytest.mark.parametrize("scheme", ["file://", "viewfs://bundles"])
def test_bundles(spark, corpus, tmp_path, scheme):
    """The same bundle through two file systems; the archives in it are those of the folder."""
    root = str(tmp_path)
    if scheme != "file://":
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bundles.link./shelf", f"file://{root}")
        root = "/shelf"
    target = f"{scheme}{root}/bundle"
    files = ingest.listing(spark, corpus, content=True)
    want = sorted((r.relative, r.length, hashlib.sha256(bytes(r.content)).hexdigest()) for r in files.collect())
    with pytest.raises(Exception):
        ingest.read_bundle(spark, target)
    assert sorted(tuple(r) for r in ingest.write_bundle(files, target).collect()) == want
    assert sorted((r.relative, r.length, r.sha256) for r in spark.read.json(f"{target}/manifest").collect()) == want
    back = ingest.read_bundle(spark, target)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, files.collect()))
    names = lambda f: sorted((r.relative, r.error is None) for r in ingest.products(f).select("relative", "error").collect())
    assert names(back) == names(files)
    with pytest.raises(FileExistsError):
        ingest.write_bundle(files, target)
    assert ingest.write_bundle(files.where("relative like '%a.gldf'"), target, force=True).count() == 1
    assert ingest.read_bundle(spark, target).count() == 1 and ingest.damaged(spark, target).count() == 0


def test_damaged_bundles(spark, corpus, tmp_path):
    target = f"file://{tmp_path}/bundle"
    files = ingest.listing(spark, corpus, content=True)
    ingest.write_bundle(files, target)
    first, second, third = sorted(r.relative for r in files.collect())
    changed = F.when(F.col("relative") == first, F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))
    other = F.when(F.col("relative") == second, F.lit("new")).otherwise(F.col("relative"))
    files.withColumn("sha256", F.lit("")).withColumn("content", changed).withColumn("relative", other).write.mode("overwrite").parquet(f"{target}/files")
    assert {tuple(r) for r in ingest.damaged(spark, target).collect()} == {(first, "changed"), (second, "missing"), ("new", "not listed")}


def test_snapshot(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "snap")
    snapshot.write(df, path)
    assert snapshot.read(spark, path).count() == 3
    with pytest.raises(snapshot.SnapshotMismatch):
        snapshot.read(spark, path, "0")
    snapshot.write(spark.range(5), path)
    assert snapshot.cached(spark, path, lambda: spark.range(9)).count() == 5
    assert snapshot.cached(spark, str(tmp_path / "fresh"), lambda: spark.range(9)).count() == 9
    reader = snapshot.read(spark, path)  # goes on while a new build comes in
    os.makedirs(f"{path}/build-99999999999999999999/data")  # a build that did not end does not count
    snapshot.write(spark.range(7), path)
    assert (reader.count(), snapshot.read(spark, path).count()) == (5, 7)
    with pytest.raises(snapshot.SnapshotMissing):
        snapshot.read(spark, str(tmp_path / "none"))


def test_increment_and_stream(spark, corpus, tmp_path):
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, None)], "relative string, length long, mtime long")
    old = spark.createDataFrame([("a", 1, 5), ("b", 9, 5), ("c", 3, None), ("gone", 1, 1)], "relative string, length long, mtime long")
    assert {r.relative: r.reused for r in ingest.incremental(now, old).collect()} == {"a": True, "b": False, "c": False}
    q = intake.watch(spark, corpus, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert snapshot.read(spark, str(tmp_path / "t")).count() == 3


def test_positions_and_paths(spark, monkeypatch):
    x = spark.createDataFrame([(["f", "g"],)], "f array<string>")
    assert x.select(ingest.file_of_variant(F.col("f"), F.lit(2), F.lit(1)), ingest.file_of_variant(F.col("f"), F.lit(3), F.lit(1))).first()[:] == ("g", "f")
    monkeypatch.setenv("CATALOGUE_CACHE", "")
    assert ingest.snapshot_path("/x") is None and ingest.corpus_root("/y") == "/y"
    with pytest.raises(ValueError):
        ingest.corpus_root()
    entries = spark.createDataFrame([("a.ldt", 10, 5), ("b/p.PNG", 20, 20), ("x", 1, 1)], "name string, size long, packed long")
    assert {r.category: r.bytes for r in reports.archive_categories(entries).collect()} == {"photometry": 10, "image": 20, "other": 1}


def files_of(path):
    return {os.path.relpath(os.path.join(d, n), path): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_bucketed_snapshot(spark, tmp_path):
    path = str(tmp_path / "b")
    with pytest.raises(snapshot.SnapshotMissing):
        snapshot.read_bucketed(spark, path)
    df = spark.range(200).select(F.col("id").cast("string").alias("path"), F.col("id").alias("x"))
    snapshot.write_bucketed(df, path, "path", 16)
    before = files_of(path + "/data")
    assert len(before) == 16
    # one changed document: one bucket has a new file, the others their old ones
    touched = snapshot.update_bucketed(spark, path, spark.createDataFrame([("7", -7, "new")], "path string, x long, extra string"))
    after = files_of(path + "/data")
    assert len(touched) == 1 and {f for f in set(before) ^ set(after)} and all(f"bucket={touched[0]}/" in f for f in set(before) ^ set(after))
    assert all(after[f] == t for f, t in before.items() if f"bucket={touched[0]}/" not in f)
    got = {r.path: (r.x, r.extra) for r in snapshot.read_bucketed(spark, path).collect()}
    assert len(got) == 200 and got["7"] == (-7, "new") and got["8"] == (8, None)
    # a whole bucket and another document go; a new one comes
    one = snapshot._bucket("path", 16)
    lost = df.where(one == touched[0]).select("path")
    n = lost.count()
    snapshot.update_bucketed(spark, path, spark.createDataFrame([("new", 1)], "path string, x long"), lost.unionAll(spark.createDataFrame([("8",), ("nowhere",)], "path string")))
    left = {r.path for r in snapshot.read_bucketed(spark, path).collect()}
    assert left == {str(k) for k in range(200)} - {r.path for r in lost.collect()} - {"8"} | {"new"} and n > 1
    assert snapshot.update_bucketed(spark, path) == [] and snapshot.update_bucketed(spark, path, df.limit(0)) == []
    with pytest.raises(snapshot.SnapshotMismatch):
        snapshot.read_bucketed(spark, path, "0")


def test_changed_file_rewrites_one_bucket(spark, corpus, tmp_path):
    path = str(tmp_path / "s")
    files = ingest.listing(spark, corpus, content=True).where("relative <> 'bad.gldf'")
    snapshot.write_bucketed(ingest.documents(files).withColumn("product", F.lit("kept")), path, "path", 32)
    before = files_of(path + "/data")
    changed = files.withColumn("mtime", F.when(F.col("relative") == "a.gldf", F.col("mtime") + 1).otherwise(F.col("mtime")))
    touched = ingest.rebuild_buckets(changed, path, ingest.documents)
    after = files_of(path + "/data")
    assert len(touched) == 1 and len(set(before) & set(after)) == len(before) - 1
    assert {r.source.value: r["product"] for r in snapshot.read_bucketed(spark, path).collect()} == {"a.gldf": "Test Product", "sub/b.GLDF": "kept"}
    assert len(ingest.rebuild_buckets(changed.where("relative = 'a.gldf'"), path, ingest.documents)) == 1
    assert [r.source.value for r in snapshot.read_bucketed(spark, path).collect()] == ["a.gldf"]


def test_stream_into_buckets(spark, corpus, tmp_path):
    q = intake.watch(spark, corpus, str(tmp_path / "t"), str(tmp_path / "c"), buckets=4)
    q.awaitTermination(120)
    assert snapshot.read_bucketed(spark, str(tmp_path / "t")).count() == 3


def test_build_index(spark, corpus, tmp_path):
    path = str(tmp_path / "ix")
    got = ingest.build_index(spark, corpus, path).first()
    assert (got.files, got.failures, got.docs_in, got.docs_out, got.variants_in, got.variants_out, got.aliases) == (3, 1, 2, 1, 4, 4, 2)
    family = snapshot.read(spark, f"{path}/families").first()
    assert (family.manufacturer, family["product"], len(family.members)) == ("ACME", "Test Product", 2)
    assert {r.family_id for r in snapshot.read(spark, f"{path}/aliases").collect()} == {family.doc_id}
    assert [r.relative for r in snapshot.read(spark, f"{path}/failures").collect()] == ["bad.gldf"]
    by = reports.intake_by_manufacturer(snapshot.read(spark, f"{path}/documents")).first()
    assert (by.manufacturer, by.slug, by.docs, by.variants) == ("ACME", "acme", 2, 4)
