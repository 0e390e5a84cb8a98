"""Families as flat tables: equal to the folded documents, and one family over many tasks."""

import random

from catalogue_docs import doc, frame, variant
from pyspark.sql import functions as F

from prismfold.operators import fold


def stored(spark, docs, path, parts, **options):
    fold.placed(docs, parts, **options).write.parquet(path)
    return spark.read.parquet(path)


def test_flat_equals_folded(spark, tmp_path):
    rng = random.Random(2)
    docs = []
    for k in range(90):
        docs.append(doc(f"d{rng.randrange(10**6):06d}-{k}", rng.choice(["A", "B", "C", ""]), rng.choice(["x", "y", f"own{k}"]), variants=[variant(i, 100.0 * k, 10.0, 3000) for i in range(rng.randint(0, 3))], keywords=rng.sample(["k1", "k2", "k3"], rng.randint(0, 3)), labels=rng.sample([0, 1, 2], rng.randint(0, 2)), ip_code=rng.choice([None, 3, 4]), gtin=rng.choice([None, f"g{k}"]), descriptions=[{"locale": "de", "text": f"t{k % 4}"}], file_meta={"size_bytes": rng.choice([None, k]), "mtime_epoch_s": rng.choice([None, k]), "format_version": rng.choice([None, "1.0.0", "2.0.0"])}))
    df = frame(spark, *docs)
    m = fold.members(stored(spark, df, str(tmp_path / "p"), 6)).cache()
    head = {r.family_id: r for r in fold.families(m).collect()}
    parts = {}
    for r in fold.family_variants(m).collect():
        parts.setdefault(r.family_id, []).append((r.id, r.source_index, r.v.photometry and r.v.photometry.flux_lm))
    people = {}
    for r in m.select("family_id", "doc_id", "member_ix").collect():
        people.setdefault(r.family_id, []).append((r.member_ix, r.doc_id))
    whole = fold.fold(df, source=None).collect()
    folded = [f for f in whole if len(f.members) > 1]
    assert len(head) == len(whole) and len(folded) > 4
    for f in whole:
        h = head[f.doc_id]
        assert (h.manufacturer, h["product"], h.n_members, h.n_variants) == (f.manufacturer, f["product"], len(f.members), len(f.variants))
        assert [d for _, d in sorted(people[f.doc_id])] == f.members and [k for k, _ in sorted(people[f.doc_id])] == list(range(len(f.members)))
        assert sorted(parts.get(f.doc_id, [])) == [(v.id, v.source_index, v.photometry and v.photometry.flux_lm) for v in f.variants]
        assert (h.ip_code, h.gtin) == (f.ip_code, f.gtin)
        if len(f.members) > 1:  # a document alone passes as it is
            assert (h.keywords, h.labels, h.descriptions, h.file_meta) == (f.keywords, f.labels, f.descriptions, f.file_meta)


def test_one_family_over_many_tasks(spark, tmp_path):
    n = 1_000_000
    docs = spark.range(n).select(F.format_string("%07d", (F.col("id") * 7919) % n).alias("doc_id"), F.lit("m").alias("manufacturer"), F.lit("p").alias("product"), F.array((F.col("id") % 5).cast("string")).alias("keywords"), F.when(F.col("id") % 3 == 1, F.col("id")).alias("ip_code"), F.array(F.struct(F.lit(0).alias("id"), F.col("id").alias("x")), F.struct(F.lit(1).alias("id"), F.col("id").alias("x"))).alias("variants"))
    s = stored(spark, docs, str(tmp_path / "p"), 16)
    assert s.groupBy("part").count().agg(F.max("count")).first()[0] < n / 8
    m = fold.members(s)
    v = fold.family_variants(m).agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("source_index") != F.floor(F.col("id") / 2))).first()
    assert tuple(v) == (2 * n, 2 * n, 0, 2 * n - 1, 0)
    h = fold.families(m, union=("keywords",), first=("ip_code",), meta=None).collect()
    assert len(h) == 1 and (h[0].n_members, h[0].n_variants, h[0].keywords) == (n, 2 * n, ["0", "1", "2", "3", "4"])
    least = docs.where("ip_code is not null").agg(F.min_by("ip_code", "doc_id")).first()[0]
    assert h[0].ip_code == least
    assert m.where("member_ix <> cast(doc_id as int)").count() == 0
