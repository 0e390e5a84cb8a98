"""Text search over blocks against the plain filter."""

import random

from catalogue_docs import doc, frame, variant
from pyspark.sql import functions as F

from prismfold.operators import predicates, trigrams
from prismfold.plans import catalogue
from prismfold.plans.luminaires import LUMINAIRES as L
from prismfold.plans.spec import Spec

WORDS = "Öl Lampe bay SPOT élan ÉLAN İz ﬁn 灯具 𝛼𝛽𝛾x \n tab\t line it's 100% a_b".split(" ")


def stored(spark, tmp_path, docs, blocks=8):
    where, side = str(tmp_path / "blocks"), str(tmp_path / "grams")
    trigrams.blocked(docs, blocks, "manufacturer", "doc_id").write.partitionBy(trigrams.BLOCK).parquet(where)
    table = spark.read.parquet(where)
    trigrams.postings(table, 4).write.parquet(side)
    return table, spark.read.parquet(side)


def corpus(spark, n=80):
    rng = random.Random(9)
    words = lambda k: " ".join(rng.choices(WORDS, k=k))
    docs = []
    for k in range(n):
        texts = [{"locale": rng.choice(["de", "en", None]), "text": rng.choice([words(4), words(1), "", None])} for _ in range(rng.randint(0, 3))]
        docs.append(doc(f"d{k}", rng.choice(["Acme", "Bêta", "", f"M{k % 7}"]), words(2), descriptions=texts, keywords=[words(1) for _ in range(rng.randint(0, 2))], variants=[variant(0, 1000.0 * (k % 3), 10.0, 3000)]))
    docs.append(doc("long", "Acme", "x", descriptions=[{"locale": "en", "text": "pad " * 50_000 + "needle in a long text"}]))
    return frame(spark, *docs)


def test_blocks_equal_the_plain_filter(spark, tmp_path):
    """Needles of 1 to 20 letters, cut from texts or not, with and without a locale and other conditions."""
    docs = corpus(spark).cache()
    table, index = stored(spark, tmp_path, docs)
    assert table.select(trigrams.BLOCK).distinct().count() == 8 and index.count() == index.distinct().count()
    assert docs.where("exists(descriptions, d -> contains(d.text, 'SPOT'))").count() > 5
    rng, text = random.Random(2), "spot élan İz 灯具 𝛼𝛽𝛾x bay 100% a_b"
    needles = [text[k : k + n] for n in range(1, 21) for k in [rng.randrange(len(text) - n)]] + ["", "É", "needle in a long", "pad n", "zzz", "Acme", "Bê", "%", "灯", "𝛽𝛾", "ÉLAN"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for k, needle in enumerate(needles):
        spec = Spec.of(text=needle, **({"locale": ("de", "fr")[k % 4 == 1]} if k % 2 else {}), **({"flux": (900.0, 1100.0)} if k % 3 == 0 else {}))
        assert ids(trigrams.matching(table, index, spec, L)) == ids(predicates.matching(docs, spec, L)), (needle, spec)
    assert ids(trigrams.matching(table, index, Spec.of(), L)) == ids(docs)


def test_blocks_are_skipped(spark, tmp_path):
    table, index = stored(spark, tmp_path, corpus(spark))
    figures = lambda needle: tuple(trigrams.pruning(table, index, needle).first())
    assert figures("needle in") == (8, 1, 7) and figures("zzz") == (8, 0, 8) and figures("") == (8, 8, 0)
    read, skipped = figures("m3")[1:]
    assert read + skipped == 8 and skipped >= 5
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = trigrams.matching(table, index, Spec.of(text="needle in"), L)
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(k) for k in range(leaves.size())]
        read = [s.metrics().apply("numFiles").value() for s in scans if "doc_id" in s.output().toString()]
        assert read == [1]  # one folder of eight
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_no_documents(spark, tmp_path):
    docs = corpus(spark).limit(0)
    table = trigrams.blocked(docs, 4, "doc_id")
    assert trigrams.matching(table, trigrams.postings(table, 2), Spec.of(text="bay"), L).count() == 0
    assert tuple(trigrams.pruning(table, trigrams.postings(table, 2), "bay").first()) == (0, 0, 0)


def test_grams_are_those_of_the_folded_text(spark):
    rows = spark.createDataFrame([("ABcÉ",), ("",), (None,), ("x",)], "t string").select(trigrams.grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [["abc", "bcÉ", "cÉ\0", "É\0\0"], [], None, ["x\0\0"]]


def test_index_is_pushed_down(spark, sf):
    """The trigrams asked for reach the scan of the side table."""
    plan = catalogue.queries()["q_text_locale_blocks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [ l" in plan or "In(gram, [e l" in plan or "PushedFilters: [In(gram" in plan, plan
    assert "dynamicpruning" in plan
