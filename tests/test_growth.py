"""Work that grows no faster than its input: tasks by rows, one evaluation of what several columns draw on."""

from pyspark.sql import functions as F

from prismfold.functions.text import ascii_folded, folded_contains, once
from prismfold.operators import bitmaps, flat
from prismfold.plans import bridge, catalogue
from prismfold.plans.bridge import ORDERS
from prismfold.sources import ingest


def test_archives_are_dealt_by_rows(spark, sf, monkeypatch):
    """Tasks grow with the archives, though their source is one small file; each is parsed once in one pass."""
    n = bridge.read(spark, sf, "part").count()
    assert ingest.dealt(spark.range(12), 12, "id", each=5).rdd.getNumPartitions() == 3
    assert ingest.dealt(spark.range(0), 0, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(ingest.dealt, "__kwdefaults__", {"each": 50})
    assert bridge.archives(spark, sf).rdd.getNumPartitions() == -(-n // 50)
    plan = catalogue.queries()["q_archives"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_documents_work_out_values_once(spark, sf):
    """The label of a variant, and what is mined from it, stand once in the plan, not once for each column that uses them."""
    p = ingest.documents(bridge.archives(spark, sf), bridge.CLOSED)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    analyzed = p._jdf.queryExecution().analyzed().toString()
    assert analyzed.count("regexp_extract(") < 100, analyzed.count("regexp_extract(")
    assert [tuple(r) for r in spark.range(3).select(once(F.col("id") * 2, lambda x: x + x).alias("y")).collect()] == [(0,), (4,), (8,)]


def test_inspect_keeps_rows(spark, sf):
    """An archive without files has none of any kind, and a row stays a row."""
    rows = spark.createDataFrame([("a", "m", [], [], []), ("b", "m", [], [], [("1", "image/png", "x"), ("2", "", "y")])], "path string, manufacturer string, variants array<string>, texts array<struct<locale:string>>, files array<struct<id:string,content_type:string,name:string>>")
    got = {r.path: (r.image, r.other, r.ldc) for r in ingest.inspect(rows).collect()}
    assert got == {"a": (0, 0, 0), "b": (1, 1, 0)}


def test_lines_need_no_documents(spark, sf):
    """The variant table made of flat rows is that of the nested documents, row for row; building it nests nothing."""
    nested = flat.flat_table(flat.numbered(bridge.orders(spark, sf, codes=True), ORDERS), ORDERS)
    plain = bridge.order_lines(spark, sf).select(*nested.columns)
    assert nested.count() == plain.count() > 0 and nested.exceptAll(plain).isEmpty() and plain.exceptAll(nested).isEmpty()
    assert "collect_list" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_documents_without_rows_stay(spark):
    docs = spark.createDataFrame([(1, "F", "2-HIGH", 5.0, 1), (2, "O", "5-LOW", 6.0, 2)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, doc_no long")
    rows = spark.createDataFrame([(1, 2, 9.0, 0.1, 0.0, "R", "F", True, "low", ["R", "F"]), (1, 1, 8.0, 0.0, 0.05, "A", "F", False, None, ["A", "F"])], "k long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, discounted boolean, kind string, codes array<string>")
    got = {(r.o_orderkey, r.variant_ix): r for r in flat.table_of_rows(docs, rows, ORDERS, "k", ["l_linenumber"], {"flags": "l_returnflag"}).collect()}
    assert sorted(got, key=repr) == [(1, 0), (1, 1), (2, None)]
    assert got[1, 0].v_l_quantity == 8.0 and got[1, 1].d_flags == ["A", "R"] and got[1, 0].has_has_discount__yes and got[1, 1].has_has_kind__no
    assert got[2, None].d_flags == [] and not got[2, None].has_has_discount__yes and not got[2, None].has_has_discount__no


def test_bitmaps_are_made_after_the_shuffle(spark, sf):
    """Numbers are shuffled, as many as rows; a bitmap a task and part would grow as tasks times documents."""
    docs = flat.numbered(bridge.orders(spark, sf, codes=True), ORDERS)
    for made in (bitmaps.facet_index(docs, ORDERS), bitmaps.matching_bitmaps(bridge.order_lines(spark, sf), catalogue.FACETED, ORDERS, ["status", ""])):
        lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
        first = next(k for k, line in enumerate(lines) if "Exchange" in line)
        assert not any("bitmap_construct_agg" in line for line in lines[first:]), lines


def test_text_is_found_without_a_folded_copy(spark):
    texts = ["Abc \\E DEF", "ÉR ér", "K k K", "ſs S", "a\nB", "", None, "(x+) $1 \\Q[", "😀Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ["abc", "ÉR", "k", "S", "a\nb", "", "\\E d", "\\e d", "(X+) $", "\\q[", "😀z", "\\E", "İ", "\\"]:
        plain = folded_contains(F.col("t"), needle)
        assert "translate" not in df.select(plain)._jdf.queryExecution().analyzed().toString()
        assert [r[0] for r in df.select(plain).collect()] == [r[0] for r in df.select(ascii_folded(F.col("t")).contains(needle.lower())).collect()], needle


def test_found_documents_are_nested_alone(spark, sf, monkeypatch):
    """A search for documents stores the variant table and no nested documents, and drops what it does not find before any shuffle."""
    built = []
    monkeypatch.setattr(bridge, "stored", lambda spark, name, inputs, build, by=None: built.append(name) or build())
    got = catalogue.queries()["q_search_documents"](spark, sf)
    assert built == ["order-lines"]
    found = spark.createDataFrame([(1, 5), (4, 6), (-1, 7)], "o_orderkey long, doc_no long")
    some = bridge.orders(spark, sf, found=found)
    lines = some._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("BroadcastHashJoin" in line and "LeftSemi" in line for line in lines) == 2
    every = sorted(r for r in map(tuple, bridge.orders(spark, sf).collect()) if r[0] in (1, 4))
    assert sorted(map(tuple, some.collect())) == every and len(every) > 0
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(flat, "HITS", 1)  # too many to broadcast
    assert sorted(map(tuple, bridge.orders(spark, sf, found=found).collect())) == every
    assert sorted(map(tuple, catalogue.queries()["q_search_documents"](spark, sf).collect())) == rows and rows
