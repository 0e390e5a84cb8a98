"""Operators 11 to 13 against plain versions on small tables."""

import datetime as dt
import hashlib
import os
import random
import re
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfold.llm import queries, sale_enrichment, url_templates
from prismfold.llm.sale_enrichment import enriched_sales
from prismfold.llm.tandem_runs import periodic_runs, runs_of
from prismfold.llm.url_templates import judged_urls, merged, url_parts

# ---------------------------------------------------------------- 11: sales


def batch_of(day):
    return max(0, min(11, (day - 19723) * 12 // 152))


def day(t):
    return (t.date() - dt.date(1970, 1, 1)).days


def plain_enrichment(sales, changes):
    """The contract, batch by batch, with lists."""
    held, out, waiting = {}, [], []
    changes = [c for c in dict.fromkeys(changes) if c[4] is not None]
    when = lambda c: batch_of(day(c[4]) + zlib.crc32(str(c[0]).encode()) % 4)
    at = lambda s: batch_of(day(s[3])) if s[3] is not None else 11

    def emit(s, b):
        own = held.get(s[1], []) if s[1] is not None else []
        fit = [c for c in own if s[2] is not None and c[4] <= s[2]]
        c = fit[-1] if fit else (None,) * 9
        cents = None if c[8] is None else int(np.floor(100 * c[8] + 0.5))
        out.append(("sale", s[0], b, len(own), c[0], cents, c[3]))

    for b in range(12):
        sold = [s[2] for s in sales if at(s) < b and s[2] is not None]
        valid = [c[4] for c in changes if when(c) < b]
        h = min(max(sold), max(valid)) if sold and valid else None
        for c in changes:
            if when(c) == b:
                if valid and c[4] < max(valid):
                    out.append(("late", c[0], b, None, None, None, None))
                else:
                    held.setdefault(c[1], []).append(c)
                    held[c[1]].sort(key=lambda c: (c[4], c[0]))
        waiting += [s for s in sales if at(s) == b]
        ready = [s for s in waiting if s[2] is None or (h is not None and s[2] < h)]
        waiting = [s for s in waiting if not (s[2] is None or (h is not None and s[2] < h))]
        for s in ready:
            emit(s, b)
        for k, own in held.items():
            past = [c for c in own if h is not None and c[4] <= h]
            held[k] = past[-1:] + own[len(past) :]
    for s in waiting:
        emit(s, 12)
    return out


SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, op string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
FIELDS = ("rec", "id", "batch", "n_held", "change_id", "balance_cents", "op")


def test_enriched_sales(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    client = lambda: rng.choice([1, 1, 1, 2, 3, None])
    sales, changes = [], []
    for k in range(260):
        t = start + dt.timedelta(minutes=rng.randrange(125 * 1440))
        sales.append((k, client(), None if k % 17 == 0 else t, t + dt.timedelta(hours=rng.choice([0, 1, 30, 200])), "x"))
    sales += sales[:3]
    for k in range(160):
        t = start + dt.timedelta(minutes=rng.randrange(125 * 1440) // 60 * 60)
        changes.append((k, client(), k, rng.choice("IUD"), None if k % 23 == 0 else t, "s", "g", "c", None if k % 9 == 0 else k / 8))
    changes += changes[5:9]
    got = enriched_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), slot_seconds=7200, buckets=3)
    have = sorted((tuple(r) for r in got.select(*FIELDS).collect()), key=repr)
    want = sorted(plain_enrichment(sales, changes), key=repr)
    assert have == want
    assert {r[0] for r in want} == {"sale", "late"} and max(r[3] or 0 for r in want) > 4


def test_open_stores(spark):
    """A store is open while its task runs, however many partitions the state has and however often the stream started."""
    start = dt.datetime(2024, 1, 1)
    sales = [(k, k, start + dt.timedelta(days=k), start + dt.timedelta(days=k + 1), "x") for k in range(150)]
    changes = [(k, k, k, "U", start + dt.timedelta(days=k), "s", "g", "c", 1.0) for k in range(150)]
    stores = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    seen, ended = [], threading.Event()

    def watch():
        while not ended.wait(0.05):
            seen.append(stores.getNumRocksDBInstances(True))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    watcher = threading.Thread(target=watch)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        watcher.start()
        assert enriched_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES), buckets=12).count() >= 150
    finally:
        ended.set()
        watcher.join()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < max(seen) <= spark.sparkContext.defaultParallelism and not stores.getNumRocksDBInstances(True)


def test_state_partitions(spark, monkeypatch):
    """Every start opens a store a partition of the state and leaves memory behind: their number goes by cores, not by shuffle partitions."""
    start = dt.datetime(2024, 1, 1)
    sales = [(k, k % 40, start + dt.timedelta(days=k), start + dt.timedelta(days=k + 1), "x") for k in range(150)]
    changes = [(k, k % 40, k, "U", start + dt.timedelta(days=k), "s", "g", "c", 1.0) for k in range(150)]
    begin, found = sale_enrichment._start, []

    def start_and_look(session, feed, state, target, processor):
        begin(session, feed, state, target, processor)
        found.append(sum(x.isdigit() for x in os.listdir(f"{state.removeprefix('file:')}/state/0")))

    monkeypatch.setattr(sale_enrichment, "_start", start_and_look)
    monkeypatch.setattr(sale_enrichment, "_STORES", 4, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        got = enriched_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(changes, CHANGES)).select(*FIELDS).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [2 * spark.sparkContext.defaultParallelism] * 12
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain_enrichment(sales, changes)))


# ---------------------------------------------------------------- 12: urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for verdict, text in queries.URL_RULES:
        name, below = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below) and (best is None or len(text) > len(best[1])):
            best = verdict, text
    return best or (None, None)


URLS = [None, "", "no scheme/x", "http://", "http://Example.ORG", "http://example.org/", "https://A.example.org/es/1?x#y", "https://example.org/es", "http://notexample.org/es/1", "http://x.example.org/en/12", "http://x.example.org/en/21", "http://com/fr/", "http://a.com/de/x", "a://b://c/d", "http://h?/q", "http://ÄB.com/fr/#", "x://h#/p", "http://a.com/" + "s/" * 400, "http://a.com/fr/\nx"]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    rows = judged_urls(pages, queries.URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        host, path = plain_parts(URLS[r.page_id % len(URLS)])
        verdict, rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert judged_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert pages.select(url_parts(F.col("url"))[0].alias("h")).where("h is null").count() == 0


def test_templates(spark):
    """Hosts whose bad branch only the tree can find; numbers become wildcards, alike languages one branch."""
    rows, labels = [], []
    for k in range(600):
        rows.append((k, f"http://a.net/{('en', 'fr', 'de')[k % 3]}/{k}.html"))
        labels.append((k, 1 if k % 7 else 0))
    for k in range(600, 900):
        rows.append((k, f"http://a.net/cheap/{k}/buy/item-{k}x"))
        labels.append((k, 0)) if k % 2 else None
    rows += [(k, f"http://b.net/{k}") for k in range(900, 930)]
    labels += [(k, None) for k in range(900, 930)]
    got = {r.page_id: r for r in judged_urls(spark.createDataFrame(rows, "page_id long, url string"), (), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert {got[k].template for k in range(600)} == {"/{de|en|fr}/{#}"} and {got[k].verdict for k in range(600)} == {"allow"}
    assert {got[k].template for k in range(600, 900)} == {"/cheap/{#}/buy/{*}"} and {got[k].verdict for k in range(600, 900)} == {"block"}
    assert {(got[k].template, got[k].verdict) for k in range(900, 930)} == {("/{#}", "allow")}  # no labels: that of all hosts
    # the purity by hand: all pages, host, branch by branch
    good, n = sum(g for _, g in labels if g is not None), sum(g is not None for _, g in labels)
    p = (good + 1) / (n + 1)
    for _ in range(1):
        p = (good + 10 * p) / (n + 10)  # host a.net has all labels
    for _ in range(4):
        p = (0 + 10 * p) / (150 + 10)
    assert got[601].purity == pytest.approx(p)


def plain_templates(rows):
    """rows (host, path, good or None): templates and purities, level by level with dictionaries."""
    parts = [[s for s in p.split("/") if s] for _, p, _ in rows]
    names = [""] * len(rows)
    number = re.compile(url_templates.NUMBER)
    for k in range(min(max(map(len, parts), default=0), url_templates.DEPTH)):
        seen = {}
        for i, (host, _, good) in enumerate(rows):
            if len(parts[i]) > k:
                x = seen.setdefault((host, names[i]), {}).setdefault(parts[i][k], [0] * 5)
                after = parts[i][k + 1] if len(parts[i]) > k + 1 else None
                for j, v in enumerate((1, after is None, after is not None and bool(number.search(after)), good or 0, good is not None)):
                    x[j] += int(v)
        kept = {b: merged([(s, *x) for s, x in c.items() if x[0] >= 5 and x[0] >= 0.02 * sum(y[0] for y in c.values())]) for b, c in seen.items()}
        for i, (host, _, _) in enumerate(rows):
            if len(parts[i]) > k:
                names[i] += "/" + kept[host, names[i]].get(parts[i][k], "{#}" if number.search(parts[i][k]) else "{*}")
    names = [n + "/**" if len(p) > url_templates.DEPTH else n for n, p in zip(names, parts)]
    sums = {}
    above = lambda n: ["/".join(n.split("/")[:j]) for j in range(1, len(n.split("/")) + 1)]
    for (host, _, good), n in zip(rows, names):
        for up in above(n) if good is not None else ():
            x = sums.setdefault((host, up), [0, 0])
            x[0], x[1] = x[0] + good, x[1] + 1
    labelled = [g for _, _, g in rows if g is not None]
    out = []
    for (host, _, _), n in zip(rows, names):
        p = (sum(labelled) + 1) / (len(labelled) + 1)
        for up in above(n):
            g, m = sums.get((host, up), (0, 0))
            p = (g + 10 * p) / (m + 10)
        out.append((n, p))
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_url_filter_query(spark, scale):
    """The whole table by a plain version."""
    where = f"/root/testdata/{scale}"
    labels = {}
    for r in spark.read.parquet(f"{where}/labels.parquet").collect():
        good = int(r.quality == 1 and r.toxic == 0)
        labels[r.doc_id] = min(good, labels.get(r.doc_id, 1))
    pages = spark.read.parquet(f"{where}/pages.parquet").select("page_id", "url").collect()
    rows = []
    for r in pages:
        host, path = plain_parts(r.url)
        m = re.search(r"([0-9]{1,18})(?:\.[a-z]+)?/?$", path)
        rows.append((host, path, labels.get(int(m[1])) if m else None))
    want = {r.page_id: (h, p, *plain_rule(h, p)[::-1], t, pure) for r, (h, p, _), (t, pure) in zip(pages, rows, plain_templates(rows))}
    got = queries.op12_url_filter(spark, where).collect()
    assert len(got) == len(want) == len(pages)
    for r in got:
        host, path, rule, verdict, template, pure = want[r.page_id]
        assert (r.host, r.path, r.rule, r.template) == (host, path, rule, template)
        assert r.purity == pytest.approx(pure) and r.verdict == (verdict or ("block" if pure < 0.5 else "allow"))


def test_merged_branches():
    same = [("a", 100, 0, 100, 90, 100), ("b", 100, 0, 100, 88, 100), ("c", 100, 0, 100, 10, 100), ("d", 100, 100, 0, 90, 100)]
    assert merged(same) == {"a": "{a|b}", "b": "{a|b}", "c": "c", "d": "d"}


# ---------------------------------------------------------------- 13: runs


def plain_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            s = w[i : i + length]
            if length >= max(least, 2 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of():
    rng = random.Random(3)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        if w and rng.random() < 0.5:
            p, s = rng.randint(1, 9), rng.randrange(len(w))
            w[s:] = [w[s + (i - s) % p] for i in range(s, len(w))]
        for least in (1, 12):
            assert list(zip(*(x.tolist() for x in runs_of(np.array(w, np.int64), least)))) == plain_runs(w, least)
    a, b = [0], [0, 1]  # no word is richer in runs
    while len(b) < 300:
        a, b = b, b + a
    assert list(zip(*(x.tolist() for x in runs_of(np.array(b)))))== plain_runs(b)
    for unit in ([5], [1, 2, 3], list(range(999))):
        start, length, period = runs_of(np.array(unit * (30_000 // len(unit))))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [30_000 // len(unit) * len(unit)], [len(unit)])


def test_periodic_runs(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "é " * 40, "a b " * 6 + "c", " ".join("xy z".split() * 9), "lo\x0bng\x0cer " * 14]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(120)]
    texts += ["w " * 30_000, " ".join(f"u{k}" for k in range(20_000))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, "one", 2), (None, "q " * 12, 3)], "doc_id long, text string, runs long")
    got = periodic_runs(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "q " * 12 if r.doc_id is None else texts[r.doc_id]
        w = (text or "").encode().split()
        if len(w) > 1000:
            assert [tuple(x) for x in r.runs] == ([(0, 30_000, 1)] if w[0] == w[1] else [])
            continue
        want = plain_runs(w)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    assert periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query(spark, sf):
    """The whole small table by a plain version, but for runs of long texts, which the SQL covers."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op13_periodic_runs(spark, sf).collect():
        w = (docs[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        want = plain_runs(w)
        top = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
