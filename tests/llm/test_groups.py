"""Near-duplicate operators against brute force, with edge rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from prismfold.llm import embedding_dedup, families, kernels, line_dedup, ngram_join, queries, suffix_dedup
from prismfold.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 30, 60, 300)))] for _ in range(12)]
    rows, k = [], 0
    for b in base:
        for _ in range(rng.choice((1, 3, 20))):
            words = list(b)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, " ".join(words).title() if rng.random() < 0.3 else " \n".join(words)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "é É"), (None, rows[0][1]), (0, rows[0][1])]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: u.find(x) for x in u.up if u.find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_levels(spark):
    """A path, a star and a dense group dealt over many tasks, with and without the smallest node as name."""
    path = [(k, k + 1) for k in range(400)]
    star = [(5000, 6000 + k) for k in range(300)] + [(6299, 4999)]
    dense = [(a, b) for a in range(7000, 7030) for b in range(a)][-400:]
    edges = path + star + dense + [(9000, 9000)]
    random.Random(2).shuffle(edges)
    u = Union()
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    assert {r.node: r.component for r in components(df).collect()} == {x: u.find(x) for x in u.up if u.find(x) != x}
    any_name = {r.node: r.component for r in components(df, smallest=False).collect()}
    groups = {}
    for x in u.up:
        if x != 9000:
            groups.setdefault(any_name.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(x for x in u.up if u.find(x) == r) for r in {u.find(x) for x in u.up} - {9000})


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(k).count("1") + flip) & 1] for k in range(n))


def test_hashes():
    for n in (8, 512, 1024, 4096):  # strings that collide under any polynomial modulo a power of two
        both = (thue_morse(n) + thue_morse(n, 1)).encode()
        data = np.frombuffer(both, np.uint8)
        h = kernels.span_hashes(data, np.array([0, n, 0]), np.array([n, 2 * n, n]))
        assert h[0] == h[2] != h[1]
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 100, 3000)
    seen, back = {}, {}
    for s, e, h in zip(start, end, kernels.span_hashes(data, start, end, lower=False).tolist()):
        assert seen.setdefault(data[s:e].tobytes(), h) == h and back.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    for width in (4, 8, 13, 32):
        w = kernels.window_hashes(data, width)
        assert len(w) == len(data) - width + 1 and len(set(w.tolist())) == len({data[k : k + width].tobytes() for k in range(len(w))})


def test_ngram_join_long_words(spark):
    a, b = thue_morse(1024), thue_morse(1024, 1)
    rows = [(1, a), (2, b), (3, f"{a} {b} x y"), (4, f"{b} {a} x y"), (5, f"{a} {b} x y")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_exact_queries_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert set(queries.oracle_sql()) == {"op1_ngram_jaccard_join", "op6_suffix_array_dedup", "op7_embedding_near_dedup"}
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        answer = con.execute(sql)
        assert [d[0] for d in answer.description] == df.columns
        assert sorted(map(tuple, df.collect())) == sorted(answer.fetchall())


def test_ngram_join(spark, monkeypatch):
    from prismfold.llm import families

    rows = corpus()
    pattern, lower = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as fp", "0 as component_id")
    for width, percent, block, small in ((3, 90, 2048, 12), (5, 80, 4, 2)):
        monkeypatch.setattr(families, "BLOCK", block)
        monkeypatch.setattr(families, "SMALL", small)
        sets = []
        for k, (_, t) in enumerate(rows):
            w = pattern.findall((t or "").translate(lower))
            sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
        u = Union()
        ids = [i for i, _ in rows if i is not None]
        for i in ids:
            u.find(i)
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    u.join(rows[a][0], rows[b][0])
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, width=width, percent=percent).collect()), key=repr)
        assert got == sorted(((i, len(s), None if i is None else u.find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((5, 25, 80)))) for _ in range(25)]
    rows = []
    for k in range(40):
        own = [rng.choice(lines) for _ in range(rng.randint(0, 6))]
        own = [x if rng.random() < 0.8 else x[:-1] + "Z" for x in own]
        rows.append((k, "\n".join(own)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "é" * 30 + "\n" + "é" * 30), (None, lines[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as drop", "2 as n_lines")
    first = {}
    for i, t in rows:
        if i is not None:
            for n, x in enumerate((t or "").split("\n")):
                if len(x) >= 20:
                    first.setdefault(x, (i, n))
    u, keys = Union(), list(first)
    sets = {x: {x[j : j + 8] for j in range(len(x) - 7)} for x in keys}
    for a in keys:
        for b in keys:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    stays = {}
    for x in keys:
        stays[u.find(x)] = min(stays.get(u.find(x), (1 << 60, 0)), first[x])
    want = {i: None if t is None else t if i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(x) < 20 or stays[u.find(x)] == (i, n)) for i, t in rows}
    got = line_dedup.dedup_lines(df, min_chars=20)
    assert got.columns == ["doc_id", "text", "drop", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines(spark, tmp_path):
    rows = [(1, "Les.\n\na line that is long enough\n \nEnd", "u"), (2, "Les.\n\nOf, edti oner.\n \nunlike", "u"), (3, "Of, edti oner.\nLes.\nown 3\né\né\nLes", "u"), (4, "Of, edti onera.\nlast", "u"), (5, "and ten short ones\nand ten short one", "u")]
    want = {1: rows[0][1], 2: "\nOf, edti oner.\n \nunlike", 3: "own 3\né\nLes", 4: rows[3][1], 5: "and ten short ones"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("x")).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op5_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {k: hashlib.sha256(x.encode()).hexdigest() for k, x in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.first_lines(spark, docs, str(tmp_path)).collect()} == want


def test_line_dedup_odd_rows(spark):
    rows = [(7, "same line\nsame line\nown"), (7, "same line\nsame line\nown"), (3, "\n\nsame line"), (None, "same line"), (4, None), (5, "x" * 200_000 + "\n" + "x" * 200_000), (6, "y\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("n", F.lit(2))
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()), key=repr)
        spark.conf.unset("spark.sql.ansi.enabled")
        # rows that share an id share their line numbers: line 0 is a copy of document 3's, line 2 is kept by both
        assert got == sorted([(7, "own", 3, 2), (7, "own", 3, 2), (3, rows[2][1], 3, 0), (None, "same line", 1, 0), (4, None, 0, 0), (5, "x" * 200_000, 2, 1), (6, "y\n", 3001, 2999)], key=repr)
    assert line_dedup.dedup_lines(df.where("doc_id = 4")).count() == 1


def test_line_dedup_recall():
    """Of pairs at a similarity of 0.8 to 0.9, the bands find nearly all."""
    rng = random.Random(8)
    found = tried = 0
    for _ in range(600):
        a = "".join(rng.choice("abcdefghijklmno ") for _ in range(rng.randint(40, 300)))
        at = rng.randrange(len(a))
        b = a[:at] + rng.choice("XYZ") * rng.randint(1, 4) + a[at:]
        x, y = ({s[k : k + 8] for k in range(len(s) - 7)} for s in (a, b))
        if not 0.8 <= len(x & y) / len(x | y) < 0.9:
            continue
        data = np.frombuffer((a + "\n" + b).encode(), np.uint8)
        start, end = np.array([0, len(a) + 1]), np.array([len(a), len(data)])
        h, line = line_dedup.char_shingles(data, start, end, 8)
        keys = line_dedup.band_keys(line_dedup.signatures(h, line, 2, 70), 14, 5)
        tried += 1
        found += bool((keys[0] == keys[1]).any())
    assert tried > 100 and found / tried > 0.98


def test_char_shingles():
    text = "short\nplain line of letters\nélan ünd größe 日本語 テスト🙂 end\nab"
    data = np.frombuffer(text.encode(), np.uint8)
    row, no, start, end = line_dedup.split_lines(data, np.array([0, len(data)]))
    assert no.tolist() == [0, 1, 2, 3] and [data[s:e].tobytes().decode() for s, e in zip(start, end)] == text.split("\n")
    h, line = line_dedup.char_shingles(data, start, end, 8)
    for k, x in enumerate(text.split("\n")):
        assert len(set(h[line == k].tolist())) == len({x[j : j + 8] for j in range(max(1, len(x) - 7))})


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        raw = t.tobytes()
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(t, sa, 1000)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while max(a, b) + n < len(t) and raw[a + n] == raw[b + n]:
                n += 1
            assert lcp[b] == n


def test_suffix_dedup(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abc é") for _ in range(700))
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(1, own(50) + passage + own(90)), (2, passage[100:] + own(500)), (3, own(900)), (4, "xy" * 600), (5, None), (6, ""), (7, "short"), (7, "short"), (8, "q" * 400), (9, "q" * 401), (None, passage[:450]), (10, own(30) + passage[:399])]
    window, texts = 400, [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] = seen.get(t[k : k + window], 0) + 1
    want = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as content")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=repr) == sorted(((*w[:5], bytearray(w[5])) for w in want), key=repr)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 24))
    vectors = [base[rng.integers(6)] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.15, 0.3]) for _ in range(90)]
    rows = [(k, [float(np.float32(x)) for x in v], k % 2) for k, v in enumerate(vectors)]
    rows += [(100, None, 0), (101, [0.0] * 24, 0), (102, [None] * 24, 0), (103, [float("nan")] * 24, 0), (104, rows[0][1], None), (None, rows[0][1], 0), (105, [1.0], 0), (106, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n")
    x = np.array([r[1] for r in rows[:90]])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    u, links = Union(), dict.fromkeys(range(90), 0)
    for a in range(90):
        u.find(a)
        for b in range(a):
            if a % 2 == b % 2 and cos[a, b] >= 0.98:
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert sum(links.values()) > 50
    assert got == {**{k: (links[k], u.find(k), u.find(k) == k) for k in range(90)}, **{k: (0, k, True) for k in range(100, 107)}, None: (0, None, False)}


def test_embeddings_of_any_magnitude(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 0.0], 0), (4, [1e-200, 0.0], 0), (5, [5e-324, 0.0], 0), (6, [1.0, 1.0], 0), (6, [1.0, 1.0], 0)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(1, 3, 1), (2, 3, 1), (3, 2, 3), (4, 2, 3), (5, 2, 3), (6, 4, 1)}


def test_quantisation_bound():
    x = np.random.default_rng(0).normal(size=(40, 30))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, b, e = embedding_dedup.quantised(x)
    approx = (q.astype(float) @ q.astype(float).T) * np.outer(s, s)
    assert (np.abs(x @ x.T - approx) <= b[:, None] * e + e[:, None] * (b + e) + 1e-12).all()
    assert kernels.forest(np.array([5, 4, 9]), np.array([4, 3, 8]))[1].tolist() == [3, 3, 8]


def test_loose_families_are_split_first(spark, monkeypatch):
    """Unlike lines that bands chain to one family are not compared with each other, and no link is lost."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))) for _ in range(240)]
    lines += [s + rng.choice([" x", " yz", ""]) + "!" * k for s in lines[:12] for k in (1, 2, 3)]
    lines = sorted(set(lines))
    rng.shuffle(lines)
    rows, verify = spark.sparkContext.accumulator(0), families._verify

    def counted(*args):
        run = verify(*args)

        def each(batches):
            def seen():
                for b in batches:
                    rows.add(b.num_rows)
                    yield b

            return run(seen())

        return each

    monkeypatch.setattr(families, "_verify", counted)
    monkeypatch.setattr(families, "BLOCK", 16)
    monkeypatch.setattr(families, "LOOSE", 16, raising=False)
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dropped_lines(docs, bands=70, rows=1).collect()}  # one row a band: nearly all lines in one family
    sets, u = [{s[k : k + 8] for k in range(len(s) - 7)} for s in lines], Union()
    for a in range(len(lines)):
        u.find(a)
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u.join(a, b)
    assert got == {k for k in range(len(lines)) if u.find(k) != k} and len(got) > 20
    assert 0 < rows.value < len(lines), rows.value


def test_large_buckets_and_groups_lose_no_link():
    """Pairs that are connected already are skipped, others are not: the components are those of all pairs."""
    rng = np.random.default_rng(7)
    sets = []
    for k in range(200):
        base = sets[rng.integers(k)] if k > 9 and k % 3 == 0 else set(rng.integers(0, 400, rng.integers(5, 60)).tolist())
        sets.append(set(list(base)[rng.integers(0, 3) :]) | set(rng.integers(0, 400, rng.integers(1, 4)).tolist()))
    sets.sort(key=len)
    size, ids = np.array([len(s) for s in sets]), np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(size)])
    maps, every, group = families.parity_maps(ids, bounds), np.arange(200), rng.integers(0, 150, 200)
    same = [(int(np.flatnonzero(group == group[k])[0]), k) for k in range(200)]

    def named(pairs):
        u, v = kernels.forest(*np.array(pairs).T)
        out = np.arange(200)
        out[u] = v
        return out.tolist()

    may = [(a, b) for a in range(200) for b in range(a) if families.may_link(size[a], size[b], maps[a], maps[b], 80)]
    assert named(may + same) == named([*zip(*families._bucket_edges(size, maps, group, 80)), *same])
    for left, right in ((every, every), (every[::2], every[1::2])):
        links = [(a, b) for a in left for b in right if (a < b or left is not right) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert len(links) > 5 and named(links) == named(list(zip(*families.verified_links(size, ids, bounds, maps, [], left, right, 80))))
