"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of both parts.

Items are indexed by words: impacts are BM25 weights divided by the item's score for itself, so that
a score is the share of an item's weight that a passage holds. Items stand in blocks of BLOCK; each term
has its largest impact in the index and in each block. Every document is cut into passages of two
half-windows, half a window as long as the longest item. A passage is skipped if the sum of its terms'
largest impacts stays below the threshold; of the rest, only blocks whose block maxima reach it are
scored. All items at or above the threshold are retrieved and verified on the whole document: the
word trigrams of the item's question (all but its last sentence) and of its answer must both be there
(a part of one or two words is one gram).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared

BLOCK = 8
K1, B = 1.2, 0.75
#: bytes of item text in one index; larger benchmarks are searched in several parts of about this size
INDEX_BYTES = 32 << 20
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _tokens(column: pa.Array):
    """(lo, hi, hashes, row) of the words (runs of letters and digits, lower-cased) of each chunk."""
    kind = kernels.LETTERS.copy()
    kind[48:58] = True
    for lo, hi, data, offs in kernels.chunks(column):
        data = kernels.lowered(data)
        starts, ends, row = kernels.words(data, offs, kind)
        yield lo, hi, kernels.span_hashes(data, starts, ends, lower=False), row


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer; of one sentence, the last third of the words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n", text) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 3)
    return " ".join(w[:cut]), " ".join(w[cut:])


def _csr(term, other, value, terms):
    order = np.lexsort((other, term))
    return np.searchsorted(term[order], np.arange(terms + 1)), other[order], value[order]


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray
    top: np.ndarray
    postings: tuple
    blocks: tuple
    half: int
    parts: list


@dataclass
class Totals:
    """What the weights take from all items, however many indexes these are dealt to: document frequencies by word
    hash (sorted), the number of items, their mean and their greatest length."""

    terms: np.ndarray
    df: np.ndarray
    items: int
    mean: float
    longest: int


def build_index(items: list[tuple[int, str]], totals: Totals | None = None) -> Index | None:
    """None if no item has a word. Without totals, these items are all there are."""
    hashes, row = [], []
    for lo, _, h, r in _tokens(pa.array([t for _, t in items], pa.large_string())):
        hashes.append(h)
        row.append(r + lo)
    if not hashes or not sum(map(len, hashes)):
        return None
    hashes, row = np.concatenate(hashes), np.concatenate(row)
    terms, inv = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(inv * len(items) + row, return_counts=True)
    term, item = pair // len(items), pair % len(items)
    length = np.bincount(row, minlength=len(items))
    if totals is None:
        totals = Totals(terms, np.bincount(term, minlength=len(terms)), len(items), float(length.mean()), int(length.max()))
    df = totals.df[np.searchsorted(totals.terms, terms)]
    idf = np.log(1 + (totals.items - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(1.0, totals.mean)))
    weight /= np.bincount(item, weight, minlength=len(items))[item]
    top = np.zeros(len(terms))
    np.maximum.at(top, term, weight)
    blocks = -(-len(items) // BLOCK)
    by, inv = np.unique(term * blocks + item // BLOCK, return_inverse=True)
    peak = np.zeros(len(by))
    np.maximum.at(peak, inv, weight)

    def grams(texts):
        out = [(0, np.zeros(0, np.uint64))] * len(texts)
        for lo, _, h, r in _tokens(pa.array(texts, pa.large_string())):
            for k in np.unique(r):
                own = h[r == k]
                width = min(3, len(own))
                out[lo + k] = width, np.unique(kernels.shingles(own, np.zeros(len(own), np.int64), width)[0])
        return out

    split = [split_item(t) for _, t in items]
    parts = list(zip(grams([q for q, _ in split]), grams([a for _, a in split])))
    return Index(np.array([i for i, _ in items], np.int64), terms, top, _csr(term, item, weight, len(terms)), _csr(by // blocks, by % blocks, peak, len(terms)), totals.longest, parts)


def _expand(csr, term):
    """Places in a CSR of all entries of each term, and which of the terms each belongs to."""
    start, stop = csr[0][term], csr[0][term + 1]
    n = stop - start
    flat = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return flat, np.repeat(np.arange(len(term)), n)


def retrieve(index: Index, hashes: np.ndarray, row: np.ndarray, threshold: float):
    """(row, item, score) for all items at or above the threshold in any passage of the row."""
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = index.terms[at] == hashes
    if not hit.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    first = np.searchsorted(row, row)
    half = (np.arange(len(row)) - first) // index.half  # number of the half-window in its row
    # passage h of a row joins halves h and h + 1; halves are numbered through, with a gap between rows
    base = np.concatenate([[0], np.cumsum(np.bincount(row) // index.half + 2)])[row]
    place = (base + half)[hit]
    packed = np.unique(place * len(index.terms) + at[hit])
    place, term = packed // len(index.terms), packed % len(index.terms)
    size = int(place[-1]) + 2
    upper = np.bincount(place, index.top[term], minlength=size)
    alive = upper + np.append(upper[1:], 0) >= threshold
    row_of = np.zeros(size, np.int64)
    row_of[(base + half)[hit]] = row[hit]
    keep = alive[place] | np.append(False, alive[:-1])[place]
    place, term = place[keep], term[keep]
    # each term once in each passage that is alive and holds it
    own = np.concatenate([place[alive[place]], place[alive[place - 1] & (place > 0)] - 1])
    term = np.concatenate([term[alive[place]], term[alive[place - 1] & (place > 0)]])
    packed = np.unique(own * len(index.terms) + term)
    own, term = packed // len(index.terms), packed % len(index.terms)
    blocks = int(index.blocks[1].max()) + 1
    rows, items, scores = [], [], []
    for lo in range(0, len(own), 200_000):
        # whole passages only
        a = lo if lo == 0 else int(np.searchsorted(own, own[lo - 1], side="right"))
        z = len(own) if lo + 200_000 >= len(own) else int(np.searchsorted(own, own[lo + 200_000 - 1], side="right"))
        if a >= z:
            continue
        o, t = own[a:z], term[a:z]
        flat, which = _expand(index.blocks, t)
        key, inv = np.unique(o[which] * blocks + index.blocks[1][flat], return_inverse=True)
        good = key[np.bincount(inv, index.blocks[2][flat]) >= threshold]
        if not len(good):
            continue
        sel = np.isin(o, good // blocks)
        o, t = o[sel], t[sel]
        flat, which = _expand(index.postings, t)
        item, o = index.postings[1][flat], o[which]
        sel = np.isin(o * blocks + item // BLOCK, good)
        key, inv = np.unique(o[sel] * len(index.ids) + item[sel], return_inverse=True)
        score = np.bincount(inv, index.postings[2][flat[sel]])
        ok = score >= threshold
        passage = key[ok] // len(index.ids)
        # a passage's row is that of either half
        r = np.maximum(row_of[passage], row_of[passage + 1])
        rows.append(r)
        items.append(key[ok] % len(index.ids))
        scores.append(score[ok])
    if not rows:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    rows, items, scores = map(np.concatenate, (rows, items, scores))
    key, inv = np.unique(rows * len(index.ids) + items, return_inverse=True)
    best = np.zeros(len(key))
    np.maximum.at(best, inv, scores)
    return key // len(index.ids), key % len(index.ids), best


def _matches(index: Index, column: pa.Array, threshold: float, overlap: float):
    """(row, item, score, question overlap, answer overlap) of verified matches of a text column."""
    out = []
    for lo, hi, hashes, row in _tokens(column):
        rows, items, scores = retrieve(index, hashes, row, threshold)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in np.unique(rows):
            own = hashes[bounds[r] : bounds[r + 1]]
            grams = {w: np.unique(kernels.shingles(own, np.zeros(len(own), np.int64), w)[0]) for w in (1, 2, 3)}
            for k in np.flatnonzero(rows == r):
                q, a = (float(np.isin(p, grams[w]).mean()) if w else 1.0 for w, p in index.parts[items[k]])
                if q >= overlap and a >= overlap:
                    out.append((lo + int(r), int(index.ids[items[k]]), float(scores[k]), q, a))
    return out


def _item_terms(batches):
    """For each item, its part, its number of words and its different ones."""
    for b in batches:
        part = b.column(0)
        for lo, hi, h, r in _tokens(b.column(1)):
            cut = np.searchsorted(r, np.arange(hi - lo + 1))
            terms = [np.unique(h[cut[k] : cut[k + 1]]).view(np.int64) for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([part.slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(terms, pa.list_(pa.int64()))], names=["part", "n", "terms"])


def _indexes(items: DataFrame, id_col: str, text_col: str):
    """Broadcast indexes over parts of the items, each of about INDEX_BYTES of text at most; all weigh by the same totals."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // INDEX_BYTES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    if parts > 1:
        words = shared.written(rows.select("part", "text").mapInArrow(_item_terms, "part int, n long, terms array<long>"))
        n_items, mean, longest = words.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
        df = shared.written(words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for k in range(parts):
        part = rows.where(F.col("part") == k).orderBy("item_id", "text").collect()
        totals = None
        if parts > 1:
            own = words.where(F.col("part") == k).select(F.explode("terms").alias("term")).distinct()
            own = own.join(df, "term").collect()  # the words of one part
            terms, counts = np.array([r.term for r in own], np.int64).view(np.uint64), np.array([r.df for r in own], np.int64)
            order = np.argsort(terms)
            totals = Totals(terms[order], counts[order], n_items, float(mean), int(longest))
        index = build_index([(r.item_id, r.text) for r in part], totals) if part else None
        if index is not None:
            yield shared.Shipped(items.sparkSession, index)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document row and item found.

    Null and empty texts and items match nothing; nor do items without words. Rows with a null doc_id
    keep it. Repeated rows give repeated matches. Empty tables give an empty result.
    """
    rows = shared.ids_and_texts(docs, id_col, text_col)
    out = None
    for index in _indexes(items, item_id, item_text):

        def run(batches, index=index):
            for b in batches:
                found = _matches(index.value, b.column(1), threshold, overlap)
                if found:
                    ids = b.column(0).to_pylist()
                    yield shared.batch(_MATCH, [ids[f[0]] for f in found], *([f[k] for f in found] for k in range(1, 5)))

        got = rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = got if out is None else out.unionAll(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """docs' rows that match no item, with the same columns; no shuffle."""
    place = docs.columns.index(text_col)
    for index in _indexes(items, item_id, item_text):

        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in _matches(index.value, b.column(place), threshold, overlap)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
