"""Suffix-array dedup of exact repeats: induced sorting and permuted common prefixes, shard by shard.

Any `window` bytes that occur twice have the same content everywhere, so the smallest keyed hash of their
GRAM-byte grams (their anchor) is the same too. Every start of a window belongs to one anchor occurrence;
a run of starts with one anchor, with the bytes their windows cover, is a segment.

1. All segments are listed by anchor, without text. Segments with equal bytes and another copy
   repeat throughout; where an anchor has different segments, those go on, each once, that share the
   bytes on one side of it with another (two segments that share a window do).
2. Those segments' bytes are fetched, dealt to shards by anchor, and each shard's suffix array is made:
   suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by induction, named and
   sorted recursively, and induce the order of all suffixes. Induction goes bucket by bucket, a whole
   bucket's wave at a time. Below the first level, where alphabets are large, names are ranked by
   doubling, up to the window: suffixes that agree that far need no further order.
3. Permuted common prefixes: a suffix's common prefix with the one before it in the array is measured
   only where the letters in front differ; elsewhere it is one less than its left neighbour's. A start
   whose common prefix with a neighbour reaches the window is repeated.
4. Each document's repeated starts are joined to its text, and the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .families import having, having_any, in_filter, members

WINDOW, GRAM = 400, 32
#: segments of one anchor that are sorted together; more are dealt to several shards in pairs of groups
GROUP = 4096
#: bits of a packed gram that hold its place in the chunk
_PLACE = 20
_GAP = 255  # never a byte of UTF-8

_SEGMENT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("count", pa.int32())])
_BYTES = pa.schema([("content", pa.int64()), ("bytes", pa.binary())])


# suffix arrays


def _induce(text, kind, heads, tails, lms):
    """All suffixes in the order that sorted LMS places induce (kind: True for S-type)."""
    n, sigma = len(text), len(heads)
    sa = np.full(n, -1, np.int64)
    order = np.argsort(text[lms], kind="stable")  # within its bucket each keeps its place
    chars = text[lms][order]
    from_end = np.searchsorted(chars, chars, side="right") - np.arange(len(chars))
    sa[tails[chars] - from_end] = lms[order]
    at = heads.copy()

    def put_l(places):
        prev = places - 1
        prev = prev[prev >= 0]
        prev = prev[~kind[prev]]
        if len(prev):
            c = text[prev]
            o = np.argsort(c, kind="stable")
            c, prev = c[o], prev[o]
            spot = at[c] + np.arange(len(c)) - np.searchsorted(c, c)
            sa[spot] = prev
            b = kernels.unique_spans(c)
            at[c[b[:-1]]] += np.diff(b)

    put_l(np.array([n]))  # the end of the text comes before all
    for c in range(sigma):
        done = heads[c]
        while done < at[c]:  # L-type suffixes of this bucket, a wave at a time
            upto = at[c]
            put_l(sa[done:upto])
            done = upto
        s = sa[at[c] : tails[c]]
        put_l(s[s >= 0])
    # S-type, from the right; LMS entries are placed anew
    at = tails.copy()
    split = heads + np.bincount(text[~kind], minlength=sigma)
    for c in range(sigma):
        sa[split[c] : tails[c]] = -1

    def put_s(places):
        prev = places - 1
        prev = prev[prev >= 0]
        prev = prev[kind[prev]]
        if len(prev):
            c = text[prev]
            o = np.argsort(c, kind="stable")
            c, prev = c[o], prev[o]
            spot = at[c] - 1 - (np.arange(len(c)) - np.searchsorted(c, c))
            sa[spot] = prev
            b = kernels.unique_spans(c)
            at[c[b[:-1]]] -= np.diff(b)

    for c in range(sigma - 1, -1, -1):
        done = tails[c]
        while done > at[c]:
            upto = at[c]
            put_s(sa[upto:done][::-1])
            done = upto
        put_s(sa[heads[c] : split[c]][::-1])
    return sa


def _rank_names(names: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of the suffixes of a name string by doubling, until they differ or agree over reach names."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < reach and rank.max(initial=0) + 1 < n:
        key = rank * (n + 1) + np.append(rank[step:] + 1, np.zeros(min(step, n), np.int64))[:n]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def suffix_array(text: np.ndarray, reach: int = 1 << 62) -> np.ndarray:
    """Places of all suffixes in order; suffixes that agree over reach letters may stand in any order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    # S-type: smaller than the next suffix; a run of equal letters has the type of its end
    smaller = text[:-1] < text[1:]
    differ = np.flatnonzero(text[:-1] != text[1:])
    kind = np.zeros(n, bool)
    if len(differ):
        nxt = np.searchsorted(differ, np.arange(n - 1))
        ok = nxt < len(differ)
        kind[:-1][ok] = smaller[differ[nxt[ok]]]
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    sigma = int(text.max()) + 1
    size = np.bincount(text, minlength=sigma)
    tails = np.cumsum(size)
    heads = tails - size
    if len(lms) < 2:
        return _induce(text, kind, heads, tails, lms)
    rough = _induce(text, kind, heads, tails, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    # names: neighbours are equal if their LMS substrings are
    length = np.diff(np.append(lms, n)) + 1
    length[-1] = n - lms[-1]
    of = np.empty(n, np.int64)
    of[lms] = np.arange(len(lms))
    a, b = order[:-1], order[1:]
    la, lb = length[of[a]], length[of[b]]
    same = (la == lb) & (a + la <= n) & (b + lb <= n)
    same &= ~((of[a] == len(lms) - 1) | (of[b] == len(lms) - 1))
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[k < la[live]]
        differs = (text[a[live] + k] != text[b[live] + k]) | (kind[a[live] + k] != kind[b[live] + k])
        same[live[differs]] = False
        live = live[~differs]
        k += 1
    name = np.empty(len(lms), np.int64)
    name[of[order]] = np.concatenate([[0], np.cumsum(~same)])
    if name.max() + 1 < len(lms):
        few = name.max() < 4096 and len(lms) > 1 << 14
        if few:
            inner = suffix_array(name, reach)
            rank = np.empty(len(lms), np.int64)
            rank[inner] = np.arange(len(lms))
        else:
            rank = _rank_names(name, min(reach, len(lms)))
        order = lms[np.argsort(rank, kind="stable")]
    return _induce(text, kind, heads, tails, order)


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes: for each place, the common prefix with the suffix before it in sa, up to cap."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    irreducible = phi < 0
    irreducible[0] = True
    inner = place[1:]
    before = phi[1:]
    follows = (before > 0) & (phi[inner - 1] >= 0)
    follows[follows] &= text[inner[follows] - 1] == text[before[follows] - 1]
    irreducible[1:] |= ~follows
    value = np.zeros(n, np.int64)
    live = place[irreducible & (phi >= 0)]
    data = np.concatenate([text.astype(np.uint8), np.zeros(1 << 12, np.uint8)])
    length, width = 0, 16
    while len(live):
        a, b = live + length, phi[live] + length
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        full = np.zeros(len(live), bool)
        cols = np.arange(width)
        for lo in range(0, len(live), (1 << 22) // width):
            x, y = a[lo : lo + (1 << 22) // width, None] + cols, b[lo : lo + (1 << 22) // width, None] + cols
            same = (data[x] == data[y]) & (x < n) & (y < n)
            run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            value[live[lo : lo + len(run)]] += run
            full[lo : lo + len(run)] = run == width
        live = live[full]
        length += width
        width = min(1 << 12, width * 2)
    # reducible: one less than the left neighbour; the first irreducible place to the left decides
    source = np.maximum.accumulate(np.where(irreducible, place, 0))
    return np.minimum(np.maximum(value[source] - (place - source), 0), cap)


def repeated_starts(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment, whether the window at each start occurs elsewhere in these segments."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(bytes([_GAP]).join(segments) + bytes([_GAP]), np.uint8)
    sa = suffix_array(text, window)
    lcp = common_prefixes(text, sa, window)
    hit = lcp >= window
    after = np.zeros(len(text), bool)
    after[sa[:-1]] = hit[sa[1:]]
    hit |= after
    start = np.cumsum(sizes + 1) - sizes - 1
    return [hit[s : s + max(0, n - window + 1)] for s, n in zip(start, sizes)]


# segments


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from block-wise running minima."""
    n = len(values) - width + 1
    pad = -len(values) % width
    full = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """Row, first start, number of starts, place of the anchor and its hash of each segment of a chunk.

    The anchor is the smallest gram hash of a window (without its last _PLACE bits, which hold a gram's
    place and part runs of different occurrences); no segment covers more than twice the window.
    """
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < window:
        return none
    grams = kernels.window_hashes(data, gram)
    low = np.uint64((1 << _PLACE) - 1)
    grams &= ~low
    grams |= np.arange(len(grams), dtype=np.uint64) & low
    least = _sliding_min(grams, window - gram + 1)
    valid = np.zeros(len(data) + 1, np.int8)  # starts of windows inside one row
    long = np.diff(offs) >= window
    valid[offs[:-1][long]] = 1
    valid[offs[1:][long] - window + 1] = -1
    at = np.flatnonzero(np.cumsum(valid[: len(least)], dtype=np.int8))
    if not len(at):
        return none
    anchor = least[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    begin = at[first]
    row = np.searchsorted(offs, begin, side="right") - 1
    place = begin + (((anchor[first] & low).astype(np.int64) - begin) & ((1 << _PLACE) - 1))
    own = anchor[first] >> np.uint64(_PLACE)
    return row, begin - offs[row], count, place, own.view(np.int64)


def sides(data, begin, count, place, window, gram):
    """Hashes of the bytes to the left and to the right of each segment's anchor, anchor included; 0 where the segment ends before.

    A window spans its anchor and so at least half of (window - gram) bytes on one side of it. Segments that share
    a window therefore share the hash of a side.
    """
    half = (window - gram) // 2
    out = []
    for lo, hi, salt in ((place - half, place + gram, 1), (place, place + gram + half, 2)):
        inside = np.flatnonzero((lo >= begin) & (hi <= begin + count - 1 + window))
        h = np.zeros(len(begin), np.uint64)
        h[inside] = kernels.mix(kernels.span_hashes(data, lo[inside], hi[inside], lower=False) + np.uint64(salt)) | np.uint64(1)
        out.append(h.view(np.int64))
    return out


def _contents(data, begin, count, window):
    return kernels.span_hashes(data, begin, begin + count - 1 + window, lower=False).view(np.int64)


def _list(window, gram):
    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi, data, offs in kernels.chunks(b.column(1), limit=1 << 18, rows=1 << 30):
                row, start, count, place, anchor = segments(data, offs, window, gram)
                if len(row):
                    begin = offs[row] + start
                    left, right = sides(data, begin, count, place, window, gram)
                    yield shared.batch(_SEGMENT, anchor, _contents(data, begin, count, window), left, right, keys[lo + row], start, count.astype(np.int32))

    return run


def _fetch(window, gram, wanted):
    """The bytes of wanted contents, from rows that hold one of them."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in kernels.chunks(b.column(0), limit=1 << 18, rows=1 << 30):
                row, start, count, _, _ = segments(data, offs, window, gram)
                if not len(row):
                    continue
                begin = offs[row] + start
                content = _contents(data, begin, count, window)
                hit = np.flatnonzero(in_filter(content, wanted.value))
                if len(hit):
                    hit = hit[np.unique(content[hit], return_index=True)[1]]
                    yield shared.batch(_BYTES, content[hit], [data[s : s + c - 1 + window].tobytes() for s, c in zip(begin[hit], count[hit])])

    return run


def _sort_shard(window):
    def run(batches):
        """Rows of a task: anchor, group pair, content, bytes. Shards are filled with whole (anchor, i, j) groups."""
        held, size = {}, 0

        def flush():
            keys = list(held)
            texts = [held[k] for k in keys]
            hits = repeated_starts(texts, window)
            some = [k for k, h in enumerate(hits) if h.any()]
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.int64()), pa.array([np.packbits(hits[k]).tobytes() for k in some], pa.binary())], names=["content", "hits"])

        group = None
        for b in batches:
            for anchor, i, j, content, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (anchor, i, j) != group and size > 1 << 20:
                    yield flush()
                    held, size = {}, 0
                group = (anchor, i, j)
                if content not in held:
                    held[content] = raw
                    size += len(raw)
        if held:
            yield flush()

    return run


def _remove(window):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def covered(size, starts, counts, hits):
        """Which bytes the windows at repeated starts cover."""
        first, last = [], []  # runs of repeated starts
        for s, c, h in zip(starts, counts, hits):
            if h is None:
                first.append([s])
                last.append([s + c])
            else:
                edge = np.diff(np.unpackbits(np.frombuffer(h, np.uint8))[:c].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                first.append(s + np.flatnonzero(edge > 0))
                last.append(s + np.flatnonzero(edge < 0))
        edge = np.zeros(size + 2, np.int32)
        np.add.at(edge, np.concatenate(first), 1)
        np.add.at(edge, np.concatenate(last) - 1 + window, -1)
        return np.cumsum(edge[:size]) > 0

    def run(batches):
        for b in batches:
            data, offs = kernels.raw(b.column(1))
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                out = [[] for _ in range(5)]
                lists = zip(*(part.column(c).to_pylist() for c in (2, 3, 4))) if part.num_columns > 2 else [(None, None, None)] * part.num_rows
                for k, (starts, counts, hits) in enumerate(lists, lo):
                    text = data[offs[k] : offs[k + 1]]
                    removed = spans = 0
                    if starts:
                        gone = covered(len(text), starts, counts, hits)
                        removed, spans = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                        text = text[~gone]
                    kept = text.tobytes()
                    for column, value in zip(out, (int(offs[k + 1] - offs[k]), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
                        column.append(value)
                yield shared.batch(schema, part.column(0), *out)

    return run


@shared.call
def repeats(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(row_key, s): for each text of (row_key, text) with repeated windows, the segments (start, count, hits) that hold their starts; hits is a bit for each start, null for all."""
    parts = shared.partitions(keyed.sparkSession)
    found = shared.written(keyed.select("row_key", "text").mapInArrow(_list(window, gram), "anchor long, content long, left long, right long, row_key long, start long, count int"))

    contents = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"), F.max("right").alias("right"), F.min("row_key").alias("one"))
    anchors = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where("n > 1")
    contents = shared.written(contents.join(anchors.select("anchor", "kinds"), "anchor"))
    # of the contents of an anchor, those that may share a window with another one
    several = contents.where("kinds > 1")
    side = several.select(F.explode(F.array("left", "right")).alias("side")).where("side <> 0")
    filter_ = members(side.groupBy("side").count().where("count > 1"), "side")
    mixed = having_any(several, ("left", "right"), filter_)
    sizes = mixed.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    mixed = shared.written(mixed.select("anchor", "content", "one").join(sizes, "anchor"))
    rows = having(keyed.select("text", "row_key"), "row_key", members(mixed, "one"))
    raw = rows.mapInArrow(_fetch(window, gram, members(mixed, "content")), "content long, bytes binary").dropDuplicates(["content"])
    b = F.pmod(F.xxhash64("content"), F.col("groups")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda o: F.struct(F.least(b, o).alias("i"), F.greatest(b, o).alias("j")))
    shards = mixed.join(raw, "content").select("anchor", F.explode(pairs).alias("p"), "content", "bytes").select("anchor", "p.i", "p.j", "content", "bytes")
    shards = shards.repartition(parts, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    hits = shared.written(shards.mapInArrow(_sort_shard(window), "content long, hits binary"))
    whole = contents.where("n > 1").select("content", F.lit(None).cast("binary").alias("hits"))
    partly = hits.join(whole.select("content"), "content", "left_anti")
    marks = shared.written(whole.unionAll(partly))

    spans = having(found.select("content", "row_key", "start", "count"), "content", members(marks, "content")).join(marks, "content")
    return shared.lasting(spans.groupBy("row_key").agg(F.collect_set(F.struct("start", "count", "hits")).alias("s")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Each byte covered by `window` bytes that also start anywhere else (in the same document too) is
    removed; matches never cross documents and are judged on the input. Null and empty texts have no
    bytes; texts below the window stay. Repeated rows and ids are separate documents, also with null ids.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal (id, text) rows share a key, and the segments found under it
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("text"))
    keyed = rows.select(key.alias("row_key"), "text", "doc_id")
    spans = repeats(keyed, window, gram)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    some = members(spans, "row_key")  # the other rows stay as they are, and where they are
    alone = having(keyed, "row_key", some, others=True).select("doc_id", "text").mapInArrow(_remove(window), out)
    joined = having(keyed, "row_key", some).join(spans, "row_key", "left").select("doc_id", "text", F.col("s.start").alias("starts"), F.col("s.count").alias("counts"), F.col("s.hits").alias("hits"))
    return alone.unionAll(joined.mapInArrow(_remove(window), out))
