"""Line dedup: MinHash of character shingles, banding, exact Jaccard, distributed union-find.

Lines that are not blank and have at least min_chars (1) code points take part. Equal lines are one node, under a
64-bit hash of their bytes. One pass makes a one-permutation MinHash signature of each distinct line's
character shingles (lines shorter than a shingle equal only themselves and need none) and deals band
keys out in packed blocks; lines that share a band are candidates. Families of candidates fetch their
texts and are verified exactly (all pairs of a family whose sizes and parity maps allow the threshold,
except where both ends are connected). Another pass lists the places of all lines: a task's later places of
a line go at once, its first ones meet by line, so that no line sends more than a row for each lot of a task. In each
component of links the line with the smallest (doc_id, line number) stays, all others go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .families import having, in_filter, members, verified_components

_LISTED = pa.schema([("part", pa.int32()), ("lines", pa.binary()), ("docs", pa.binary()), ("nos", pa.binary())])
_GOES = pa.schema([("line", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32())])
_BLOB = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_TEXT = pa.schema([("node", pa.int64()), ("text", pa.string())])
_MASK = pa.schema([("doc_id", pa.int64()), ("mask", pa.list_(pa.bool_())), ("n", pa.int64())])
_NONE = np.uint32(2**32 - 1)
#: bytes of masks that are broadcast to the documents at most; more meet them by a shuffle
BROADCAST_BYTES = 16 << 20
#: lines (with their band keys) that are sent on together
_LOT = 150_000


def split_lines(data: np.ndarray, offs: np.ndarray):
    """Row, number, start and end of every line that is not empty (separator: newline), in text order."""
    brk = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offs[:-1], brk + 1]))
    start = start[start < len(data)]
    start = start[data[start] != 10]
    row = np.searchsorted(offs, start, side="right") - 1
    before = np.searchsorted(brk, start)
    end = np.minimum(np.append(brk, len(data))[before], offs[row + 1])
    return row, before - np.searchsorted(brk, offs[row]), start, end


def _runs(lo: np.ndarray, n: np.ndarray):
    """lo[k], lo[k] + 1, ... (n[k] of them) for each k, one after the other, and the k of each."""
    which = np.repeat(np.arange(len(n)), n)
    out = np.arange(len(which))
    out += np.repeat(lo - (np.cumsum(n) - n), n)
    return out, which


def char_shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int):
    """Hash and line index of each run of width code points within the spans (in text order); short spans give themselves."""
    wide = np.flatnonzero(data >= 128)
    own = np.searchsorted(start, wide, side="right") - 1
    own = own[(own >= 0) & (wide < end[own])]
    plain = np.ones(len(start), bool)  # one byte a letter
    plain[own] = False
    at8 = kernels.word_views(data)
    p = np.flatnonzero(plain)
    size = end[p] - start[p]
    whole = p[size >= width] if width == 8 else p[:0]
    first, line = _runs(start[whole], end[whole] - start[whole] - width + 1)
    out = [kernels.word_hashes(at8, first)]
    lines = [whole[line]]
    rest = np.setdiff1d(np.arange(len(start)), whole, assume_unique=True)
    if len(rest):
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lo, hi = np.searchsorted(at, start[rest]), np.searchsorted(at, end[rest])
        first, line = _runs(lo, np.maximum(hi - lo - width + 1, np.minimum(hi - lo, 1)))
        last = np.minimum(first + width, hi[line])
        out.append(kernels.span_hashes(data, at[first], np.append(at, len(data))[last], lower=False))
        lines.append(rest[line])
    return np.concatenate(out), np.concatenate(lines)


def signatures(hashes: np.ndarray, line: np.ndarray, lines: int, bins: int) -> np.ndarray:
    """One-permutation MinHash; an empty bin takes the next filled one's value with the distance mixed in."""
    sig = np.full(lines * bins, _NONE, np.uint32)
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(sig, line * bins + bin_.astype(np.int64), (hashes & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig.reshape(lines, bins)
    todo = np.flatnonzero((sig == _NONE).any(axis=1) & (sig != _NONE).any(axis=1))
    cols = np.arange(2 * bins, dtype=np.int32)
    for lo in range(0, len(todo), 4096):
        rows = todo[lo : lo + 4096]
        part = sig[rows]
        filled = np.tile(part != _NONE, 2)
        ahead = np.minimum.accumulate(np.where(filled, cols, 2 * bins)[:, ::-1], axis=1)[:, ::-1][:, :bins]
        step = (ahead - cols[:bins]).astype(np.uint32)
        sig[rows] = np.take_along_axis(part, ahead % bins, axis=1) ^ ((step * np.uint32(0x9E3779B1)) & np.uint32(0xFFFFFFFE))
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.zeros((len(sig), bands), np.uint64)
    s = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    for k in range(rows):
        acc = kernels.mix(acc * np.uint64(0xD6E8FEB86659FD93) + s[:, :, k] + np.uint64(k + 1))
    return kernels.mix(acc + np.arange(1, bands + 1, dtype=np.uint64))


def _lines(batches, min_chars):
    """For each chunk: doc_ids, numbers, data, starts, ends and nodes of the lines that take part."""
    for b in batches:
        ids = b.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offs in kernels.chunks(b.column(1), limit=1 << 18, rows=1 << 20):
            row, no, start, end = split_lines(data, offs)
            use = known[lo + row] & (data[start] > 32)
            for k in np.flatnonzero(data[start] <= 32):  # begins with white space: is there anything else?
                use[k] = known[lo + row[k]] and bool((data[start[k] : end[k]] > 32).any())
            if min_chars > 1:
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                use &= chars[end] - chars[start] >= min_chars
            row, no, start, end = row[use], no[use], start[use], end[use]
            if len(row):
                yield ids[lo + row], no, data, start, end, kernels.span_hashes(data, start, end, lower=False).view(np.int64)


def _different(line, ids, no):
    """Places by line, document and number, each once: rows that share an id share their places."""
    order = np.lexsort((no, ids, line))
    line, ids, no = line[order], ids[order], no[order].astype(np.int32)
    new = np.append(True, (line[1:] != line[:-1]) | (ids[1:] != ids[:-1]) | (no[1:] != no[:-1]))
    return line[new], ids[new], no[new]


def _list(min_chars, parts):
    """First places of a task's lines, packed by part of their hash, and (part -1) the places that follow a first one."""

    def flush(held):
        node, ids, no = map(np.concatenate, zip(*held))
        node, ids, no = _different(node, ids, no)
        first = np.append(True, node[1:] != node[:-1])
        part = np.where(first, (kernels.mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int64), -1)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(-1, parts + 1))
        some = np.flatnonzero(np.diff(cut))
        sel = [order[cut[p] : cut[p + 1]] for p in some]
        return shared.batch(_LISTED, (some - 1).astype(np.int32), *([c[s].tobytes() for s in sel] for c in (node, ids, no)))

    def run(batches):
        held, size = [], 0
        for ids, no, _, _, _, node in _lines(batches, min_chars):
            held.append((node, ids, no))
            size += len(node)
            if size > _LOT:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _unpacked(batches):
    """Lines, documents and numbers of packed rows."""
    held = [], [], []
    for b in batches:
        for out, column, kind in zip(held, range(1, 4), (np.int64, np.int64, np.int32)):
            out += [np.frombuffer(v, kind) for v in b.column(column).to_pylist()]
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in held]


def _placed(batches):
    """Packed places as rows."""
    for b in batches:
        line, ids, no = _unpacked([b])
        for k in range(0, len(line), 100_000):
            yield shared.batch(_GOES, pa.nulls(len(line[k : k + 100_000]), pa.int64()), ids[k : k + 100_000], no[k : k + 100_000])


def _later(linked):
    """With the first places of all tasks at hand: all but the first of each line go (line null); of lines that
    may be linked to others the first is kept for the comparison with those (line set)."""

    def run(batches):
        line, ids, no = _unpacked(batches)
        if not len(line):
            return
        line, ids, no = _different(line, ids, no)
        first = np.append(True, line[1:] != line[:-1])
        keep = ~first
        keep[first] = in_filter(line[first], linked.value)
        line, ids, no, first = line[keep], ids[keep], no[keep], first[keep]
        for k in range(0, len(line), 100_000):
            part = slice(k, k + 100_000)
            yield shared.batch(_GOES, pa.array(line[part], pa.int64(), mask=~first[part]), ids[part], no[part])

    return run


def _bands(min_chars, width, bands, rows, parts):
    def flush(nodes, keys):
        nodes, keys = np.concatenate(nodes), np.concatenate(keys)
        nodes, once = np.unique(nodes, return_index=True)
        keys = keys[once].ravel()
        nodes = np.repeat(nodes, bands)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        short = (keys // np.uint64(parts)).astype(np.uint32)
        some = np.flatnonzero(np.diff(cut))
        sel = [order[cut[p] : cut[p + 1]] for p in some]
        return shared.batch(_BLOB, some.astype(np.int32), [short[s].tobytes() for s in sel], [nodes[s].tobytes() for s in sel])

    def run(batches):
        nodes, keys, size = [], [], 0
        for _, _, data, start, end, node in _lines(batches, max(min_chars, width)):
            _, once = np.unique(node, return_index=True)
            once.sort()
            node = node[once]
            h, line = char_shingles(data, start[once], end[once], width)
            nodes.append(node)
            keys.append(band_keys(signatures(h, line, len(once), bands * rows), bands, rows))
            size += len(node)
            if size > _LOT:
                yield flush(nodes, keys)
                nodes, keys, size = [], [], 0
        if size:
            yield flush(nodes, keys)

    return run


def _stars(batches):
    """Edges from each line of a bucket to the bucket's first, as one forest for the task."""
    held: dict[int, list] = {}
    for b in batches:
        for part, keys, nodes in zip(*(b.column(k).to_pylist() for k in range(3))):
            held.setdefault(part, []).append((np.frombuffer(keys, np.uint32), np.frombuffer(nodes, np.int64)))
    for part in list(held):
        keys, nodes = map(np.concatenate, zip(*held.pop(part)))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        bounds = kernels.unique_spans(keys)
        first = np.repeat(nodes[bounds[:-1]], np.diff(bounds))
        pick = first != nodes
        if pick.any():
            u, v = kernels.forest(nodes[pick], first[pick])
            for k in range(0, len(u), 100_000):
                yield shared.batch(_EDGE, u[k : k + 100_000], v[k : k + 100_000])


def _texts(min_chars, wanted):
    def run(batches):
        for _, _, data, start, end, node in _lines(batches, min_chars):
            hit = np.flatnonzero(in_filter(node, wanted.value))
            if len(hit):
                _, once = np.unique(node[hit], return_index=True)
                hit = hit[once]
                yield shared.batch(_TEXT, node[hit], [data[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in hit])

    return run


def _char_sets(width):
    def sets(column):
        for lo, hi, data, offs in kernels.chunks(column):
            h, line = char_shingles(data, offs[:-1], offs[1:], width) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ids, row = kernels.distinct_ids(h, line)
            yield lo, hi, ids, np.searchsorted(row, np.arange(hi - lo + 1))

    return sets


def _masks(batches):
    """For each document, whether each of its lines goes, up to the last that does."""
    for b in batches:
        column = b.column(1)
        which = np.repeat(np.arange(b.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False))
        no = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.zeros(b.num_rows, np.int64)
        np.maximum.at(size, which, no + 1)
        cut = np.concatenate([[0], np.cumsum(size)])
        for lo in range(0, b.num_rows, 2048):  # a few documents at a time: long ones have long masks
            hi = min(lo + 2048, b.num_rows)
            goes = np.zeros(cut[hi] - cut[lo], bool)
            own = (which >= lo) & (which < hi)
            goes[cut[which[own]] - cut[lo] + no[own]] = True
            mask = pa.ListArray.from_arrays(pa.array((cut[lo : hi + 1] - cut[lo]).astype(np.int32)), pa.array(goes))
            n = np.bincount(which[own] - lo, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), mask, pa.array(n, pa.int64())], names=_MASK.names)


@shared.call
def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, percent: int = 80, bands: int = 14, rows: int = 5, min_chars: int = 1) -> DataFrame:
    """(doc_id, mask array<boolean>, n): whether each line (from the first, up to the last that does) goes, and how many do; documents that lose none are absent."""
    parts = shared.partitions(docs.sparkSession)
    texts = shared.ids_and_texts(docs, id_col, text_col)
    near = texts.mapInArrow(_bands(min_chars, width, bands, rows, parts), "part int, keys binary, nodes binary").repartition(parts, "part").mapInArrow(_stars, "u long, v long")

    def fetch(family: DataFrame) -> DataFrame:
        found = texts.mapInArrow(_texts(min_chars, members(family, "node")), "node long, text string").dropDuplicates(["node"])
        return family.join(found, "node")

    linked = shared.written(verified_components(near, fetch, _char_sets(width), percent, loose=True))
    listed = shared.written(texts.mapInArrow(_list(min_chars, parts), "part int, lines binary, docs binary, nos binary"))
    goes = "line long, doc_id long, line_no int"
    later = shared.written(listed.where("part >= 0").repartition(parts, "part").mapInArrow(_later(members(linked, "node")), goes))
    firsts = later.where("line is not null").join(linked, F.col("line") == F.col("node"), "left").select(F.coalesce("component", "line").alias("component"), F.struct("doc_id", "line_no").alias("first"))
    stays = firsts.groupBy("component").agg(F.min("first").alias("stays"))
    others = firsts.join(stays, "component").where("first <> stays").select("first.*")
    gone = others.unionAll(later.where("line is null").select("doc_id", "line_no")).unionAll(listed.where("part < 0").mapInArrow(_placed, goes).select("doc_id", "line_no"))
    by_doc = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    return shared.lasting(by_doc.mapInArrow(_masks, "doc_id long, mask array<boolean>, n long"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_removed (both long) in front of clashing columns.

    A line is what split at newline gives; blank lines, lines below min_chars code points, null texts and rows with a
    null id are left alone. Ties go to the smallest (doc_id, line number). Rows that share an id lose
    the same line numbers. Removed lines take one separator with them. An empty table gives an
    empty result. Equality of lines is that of 64-bit hashes of their bytes.
    """
    drop = dropped_lines(docs, id_col, text_col, **params).toDF("__prismfold_id", "__prismfold_mask", "__prismfold_n")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.col(text_col).cast("string")) - F.length(F.replace(F.col(text_col).cast("string"), F.lit("\n"), F.lit(""))) + 1)
    loses = F.col("__prismfold_n").isNotNull()
    left = F.filter(lines, lambda _, i: ~F.coalesce(F.get("__prismfold_mask", i), F.lit(False)))
    text = F.when(loses, F.array_join(left, "\n")).otherwise(F.col(text_col))

    def row(text, removed):
        return [*(text.alias(c) if c == text_col else F.col(c) for c in kept), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")]

    # documents that surely lose nothing need no shuffle
    some = members(drop, "__prismfold_id")
    rows, flags = drop.agg(F.count(F.lit(1)), F.sum(F.size("__prismfold_mask"))).first()
    if rows * 64 + (flags or 0) <= BROADCAST_BYTES:
        drop = F.broadcast(drop)
    source = docs.select(*kept, F.col(id_col).cast("long").alias("__prismfold_id"))
    alone = having(source, "__prismfold_id", some, others=True).select(*row(F.col(text_col), F.lit(0)))
    joined = having(source, "__prismfold_id", some).join(drop, "__prismfold_id", "left")
    return alone.unionAll(joined.select(*row(text, F.coalesce("__prismfold_n", F.lit(0)))))
