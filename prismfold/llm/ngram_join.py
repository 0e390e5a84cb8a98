"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

1. Texts with equal sets collapse to one node (its count and two 64-bit sums of mixed shingle ids).
2. First order: a fixed part of the shingle space, chosen by hash and by size class, goes first and
   ascends by the number of sets that hold a shingle; the rest follows by hash. A node sends its shingles
   of that part to be counted. Those that no other set holds fill its prefix (n - ceil(t n) + 1
   shingles) first, so a node keeps only the few shared ones that are left, and most keep none.
3. Prefixes meet by shingle. Within a bucket a pair remains if its sizes allow the threshold and if its
   256-bit parity maps differ in no more bits than its sets may differ in elements. Both are lower
   bounds, so no link is lost. A bucket sends on a spanning forest of the pairs it keeps.
4. Families (components of those pairs) get their full sets, in blocks of bounded size. Pairs there
   must share prefix shingles under every further order, each a hash order of its own; those left are
   intersected exactly, except where both ends are already connected.
5. Links' components are joined back to all rows by set.

Postings travel as packed arrays, one row for each task and target partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, shared
from .families import EDGE, MAP_WORDS, POSTINGS, bucket_pairs, ddl, dealt, having, members, parity_maps, prefix_sizes, verified_components

#: (from this set size on, twentieths of the shingle space that are counted at 90 percent; twice that at 80)
SIZE_CLASSES = ((1, 20), (48, 10), (256, 4))
_SEEDS = [np.uint64(0x5851F42D4C957F2D + 0x632BE59BD9B4E019 * k & (1 << 64) - 1) for k in range(8)]
_EXTRA = np.uint64(1)

_NODE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("keys", pa.binary()), ("keys_up", pa.binary()), ("map", pa.binary())])
_POST = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary()), ("ups", pa.binary())])
_SEEN = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("ups", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("sent", pa.binary()), ("sizes", pa.binary()), ("maps", pa.binary())])


def order_keys(ids: np.ndarray, order: int) -> np.ndarray:
    """54-bit ranks of shingles under a hash order."""
    return kernels.mix(ids ^ _SEEDS[order]) >> np.uint64(10)


def _prefixes(ids, bounds, order, percent):
    """Sorted keys of each row's prefix under an order, and their bounds."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    keys = np.sort((row.astype(np.uint64) << np.uint64(54)) | order_keys(ids, order))
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], n)
    keep = place < np.repeat(prefix_sizes(n, percent), n)
    return keys[keep] & np.uint64((1 << 54) - 1), np.concatenate([[0], np.cumsum(prefix_sizes(n, percent))])


def _fingerprints(ids, bounds):
    out = []
    for seed in _SEEDS[6:8]:
        total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(kernels.mix(ids ^ seed), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def _class_keys(ids, bounds, cls, percent):
    """For each row, the keys of a size class that it sends: the counted part, and by hash what its prefix lacks."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    share = np.array([min(20, -(-s * (100 - percent) // 10)) for _, s in SIZE_CLASSES])[cls][row]
    counted = (ids % np.uint64(20)).astype(np.int64) < share
    keys = kernels.mix(ids ^ (np.uint64(0x2545F4914F6CDD1D) * (cls[row] + 1).astype(np.uint64)))
    keys = np.where(counted, keys & ~_EXTRA, keys | _EXTRA)
    inside = np.bincount(row, counted, minlength=len(n)).astype(np.int64)
    lack = np.maximum(prefix_sizes(n, percent) - inside, 0)
    send = counted.copy()
    for k in np.flatnonzero(lack):
        rest = np.flatnonzero(~counted[bounds[k] : bounds[k + 1]]) + bounds[k]
        send[rest[np.argsort(keys[rest])[: lack[k]]]] = True
    cut = np.concatenate([[0], np.cumsum(np.bincount(row, send, minlength=len(n)).astype(np.int64))])
    sent = keys[send]
    return [sent[cut[k] : cut[k + 1]].tobytes() for k in range(len(n))]


def _nodes(width, percent):
    def run(batches):
        least = np.array([s for s, _ in SIZE_CLASSES])
        for b in batches:
            doc_ids = b.column(0)
            for lo, hi, ids, bounds in kernels.shingle_sets(b.column(1), width):
                n = np.diff(bounds)
                fp, fp2 = _fingerprints(ids, bounds)
                cls = np.maximum(np.searchsorted(least, n, side="right") - 1, 0)
                up = np.searchsorted(least, n * 100 // percent, side="right") - 1  # the largest partner's class
                keys_up = [None] * len(n)
                for k in np.flatnonzero(up > cls):
                    keys_up[k] = _class_keys(ids[bounds[k] : bounds[k + 1]], np.array([0, n[k]]), up[k : k + 1], percent)[0]
                yield shared.batch(_NODE, doc_ids.slice(lo, hi - lo), n, fp, fp2, _class_keys(ids, bounds, cls, percent), keys_up, [m.tobytes() for m in parity_maps(ids, bounds)])

    return run


def _gathered(batches, dtypes):
    """Lists of arrays by column of packed rows, keyed by part."""
    held: dict[int, list] = {}
    for b in batches:
        for part, *values in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
            held.setdefault(part, []).append([np.frombuffer(v, t) for v, t in zip(values, dtypes)])
    return held


def _send(parts):
    """A task's sent keys, by key."""

    def flush(nodes, ups, keys):
        at = np.repeat(np.arange(len(nodes)), [len(k) // 8 for k in keys])
        keys = np.frombuffer(b"".join(keys), np.uint64)
        short = ((keys >> np.uint64(1)) // np.uint64(parts) << np.uint64(1) | keys & _EXTRA).astype(np.uint32)
        part = ((keys >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        nodes, ups = np.array(nodes, np.int64), np.array(ups, np.uint8)
        out = [[] for _ in _POST]
        for p, k, a in dealt(part, parts, short, at):
            used, own = np.unique(a, return_inverse=True)
            for column, value in zip(out, (p, k.tobytes(), own.astype(np.uint32).tobytes(), nodes[used].tobytes(), ups[used].tobytes())):
                column.append(value)
        return shared.batch(_POST, *out)

    def run(batches):
        held, size = ([], [], []), 0
        for b in batches:
            for column, values in zip(held, (b.column(k).to_pylist() for k in range(3))):
                column += values
            size += b.column(2).nbytes
            if size > 32 << 20:
                yield flush(*held)
                held, size = ([], [], []), 0
        if size:
            yield flush(*held)

    return run


def _count(parts):
    """Postings of keys that several sets sent, with the number of sets, by node."""

    def run(batches):
        held = _gathered(batches, (np.uint32, np.uint32, np.int64, np.uint8))
        for part in list(held):
            rows = held.pop(part)
            base = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])
            at = np.concatenate([r[1].astype(np.int64) + s for r, s in zip(rows, base)])
            keys, nodes, ups = (np.concatenate([r[k] for r in rows]) for k in (0, 2, 3))
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            count = np.diff(kernels.unique_spans(keys))
            count = np.repeat(count, count)
            some = count > 1
            if not some.any():
                continue
            keys, at, count = keys[some].astype(np.uint64) | np.uint64(part << 32), at[some], count[some].astype(np.uint32)
            to = (kernels.mix(nodes[at].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            sent_on = list(dealt(to, parts, nodes[at], ups[at], keys, count))
            empty = [b""] * len(sent_on)
            yield shared.batch(_SEEN, [d[0] for d in sent_on], *[[d[k].tobytes() for d in sent_on] for k in range(1, 5)], empty, empty, empty)

    return run


def _describe(parts):
    """The nodes themselves (set size, number of keys sent, parity map), by node."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            nodes, ups, sizes = (b.column(k).to_numpy().astype(t) for k, t in ((0, np.int64), (1, np.uint8), (3, np.int64)))
            sent = np.array([len(k) // 8 for k in b.column(2).to_pylist()], np.int64)
            maps = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, MAP_WORDS)
            to = (kernels.mix(nodes.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            sent_on = list(dealt(to, parts, nodes, ups, sent, sizes, maps))
            empty = [b""] * len(sent_on)
            yield shared.batch(_SEEN, [d[0] for d in sent_on], *[[d[k].tobytes() for d in sent_on] for k in (1, 2)], empty, empty, *[[d[k].tobytes() for d in sent_on] for k in (3, 4, 5)])

    return run


def _first_prefix(parts, percent):
    """What each node's prefix under the first order holds of shared keys, by key."""

    def run(batches):
        held = _gathered(batches, (np.int64, np.uint8, np.uint64, np.uint32, np.int64, np.int64, np.uint64))
        for part in list(held):
            rows = held.pop(part)
            posts, infos = [r for r in rows if len(r[2])], [r for r in rows if len(r[4])]
            if not posts or not infos:
                continue
            nodes, ups, sent, sizes = (np.concatenate([r[k] for r in infos]) for k in (0, 1, 4, 5))
            maps = np.concatenate([r[6].reshape(-1, MAP_WORDS) for r in infos])
            order = np.lexsort((ups, nodes))
            nodes, ups, sent, sizes, maps = nodes[order], ups[order], sent[order], sizes[order], maps[order]
            p_nodes, p_ups, keys, counts = (np.concatenate([r[k] for r in posts]) for k in range(4))
            order = np.lexsort((keys, counts, keys & _EXTRA, p_ups, p_nodes))
            p_nodes, p_ups, keys = p_nodes[order], p_ups[order], keys[order]
            new = np.append(True, (p_nodes[1:] != p_nodes[:-1]) | (p_ups[1:] != p_ups[:-1]))
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(keys)))
            info = np.searchsorted(nodes, p_nodes[start])
            info += ups[info] != p_ups[start]
            room = prefix_sizes(sizes[info], percent) - (sent[info] - length)
            keep = np.arange(len(keys)) - np.repeat(start, length) < np.repeat(room, length)
            at, keys = np.repeat(info, length)[keep], keys[keep]
            if not len(keys):
                continue
            to = (kernels.mix(keys) % np.uint64(parts)).astype(np.int64)
            out = [[] for _ in POSTINGS]
            for p, k, a in dealt(to, parts, keys, at):
                used, own = np.unique(a, return_inverse=True)
                for column, value in zip(out, (p, k.tobytes(), own.astype(np.uint32).tobytes(), nodes[used].tobytes(), sizes[used].tobytes(), maps[used].tobytes())):
                    column.append(value)
            yield shared.batch(POSTINGS, *out)

    return run


def _prefixes_by_row(ids, bounds, order, percent):
    """As _prefixes, for any number of rows."""
    keys, cuts = [], [np.zeros(1, np.int64)]
    for lo in range(0, len(bounds) - 1, 512):
        b = bounds[lo : lo + 513]
        k, c = _prefixes(ids[b[0] : b[-1]], b - b[0], order, percent)
        keys.append(k)
        cuts.append(c[1:] + cuts[-1][-1])
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), np.concatenate(cuts)


def _prefix_filters(percent, orders):
    return lambda ids, bounds: [_prefixes_by_row(ids, bounds, k, percent) for k in orders]


def _set_node(ids, bounds):
    return _fingerprints(ids, bounds)[0]


@shared.call
def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, orders: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z only) runs of bytes other than space and \\t..\\r. Sets link when
    100 * intersection >= percent * union. Null, empty and blank texts have empty sets and link
    with nothing; a text with fewer than width words is one shingle. Rows with a null id keep a
    null component and link with nothing. Repeated ids share a component. Equal sets always
    link. Other columns of docs are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = shared.ids_and_texts(docs, id_col, text_col)
    found = shared.written(rows.mapInArrow(_nodes(width, percent), ddl(_NODE)))

    parts = shared.partitions(spark)
    once = [F.first(c).alias(c) for c in ("keys", "keys_up", "map")]
    sets = found.where("n > 0 and doc_id is not null").groupBy("fp", "fp2", "n").agg(*once)
    sets = shared.written(sets.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("up"), "keys"), F.struct(F.lit(1).alias("up"), F.col("keys_up").alias("keys")))).alias("s"), "n", "map").where("s.keys is not null").select("fp", "s.up", "s.keys", "n", "map"))
    every = shared.written(found.select("doc_id", "n", "fp"))
    shared.forget(found)
    seen = sets.select("fp", "up", "keys").mapInArrow(_send(parts), ddl(_POST)).repartition(parts, "part").mapInArrow(_count(parts), ddl(_SEEN))
    seen = seen.unionAll(sets.mapInArrow(_describe(parts), ddl(_SEEN))).repartition(parts, "part")
    near = seen.mapInArrow(_first_prefix(parts, percent), ddl(POSTINGS)).repartition(parts, "part").mapInArrow(bucket_pairs(percent), ddl(EDGE))

    firsts = every.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))

    def texts(family: DataFrame) -> DataFrame:
        wanted = family.join(firsts, F.col("node") == F.col("fp")).drop("fp")
        there = having(rows, "doc_id", members(wanted, "doc_id"))
        return wanted.join(there, "doc_id").drop("doc_id")

    linked = verified_components(near, texts, lambda text: kernels.shingle_sets(text, width), percent, _prefix_filters(percent, range(1, orders)), _set_node)
    linked = linked.withColumnRenamed("component", "c")
    least = linked.join(firsts, F.col("node") == F.col("fp")).groupBy("c").agg(F.min("doc_id").alias("component_id"))
    labels = linked.join(least, "c").select(F.col("node").alias("fp"), "component_id")
    labels = firsts.join(labels, "fp", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(labels, "fp", "left")
    return shared.lasting(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
